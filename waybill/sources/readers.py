"""Readers: texts of travel papers, uploads, form values, settings and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.scalars import strip
from waybill.sources.heads import file_heads

MOST_UPLOAD_BYTES = 15 << 20
LEDGER_SCHEMA = """sno long, generated_on string, booking_platform string, pnr string, booking_id string, lead_passenger string,
total_pax int, customer_phone string, route string, travel_date string, departure_time string, flight_nos string,
total_amount double, payment_mode string, fare_type string, refund_status string, flight_status string, notes string"""


def document_texts(spark: SparkSession, path: str) -> DataFrame:
    """filename, text of whole text files (text layers of travel papers)."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("filename"), F.col("value").alias("text"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """filename, length, content of files, for :func:`upload_error`; ``content`` is
    the first bytes only, and null where the file is too large, which is not opened."""
    read = file_heads(spark, path, open_up_to=MOST_UPLOAD_BYTES)
    return read.select("filename", "length", F.col("head").alias("content"))


def upload_error(filename: Column, length: Column, content: Column) -> Column:
    """First reason to refuse an upload, null if there is none."""
    return (
        F.when(filename.isNull(), "no file")
        .when(filename == "", "no file name")
        .when(~F.lower(filename).endswith(".pdf"), "not a pdf")
        .when(length > MOST_UPLOAD_BYTES, "too large")
        .when(content.isNull() | (F.substring(content, 1, 4) != F.lit(b"%PDF")), "not a pdf inside")
    )


def form_values(submissions: DataFrame) -> DataFrame:
    """request_id, ord, key, value from (request_id, form map)."""
    return submissions.select("request_id", F.posexplode("form").alias("ord", "key", "value"))


def form_bodies(bodies: DataFrame) -> DataFrame:
    """request_id, ord, key, value of (request_id, body), bodies as browsers submit them
    (``a=1&b=x+y%20z``): split at ``&`` and the first ``=``, decoded as UTF-8.

    A part without ``=`` has an empty value; empty parts are none; one whose escapes are
    broken stays as it was sent, but for ``+``.  Repeated keys keep their order, of which
    the first counts (:func:`waybill.operators.itinerary.forms`)."""
    parts = bodies.select("request_id", F.posexplode(F.split("body", "&")).alias("ord", "part")).where("part <> ''")
    at = F.locate("=", F.col("part"))
    plain = lambda c: F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))
    key = F.when(at > 0, F.substring(F.col("part"), F.lit(1), at - 1)).otherwise(F.col("part"))
    value = F.when(at > 0, F.substring(F.col("part"), at + 1, F.length("part"))).otherwise("")
    return parts.select("request_id", "ord", plain(key).alias("key"), plain(value).alias("value"))


def form_body(kv: DataFrame, order: list[str]) -> DataFrame:
    """request_id, body of (request_id, key, value): a request's pairs as one body, in
    their order.  A body is as large as its form; a null value is sent empty."""
    pair = F.concat(F.url_encode("key"), F.lit("="), F.url_encode(F.coalesce("value", F.lit(""))))
    pairs = kv.where("key IS NOT NULL").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*order, pair.alias("pair")))).alias("pairs"))
    return pairs.select("request_id", F.array_join("pairs.pair", "&").alias("body"))


def settings(spark: SparkSession, path: str, environment: dict[str, str] | None = None) -> DataFrame:
    """key, value of a KEY=VALUE file: blank lines, # lines and lines without =
    are skipped, quotes go, and of equal keys the first counts.  What
    ``environment`` has already wins."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line"), F.monotonically_increasing_id().alias("ord"))
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith("#") & F.contains("line", F.lit("=")))
    parts = F.split("line", "=", 2)
    pairs = kept.select(strip(parts[0]).alias("key"), F.regexp_replace(F.regexp_replace(strip(parts[1]), '^"+|"+$', ""), "^'+|'+$", "").alias("value"), "ord")
    found = pairs.where("key <> ''").groupBy("key").agg(F.min_by("value", "ord").alias("value"))
    if not environment:
        return found
    already = F.create_map(*[F.lit(x) for pair in environment.items() for x in pair])
    return found.select("key", F.coalesce(F.try_element_at(already, F.col("key")), "value").alias("value"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows below a ledger's folder, each append's in a folder of its own."""
    return spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", True).parquet(path)
