"""Written indexes over a place dimension: ranked search, and lookups by code.

The search index has three tables: ``short`` holds the answers of every query of one or
two characters, ``counts`` how many places each gram of three characters lists, and
``postings`` the places of each gram, those of a frequent one dealt over blocks of about
``BLOCK`` places.  A longer query reads the list of its rarest gram only, and no join
key, however frequent, lists more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.functions.scalars import strip, text
from waybill.operators.search import PLACES, priority
from waybill.session import Tables, dealt

GRAM, MOST, BLOCK = 3, 15, 4096
#: Rows of postings that a task sorts and writes.
WRITTEN = 1 << 20
_PLACE = ("code", "city", "airport", "country", "ord")


def _runs(c: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _ranked(df: DataFrame, by: str, query: str) -> DataFrame:
    """The best ``MOST`` places of each ``by``."""
    found = df.withColumn("priority", priority(F.col("code"), F.col("city"), F.col("airport"), F.col(query))).where("priority IS NOT NULL")
    best = Window.partitionBy(by).orderBy("priority", "ord")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MOST)


def write_index(places: DataFrame, folder: str) -> None:
    """The index of (code, city, airport, country, ord) below ``folder``."""
    upper = [F.coalesce(F.upper(F.col(c)), F.lit("")) for c in ("code", "city", "airport")]
    place = dealt(places.select(*_PLACE), PLACES)
    begins = [F.substring(c, 1, n) for c in upper[:2] for n in (1, 2)]
    short = place.withColumn("gram", F.explode(F.array_distinct(F.concat(F.array(*begins), _runs(upper[2], 1), _runs(upper[2], 2))))).where("gram <> ''")
    _ranked(short, "gram", "gram").select("gram", "rank", "code", "city", "airport", "country", "priority").write.mode("overwrite").parquet(f"{folder}/short")

    # a code or city that begins with a query has all its grams, and so has a name that contains it
    listed = place.withColumn("gram", F.explode(F.array_distinct(F.concat(*[_runs(c, GRAM) for c in upper]))))
    listed.groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/counts")
    counts = listed.sparkSession.read.parquet(f"{folder}/counts")
    parts = max(listed.sparkSession.sparkContext.defaultParallelism, -(-(counts.agg(F.sum("n")).first()[0] or 0) // WRITTEN))
    blocks = listed.join(counts, "gram").withColumn("block", F.pmod(F.xxhash64("ord", "code"), F.floor(F.col("n") / BLOCK) + 1).cast("int"))
    blocks.select("gram", "block", *_PLACE).repartition(parts, "gram", "block").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/postings")


def indexed_matches(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """query_id, rank, code, city, airport, country, priority of (query_id, query): what
    :func:`waybill.operators.search.top_matches` finds for each, from the written index."""
    table = lambda name: spark.read.parquet(f"{folder}/{name}")
    asked = queries.select("query_id", F.upper(strip(text(F.col("query")))).alias("q")).where("q <> ''")
    each = asked.select("q").distinct()
    short = each.where(F.length("q") < GRAM).join(table("short"), F.col("q") == F.col("gram")).drop("gram")
    grams = each.where(F.length("q") >= GRAM).select("q", F.explode(F.array_distinct(_runs(F.col("q"), GRAM))).alias("gram"))
    known = grams.join(table("counts"), "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    wanted = known.where("rarest.n > 0").select("q", F.col("rarest.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.floor(F.col("rarest.n") / BLOCK).cast("int"))).alias("block"))
    columns = ["q", "rank", "code", "city", "airport", "country", "priority"]
    with Tables(spark, "searches") as tables:
        # written, so that few queries are broadcast, and the index is not dealt anew for them
        wanted = tables.put(wanted, "wanted")
        met = _ranked(wanted.join(table("postings"), ["gram", "block"]), "q", "q").select(*columns)
        met = tables.keep(met.unionByName(short.select(*columns)), "matches")
    return asked.join(met, "q").drop("q")


def write_lookup(places: DataFrame, path: str, rows_per_group: int = 20_000) -> None:
    """The dimension for lookups by ``code``: sorted, so that a row group holds few
    codes, with a Bloom filter on them for codes that fall between."""
    n = places.count()
    width = 128  # bytes of a row, about; a row group is bounded in bytes
    writer = places.select(*_PLACE).repartitionByRange("code").sortWithinPartitions("code").write.mode("overwrite")
    writer = writer.option("parquet.bloom.filter.enabled#code", "true").option("parquet.bloom.filter.expected.ndv#code", str(max(1, min(n, rows_per_group))))
    writer.option("parquet.block.size", str(rows_per_group * width)).option("parquet.block.size.row.check.min", "100").parquet(path)


def looked_up(spark: SparkSession, path: str, codes: list[str]) -> DataFrame:
    """code, found, city, airport, country of some codes, from :func:`write_lookup`'s
    table: the codes reach the scan, which skips row groups without them."""
    wanted = list(dict.fromkeys(c.strip().upper() for c in codes))
    asked = spark.createDataFrame([(c,) for c in wanted], "code string")
    found = spark.read.parquet(path).where(F.col("code").isin(wanted)).select("code", "city", "airport", "country", F.lit(True).alias("found"))
    return asked.join(found, "code", "left").select("code", F.coalesce("found", F.lit(False)).alias("found"), "city", "airport", "country")
