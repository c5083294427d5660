"""The booking ledger: an append-only table with running numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.functions.scalars import booking_id, cut, first_filled, platform_code, text
from waybill.operators.claims import claim, next_number, unfilled
from waybill.session import Tables, located, stored, unused
from waybill.sources.heads import file_heads
from waybill.sources.readers import LEDGER_SCHEMA, ledger

#: Partition number and place in it, as ``monotonically_increasing_id`` packs them.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str], start: int = 0, column: str = "sno", put: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Running numbers start + 1, start + 2, ... in the order of ``order``.

    Rows are range-partitioned and sorted in their partitions, and written once
    with partition and place: both are then facts of that table, however it is
    read again.  What meets in one place is one count per partition, not the rows.
    Finding the ranges reads all rows once more: write rows that are dear to make first."""
    place, part_no, before_it = unused(df, "place", "part", "before")
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    rows = put(ranged.withColumn(place, F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright(place, _PLACE_BITS), F.col(place).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    counts = rows.groupBy(part.alias(part_no)).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part_no).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(part_no, before.alias(before_it))
    # one row for each partition of the range exchange
    out = rows.withColumn(part_no, part).join(F.broadcast(offsets), part_no)
    return out.select(*df.columns, (F.lit(start) + F.col(before_it) + within + 1).alias(column))


def next_booking_id(ledger: DataFrame, platform: Column, day: Column) -> DataFrame:
    """One row: the id the next booking would get.  Numbers run over the whole
    ledger, whatever the day or platform."""
    return ledger.agg(F.count("*").alias("n")).select(booking_id(platform_code(platform), day, F.col("n") + 1).alias("booking_id"))


def real(bookings: DataFrame) -> DataFrame:
    """Without dummies."""
    return bookings.where(~F.coalesce(F.col("is_dummy"), F.lit(False))) if "is_dummy" in bookings.columns else bookings


def ledger_rows(bookings: DataFrame, as_of: Column) -> DataFrame:
    """The ledger's fields, all but the number, from nested bookings
    (:func:`waybill.operators.itinerary.bookings`); ``is_dummy`` goes along."""
    first = F.get("flights", 0)
    return bookings.select(
        F.date_format(as_of, "yyyy-MM-dd HH:mm:ss").alias("generated_on"),
        "booking_platform", "pnr", "booking_id",
        F.when(F.size("travellers") > 0, text(F.get("travellers", 0)["name"])).otherwise("Unknown").alias("lead_passenger"),
        F.size("travellers").alias("total_pax"), "customer_phone", "route",
        text(first["date"]).alias("travel_date"), text(first["dep_time"]).alias("departure_time"),
        F.array_join(F.transform("flights", lambda f: text(f["flight_no"])), ", ").alias("flight_nos"),
        F.col("total_fare").alias("total_amount"), F.col("payment_method").alias("payment_mode"),
        "fare_type", "refund_status", F.lit("Confirmed").alias("flight_status"), F.lit("").alias("notes"), "is_dummy",
    )


#: Text that goes with a delivered document: lead traveller, record, route, day, company.
MESSAGE = "Hello %s,\nyour travel document is attached.\n\nRecord %s, %s\nFirst day: %s\n\n%s"


def caption(lead: Column, pnr: Column, route: Column, day: Column, company: str) -> Column:
    """The message, cut at what one can hold."""
    return cut(F.format_string(MESSAGE, text(lead), first_filled(pnr, F.lit("-")), text(route), first_filled(day, F.lit("-")), F.lit(company)), "caption")


#: How often a part of the ledger is written again after a failure.
TRIES = 3


def append(spark: SparkSession, bookings: DataFrame, path: str, order: list[str]) -> int | None:
    """Append real bookings (dummies stay out), numbered after what is there; the first
    number, or None if there is no row.

    Any number of writers at a time: rows are numbered from one and counted, then as
    many numbers are claimed (:mod:`waybill.operators.claims`), then the rows go into a
    folder of their own, so that no writer's commit touches another's files.  A write
    that fails is tried again under the same numbers."""
    names = [f.name for f in spark.createDataFrame([], LEDGER_SCHEMA).schema.fields]
    with Tables(spark, "ledger") as tables:
        rows = numbered(tables.put(real(bookings).drop("sno"), "unnumbered"), order, put=tables.put).select(*names)
        n = rows.count()
        if not n:
            return None
        existing = 0
        if next_number(spark, path) is None:
            store, at = located(spark, path)
            existing = ledger(spark, path).count() if store.exists(at) else 0
        first = claim(spark, path, n, existing)
        placed = rows.withColumn("sno", F.col("sno") + (first - 1))
        for left in reversed(range(TRIES)):
            try:
                placed.write.mode("overwrite").parquet(f"{path}/{_PART}{first:019d}")
                return first
            except Exception:
                if not left:
                    raise


_PART = "rows-"


def open_ranges(spark: SparkSession, path: str) -> DataFrame:
    """first, last, rows of claimed numbers that the ledger lacks rows of."""
    rows = ledger(spark, path).select(F.regexp_extract("_metadata.file_path", rf"/{_PART}(\d+)/", 1).try_cast("long").alias("first"))
    return unfilled(spark, path, rows)


def reserved_booking_ids(spark: SparkSession, path: str, n: int, platform: Column, day: Column) -> DataFrame:
    """number, booking_id: ``n`` ids that no other caller gets."""
    first = claim(spark, path, n, 0 if next_number(spark, path) else ledger(spark, path).count())
    return spark.range(first, first + n).select(F.col("id").alias("number"), booking_id(platform_code(platform), day, F.col("id")).alias("booking_id"))


# How a Parquet file begins and ends; before the end, the footer's length in four bytes.
MAGIC = b"PAR1"
QUARANTINE = "_quarantine"


def damage(length: Column, head: Column, tail: Column) -> Column:
    """Why a part file cannot be read, null if it looks whole, from its first and last eight bytes."""
    digits = F.hex(F.substring(tail, 1, 4))  # least byte first
    footer = F.conv(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    return (
        F.when(length == 0, "empty")
        .when(F.substring(head, 1, 4) != F.lit(MAGIC), "no beginning")
        .when((length < 12) | (F.substring(tail, 5, 4) != F.lit(MAGIC)), "no end")
        .when(footer > length - 12, "footer longer than the file")
    )


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, reason of part files that are cut or overwritten; tasks read a
    few bytes of each."""
    files = file_heads(spark, path).withColumn("reason", damage(F.col("length"), F.col("head"), F.col("tail")))
    return files.where("reason IS NOT NULL").select("path", "length", "reason")


def quarantine(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Move damaged part files out of the ledger's way, into its hidden folder
    ``_quarantine``; (where each is now, reason).  Their numbers stay claimed, so
    numbering goes on after them and :func:`open_ranges` shows what is missing."""
    moved = []
    for r in damaged_files(spark, path).toLocalIterator():
        inside = r["path"].rsplit("/", 2)
        target = f"{path}/{QUARANTINE}/{inside[-2]}-{inside[-1]}"
        store, to = located(spark, target)
        store.mkdirs(to.getParent())
        _, at = located(spark, r["path"])
        store.rename(at, to)
        checksum = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.crc")
        if store.exists(checksum):
            store.delete(checksum, False)
        moved.append((target, r["reason"]))
    return moved


def column_widths(df: DataFrame, most: int = 50) -> DataFrame:
    """column, width: the longest value's length plus two, up to ``most``."""
    longest = df.agg(*[F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.least(F.coalesce(F.col(c), F.lit(0)) + 2, F.lit(most)).alias("width")) for c in df.columns])
    return longest.select(F.explode(pairs).alias("p")).select("p.*")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key.  As an aggregate, not a window: a key that a
    third of all rows share is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    (row,) = unused(df, "row")
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias(row)
    return df.groupBy(*key).agg(first).select(*key, f"{row}.*").select(*df.columns)
