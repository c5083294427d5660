"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.session import Tables, spread, stored, unused

__all__ = ["Tables", "bit_table", "dealt_table", "drop_rows", "flagged", "in_table", "listed_rows", "place", "read_table", "small_batches", "stored", "table_bits", "unused"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs much more than reading."""
    return spread(read_table(spark, sf_dir, name))


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` in each
    piece (one row at least), which bounds what a task holds at a time."""
    for batch in batches:
        col = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(col).to_pylist()):
            n = n or 0
            if i > start and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


#: Bit tables have eight places or more to a key, between these sizes; the
#: largest is what a task or the driver may hold of one: 16 MB.
LEAST_TABLE, MOST_TABLE = 16, 27
#: The same for tables that are joined as rows of 64 places: 4 MB of places.
MOST_ROWS_TABLE = 25


def table_bits(keys: int, most: int = MOST_TABLE) -> int:
    """The logarithm of a bit table's size for so many keys."""
    return min(most, max(LEAST_TABLE, math.ceil(math.log2(8 * keys + 1))))


def place(bits: int, *keys: str | Column) -> Column:
    """A place in a table of 2**bits places for a key."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)


def bit_table(df: DataFrame, at: Column, bits: int) -> np.ndarray:
    """Which places below 2**bits occur, as words of 64 bits.  What the driver
    gathers is 2**(bits - 6) longs at most, however many rows there are; a table
    that is too full only tells less."""
    table = np.zeros(1 << (bits - 6), np.uint64)
    places = df.select(at.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("at"))
    found = places.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).where("at IS NOT NULL").toArrow()
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def in_table(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def listed_rows(df: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, Callable[[np.ndarray], np.ndarray] | None]:
    """(rows, near): the rows of ``df`` that may have a ``key`` of ``listed`` (its
    one column, distinct; null is a key like any other).

    Up to 2**(MOST_TABLE - 1) keys a bit table says so: ``rows`` is ``df`` with its
    places in a column before the others, and a task filters with ``near(places)``.
    Beyond, such a table would say nothing, and the rows come from a join, without
    places (``near`` is None)."""
    n = listed.count()
    if n > 1 << (MOST_TABLE - 1):
        (name,) = unused(df, "listed")
        some = df.join(listed.select(F.col(key).alias(name)), F.col(key).eqNullSafe(F.col(name)), "left_semi")
        return some.select(F.lit(0).cast("long").alias(name), *df.columns), None
    bits = table_bits(n)
    table = bit_table(listed, place(bits, key), bits)
    (name,) = unused(df, "place")
    return df.select(place(bits, key).alias(name), *df.columns), lambda places: in_table(table, places)


def flagged(df: DataFrame, key: Column, listed: DataFrame, flag: str) -> DataFrame:
    """``df`` and a column ``flag``: whether the row's ``key`` may be in ``listed`` (its
    one column, distinct, not null).  False is certain; a null key is not listed.

    A bit table, joined as rows of 64 places, says so, and no row leaves its task.
    A list too long for the table's bound flags more rows, all of them in the end."""
    (name,) = listed.columns
    bits = table_bits(listed.count(), MOST_ROWS_TABLE)
    k, p, at, word = unused(df, "key", "place", "at", "word")
    places = listed.select(place(bits, name).alias(p)).groupBy(F.shiftright(p, 6).cast("int").alias(at))
    # at most 2**(MOST_ROWS_TABLE - 6) rows, so its size is bounded by the table's
    table = F.broadcast(places.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{p}` & 63 as int))")).alias(word)))
    marked = df.withColumn(k, key).withColumn(p, place(bits, k)).withColumn(at, F.shiftright(p, 6).cast("int")).join(table, at, "left")
    hit = F.expr(f"`{k}` IS NOT NULL AND (shiftrightunsigned(`{word}`, cast(`{p}` & 63 as int)) & 1) = 1")
    return marked.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def drop_rows(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``gone`` (its one column, distinct,
    not null); a null key stays.  Only rows that may be listed meet the list."""
    k, hit = unused(df, "key", "hit")
    marked = flagged(df.withColumn(k, key), F.col(k), gone, hit)
    far = marked.where(~F.col(hit)).select(*df.columns)
    near = marked.where(hit).join(gone.select(F.col(gone.columns[0]).alias(k)), k, "left_anti").select(*df.columns)
    return far.unionByName(near)
