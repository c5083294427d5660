"""Enrichment by small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.scalars import first_filled, text
from waybill.session import unused
from waybill.sources import dims


def fill_blank(df: DataFrame, column: str, key: str, dim: DataFrame, dim_key: str, dim_value: str) -> DataFrame:
    """``column`` filled from ``dim`` where it is null or empty.

    The join is left to Spark: a small dimension is broadcast, a large one not."""
    at, value = unused(df, "key", "value")
    out = df.join(dim.select(F.col(dim_key).alias(at), F.col(dim_value).alias(value)), F.col(key) == F.col(at), "left")
    return out.select(*[first_filled(F.col(c), F.col(value)).alias(c) if c == column else c for c in df.columns])


def compact_code(flight_no: Column) -> Column:
    return F.regexp_replace(F.upper(text(flight_no)), "[^A-Z0-9]", "")


def with_airline_code(df: DataFrame, spark: SparkSession, flight_no: str = "flight_no") -> DataFrame:
    """airline_code: what the first three characters stand for, else the first
    two, else those two themselves.  The payload is a fixed table under 200 rows."""
    three, two, of_three, of_two = unused(df, "three", "two", "of_three", "of_two")
    payload = lambda code, iata: F.broadcast(dims.airline_payload(spark).select(F.col("code").alias(code), F.col("iata").alias(iata)))
    c = compact_code(F.col(flight_no))
    out = df.withColumns({three: F.substring(c, 1, 3), two: F.substring(c, 1, 2)})
    out = out.join(payload(three, of_three), three, "left").join(payload(two, of_two), two, "left")
    rest = [x for x in df.columns if x != "airline_code"]
    return out.select(*rest, F.coalesce(of_three, of_two, two).alias("airline_code"))


def canonical(df: DataFrame, code: str, aliases: DataFrame, alias: str = "alias", target: str = "iata") -> DataFrame:
    """``code`` replaced by what it is an alias of."""
    from_, to = unused(df, "alias", "target")
    out = df.join(aliases.select(F.col(alias).alias(from_), F.col(target).alias(to)), F.col(code) == F.col(from_), "left")
    return out.select(*[F.coalesce(to, code).alias(code) if c == code else c for c in df.columns])


def known_only(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    return df.join(dim.select(F.col(dim_key).alias(key)), key, "left_semi")


def unknown_only(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    return df.join(dim.select(F.col(dim_key).alias(key)), key, "left_anti")


def first_keyword(c: Column, labels: tuple[tuple[str, str], ...] = dims.PLATFORMS) -> Column:
    """Label of the first listed keyword that occurs, empty if none does."""
    out = None
    for word, label in labels:
        found = F.contains(c, F.lit(word))
        out = F.when(found, label) if out is None else out.when(found, label)
    return out.otherwise("")
