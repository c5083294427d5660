"""Fare arithmetic and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.scalars import money

PARTS = ("base_fare", "taxes_fees", "insurance", "meals_fee", "baggage_fee", "seats_fee", "zero_cancel", "discount")

# Labels of fare lines, in the order they are printed.
LABELS = ("Base Fare", "Airline Taxes & Fees", "Insurance", "Meals", "Baggage", "Seats", "Zero Cancel", "Discount")
ALWAYS = LABELS[:2]


def parsed_fares(df: DataFrame) -> DataFrame:
    """The eight parts as doubles: absent (null) counts 0, and one value that is
    no number, an empty one too, makes all of them 0."""
    values = [F.coalesce(F.col(p).cast("string"), F.lit("0")) for p in PARTS]
    numbers = [F.when(v.rlike(r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$"), F.trim(v)).try_cast("double") for v in values]
    bad = reduce(lambda a, b: a | b, [n.isNull() for n in numbers])
    return df.withColumns({p: F.when(bad, 0.0).otherwise(n) for p, n in zip(PARTS, numbers, strict=True)})


def total_fare(*, of: dict[str, Column] | None = None) -> Column:
    c = of or {p: F.col(p) for p in PARTS}
    return reduce(lambda a, b: a + b, [c[p] for p in PARTS[:-1]]) - c[PARTS[-1]]


def printed_lines() -> Column:
    """Array of (position, label, amount, shown): the lines that are printed."""
    signed = [F.col(p) if p != "discount" else -F.col(p) for p in PARTS]
    lines = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), v.alias("amount"), money(v).alias("shown")) for i, (label, v) in enumerate(zip(LABELS, signed, strict=True))])
    return F.filter(lines, lambda x: (x["amount"] != 0) | x["label"].isin(*ALWAYS))


def fare_lines(df: DataFrame, *keys: str) -> DataFrame:
    """keys, position, label, amount, shown: a row for each line that is printed."""
    return df.select(*keys, F.explode(printed_lines()).alias("line")).select(*keys, "line.*")
