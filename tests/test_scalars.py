"""Each rule with the cases that tell it from a near miss."""

import datetime

import pytest
from pyspark.sql import functions as F

from waybill.functions import scalars as S


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


CASES = [
    (S.time_token, {"9.05": "09:05", "24:00": "", "7": "", "23:59": "23:59", "12:60": "", " 7:5 ": "07:05", "": "", None: "", "a:b": ""}),
    (S.date_iso, {"3/4/26": "2026-04-03", "31/02/2026": "", "2026-05-21": "", "on 6 May 2026": "2026-05-06", "06MAY26": "2026-05-06", "1-2-2024 3 MAR 2025": "2024-02-01", "": "", None: ""}),
    (S.messaging_number, {"9876543210": "919876543210", "09876543210": "919876543210", "987654321": "", "12345678901": "12345678901", "+91 98765 43210": "919876543210", "1" * 16: "", None: ""}),
    (S.minutes_before, {"00:30": "23:30", "": "", "9:05": "08:05", "25:00": "", None: ""}),
    (S.date_display, {"2026-5-6": "Wed, 06 May 2026", "soon": "soon", "": "", None: ""}),
    (S.title_case, {"o'neil MARY-ann": "O'Neil Mary-Ann", "éVA à": "Éva À", "": ""}),
    (S.platform_code, {"make my trip": "MAKEMY", "!!": "AT", "": "AT", None: "AT", "é1": "É1"}),
    (S.collapse_spaces, {"a  b\t\tc d": "a b c d"}),
    (S.amount_text, {"27,138.50": "27138.50", ",": ""}),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_text_rules(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_times_in(spark):
    assert values(spark, S.times_in, ["at 9:05 to 18.40, not 24:00 or 7:61"]) == [["09:05", "18:40"]]


def test_money_rounds_half_even_on_exact_halves(spark):
    assert values(spark, S.money, [0.125, 1234567.5, -3.0, 0.375], "double") == ["INR 0.12", "INR 1,234,567.50", "INR -3.00", "INR 0.38"]


def test_span_text(spark):
    assert values(spark, S.span_text, [10 * 3600 + 20 * 60, 3 * 3600, 3599], "long") == ["10h 20m (Long layover)", "3h 0m (Long layover)", "0h 59m (Short layover)"]


def test_booking_numbers_beyond_four_digits_are_whole(spark):
    day = F.lit(datetime.date(2026, 5, 6))
    assert values(spark, lambda n: S.booking_id(F.lit("AT"), day, n), [1, 12345], "long") == ["AT-20260506-0001", "AT-20260506-12345"]


def test_document_number_repeats_for_its_key(spark):
    a = values(spark, lambda k: S.document_number(F.lit("098"), k), ["x", "x", "y"])
    assert a[0] == a[1] != a[2] and len(a[0]) == 14 and a[0].startswith("098-")


def test_first_filled_takes_empty_as_nothing(spark):
    df = spark.createDataFrame([("", None, "c"), (None, "b", "c"), (None, None, "")], "a string, b string, c string")
    assert [r[0] for r in df.select(S.first_filled(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["c", "b", ""]


def test_payment_and_code_text(spark):
    df = spark.createDataFrame([("Credit Card", "1234"), ("Credit Card", ""), ("UPI", "1234")], "m string, d string")
    assert [r[0] for r in df.select(S.payment_text(F.col("m"), F.col("d"))).collect()] == ["Paid via Credit Card ending in 1234", "Paid via Credit Card", "Paid via UPI"]
    long = spark.range(1).select(F.length(S.code_text(F.lit("P" * 4000), F.lit(""), F.lit("r"), F.lit(1)))).first()[0]
    assert long == 2953
