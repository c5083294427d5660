"""Scalar rules of booking records as Column -> Column functions.

Text results use the empty string for "nothing", as records do at their edges.
Classes such as ``\\d`` are Unicode here (``(?U)``), and trimming takes all
white space, not only spaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as travel papers print them, in calendar order.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# Patterns of dates and times in the text of travel papers.
NUMERIC_DATE = r"(?U)\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"
WORD_DATE = r"(?U)\b(\d{1,2})\s*(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s*(\d{2,4})\b"
CLOCK = r"(?U)\b([01]?\d|2[0-3])[:.]([0-5]\d)\b"


# How many characters of a text are kept where it is shown.
CUTS = {"excerpt": 1200, "caption": 1024, "error": 200, "summary": 24, "label": 28, "city": 24, "code": 2953}


def cut(c: Column, what: str) -> Column:
    """The beginning of a text, as long as ``CUTS`` says."""
    return F.substring(c, 1, CUTS[what])


def text(c: Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs], F.lit(""))


def time_token(c: Column) -> Column:
    """``9.05`` -> ``09:05``; empty unless hour and minute are valid."""
    t = strip(F.replace(text(c), F.lit("."), F.lit(":")))
    shape = r"^(\d{1,9})\s*:\s*(\d{1,9})$"
    part = lambda i: F.when(t.rlike(shape), F.regexp_extract(t, shape, i)).try_cast("int")
    usual = t.rlike(r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]$")
    return F.when(usual, t).when((part(1) <= 23) & (part(2) <= 59), F.format_string("%02d:%02d", part(1), part(2))).otherwise("")


def times_in(c: Column) -> Column:
    """All clock times of a text in order, as hh:mm."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(CLOCK), F.lit(0)), time_token)


def date_iso(c: Column) -> Column:
    """First date of a text: day/month/year before ``D MON YYYY``.  The first
    kind that occurs decides, even if it is no real date; ISO is not read."""
    t = text(c)
    # one-element arrays, so that each step's result has a name and is computed once
    found = F.array(F.struct(F.regexp_extract(t, NUMERIC_DATE, 0).alias("numeric"), F.regexp_extract(F.upper(t), WORD_DATE, 0).alias("worded")))

    def parts(x: Column) -> Column:
        of = lambda i, other: F.when(x["numeric"] != "", F.regexp_extract(x["numeric"], NUMERIC_DATE, i)).when(x["worded"] != "", other).try_cast("int")
        word = lambda i: F.regexp_extract(x["worded"], WORD_DATE, i)
        month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word(2)).cast("string")
        return F.struct(of(1, word(1)).alias("day"), of(2, month_no).alias("month"), of(3, word(3)).alias("year"))

    def iso(d: Column) -> Column:
        full = F.when(d["year"] < 100, d["year"] + 2000).otherwise(d["year"])
        made = F.when(d["month"].between(1, 12) & d["day"].between(1, 31), F.try_to_date(F.format_string("%04d-%02d-%02d", full, d["month"], d["day"]), "yyyy-MM-dd"))
        return text(F.date_format(made, "yyyy-MM-dd"))

    some = F.filter(found, lambda x: (x["numeric"] != "") | (x["worded"] != ""))
    return text(F.get(F.transform(F.transform(some, parts), iso), 0))


def messaging_number(c: Column) -> Column:
    """Digits with country code: ten digits (or eleven from 0) get 91."""
    digits = F.regexp_replace(text(c), r"[^0-9]", "")
    n = F.length(digits)
    local = F.when((n == 11) & digits.startswith("0"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when((n < 10) | (n > 15), F.lit("")).when(F.length(local) == 10, F.concat(F.lit("91"), local)).otherwise(local)


def minutes_before(c: Column, minutes: int = 60) -> Column:
    """Check-in cutoff: hh:mm so many minutes earlier, past midnight backwards."""
    at = F.try_to_timestamp(blank_to_null(c), F.lit("H:m"))
    return text(F.date_format(at - F.expr(f"interval {int(minutes)} minutes"), "HH:mm"))


def date_display(c: Column) -> Column:
    """``2026-5-6`` -> ``Wed, 06 May 2026``; what is no date stays as it is."""
    return F.coalesce(F.date_format(F.try_to_date(blank_to_null(c), "yyyy-M-d"), "EEE, dd MMM yyyy"), text(c))


def booking_date_display(c: Column, as_of: Column) -> Column:
    """As :func:`date_display`, and the date ``as_of`` where nothing is given."""
    return first_filled(date_display(c), F.date_format(as_of, "EEE, dd MMM yyyy"))


def money(c: Column) -> Column:
    return F.concat(F.lit("INR "), F.format_number(c, 2))


def amount_text(c: Column) -> Column:
    """A captured amount without its thousands separators."""
    return F.replace(c, F.lit(","), F.lit(""))


def title_case(c: Column) -> Column:
    """Each run of letters begins with a capital (``o'neil`` -> ``O'Neil``)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s{2,}", " ")


def platform_code(c: Column) -> Column:
    """Booking-id prefix: six letters or digits at most, ``AT`` if none."""
    return first_filled(F.substring(F.regexp_replace(F.upper(text(c)), r"[^\p{L}\p{N}]", ""), 1, 6), F.lit("AT"))


def booking_id(code: Column, day: Column, number: Column) -> Column:
    """``CODE-YYYYMMDD-NNNN``; numbers beyond four digits are not cut."""
    return F.format_string("%s-%s-%04d", code, F.date_format(day, "yyyyMMdd"), number)


def document_number(prefix: Column, *key: Column) -> Column:
    """Airline prefix and ten digits drawn from a hash of ``key``."""
    return F.concat(F.coalesce(prefix, F.lit("000")), F.lit("-"), F.lpad(F.pmod(F.xxhash64(*key), F.lit(10_000_000_000)).cast("string"), 10, "0"))


_HALF, _ROUNDS, _PRIME = 100_000, 6, 2_147_483_647


def round_keys(key: str) -> list[int]:
    """A number below a million for each round of :func:`scrambled`."""
    return [int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "big") % 1_000_000 for i in range(_ROUNDS)]


def _rounds(number: Column, keys: list[int], step: Callable[[Column, Column, Column], tuple[Column, Column]]) -> Column:
    """A Feistel network on the two halves of a number of ten digits; ``step`` has
    (left, right, what the round's key makes of the one that stays)."""
    n = F.when(number.between(0, _HALF * _HALF - 1), number.cast("long"))
    halves = F.struct(F.floor(n / _HALF).cast("long").alias("l"), (n % _HALF).alias("r"))
    stirred = lambda half, key: (half + key) * (half + key) % _PRIME * (half + key) % _PRIME % _HALF

    def once(at: Column, key: Column) -> Column:
        left, right = step(at["l"], at["r"], lambda half: stirred(half, key))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in keys]), halves, once, lambda at: at["l"] * _HALF + at["r"])


def scrambled(number: Column, key: str) -> Column:
    """Another number of ten digits, by a keyed permutation: different numbers from 0 to
    10**10 - 1 never meet.  Null beyond.  It hides the order from a reader, not from an
    attacker."""
    return _rounds(number, round_keys(key), lambda left, right, stir: (right, (left + stir(right)) % _HALF))


def unscrambled(number: Column, key: str) -> Column:
    """The number that :func:`scrambled` made this one of."""
    return _rounds(number, round_keys(key)[::-1], lambda left, right, stir: (F.pmod(right - stir(left), F.lit(_HALF)), left))


def numbered_document(prefix: Column, number: Column, key: str) -> Column:
    """Airline prefix and ten digits that belong to this number alone (null beyond ten digits)."""
    return F.concat(F.coalesce(prefix, F.lit("000")), F.lit("-"), F.lpad(scrambled(number, key).cast("string"), 10, "0"))


def span_text(seconds: Column) -> Column:
    """``Hh Mm (Long layover)`` from three hours on, else ``(Short layover)``."""
    hours, minutes = F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long")
    return F.format_string("%dh %dm (%s)", hours, minutes, F.when(hours >= 3, "Long layover").otherwise("Short layover"))


def place(city: Column, code: Column) -> Column:
    return F.when(text(city) != "", F.concat(city, F.lit(" ("), code, F.lit(")"))).otherwise(code)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def payment_text(method: Column, last_digits: Column) -> Column:
    shown = method.isin("Credit Card", "Debit Card") & (text(last_digits) != "")
    return F.concat(F.lit("Paid via "), method, F.when(shown, F.concat(F.lit(" ending in "), last_digits)).otherwise(""))


def code_text(pnr: Column, booking: Column, route: Column, travellers: Column) -> Column:
    """Content of a paper's square code, cut at what such a code can hold."""
    whole = F.concat(F.lit("PNR:"), text(pnr), F.lit("|BOOKING:"), text(booking), F.lit("|ROUTE:"), text(route), F.lit("|PAX:"), travellers.cast("string"))
    return cut(whole, "code")


def file_stem(pnr: Column, booking: Column) -> Column:
    return first_filled(pnr, booking, F.lit("output"))


def logo_url(iata: Column, template: str = "https://example.com/airlines/64/%s.png") -> Column:
    return F.format_string(template, iata)


def segments_badge(n: Column) -> Column:
    """``1 SEGMENT``, ``2 SEGMENTS``; none is a plural here."""
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" SEGMENT")).otherwise(" SEGMENTS"))


def segments_heading(n: Column) -> Column:
    """``1 Segment``, ``2 Segments``; none is a singular here."""
    return F.concat(n.cast("string"), F.when(n > 1, F.lit(" Segments")).otherwise(" Segment"))


def by_segment(values: Column, default: str, separator: str = "\n") -> Column:
    """``Flight k: v`` for each value, the default where it is blank."""
    return F.array_join(F.transform(values, lambda v, i: F.concat(F.lit("Flight "), (i + 1).cast("string"), F.lit(": "), first_filled(v, F.lit(default)))), separator)


def grid_place(i: Column, width: int = 3) -> Column:
    """Row and column of the i-th field (from 0) of a grid, as a struct."""
    return F.struct(F.floor(i / width).cast("int").alias("row"), (i % width).cast("int").alias("col"))


def no_refund(status: Column) -> Column:
    """Whether a refund status has to stand out."""
    return F.coalesce(F.contains(status, F.lit("Non-Refundable")), F.lit(False))


def message_id(response: Column) -> Column:
    """Id of the first message of a JSON answer, empty if there is none."""
    return first_filled(F.get_json_object(response, "$.messages[0].id"))


def error_text(body: Column) -> Column:
    """What a JSON error says, else the beginning of the body."""
    return F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.error"), cut(text(body), "error"))


def as_json(*columns: str) -> Column:
    """The row's columns, nested ones too, as one JSON object."""
    return F.to_json(F.struct(*columns))
