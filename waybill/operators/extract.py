"""Text of a travel paper to a typed record, as column expressions in one projection.

Lines are an array, so the whole record of a document is computed in its own
row without a shuffle.  ``\\b``, ``\\d`` and ``\\s`` are Unicode in the patterns.

Expressions inside lambdas are evaluated as often as they are written, so the
segments of lines come from a chain of small transforms: each finds one thing
and hands it on as a field, and later ones look at the few lines that are left.
Lambdas are interpreted, so a filter first leaves out the lines that can tell no
segment, and a pattern is not tried where a text lacks a word that it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.scalars import amount_text, blank_to_null, collapse_spaces, contains_any, cut, date_iso, first_filled, strip, text, time_token, times_in, title_case
from waybill.operators.lookups import first_keyword
from waybill.sources import dims

# What fields look like in upper-cased text.
PNR = (r"(?U)\bPNR\b\s*[:\-]?\s*([A-Z0-9]{5,8})", r"(?U)\bBOOKING\s*REF(?:ERENCE)?\b\s*[:\-]?\s*([A-Z0-9]{5,10})")
BOOKING_ID = (
    r"(?U)\bBOOKING\s*ID\b\s*[:\-]?\s*([A-Z0-9\-]{5,20})",
    r"(?U)\bTRIP\s*ID\b\s*[:\-]?\s*([A-Z0-9\-]{5,20})",
    r"(?U)\bORDER\s*ID\b\s*[:\-]?\s*([A-Z0-9\-]{5,20})",
    r"(?U)\bTRANSACTION\s*ID\b\s*[:\-]?\s*([A-Z0-9\-]{5,20})",
)
BOOKING_DATE = r"(?U)(?:BOOKING DATE|BOOKED ON|DATE OF BOOKING|ISSUE DATE)\s*[:\-]?\s*([0-9A-Za-z /-]{6,})"
BOOKED_ON = r"(?U)BOOKED ON\s+(\d{1,2}\s+[A-Z]{3}\s+\d{4})"
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?U)\b\+?\d[\d\s\-]{8,}\d\b"
TOTAL = r"(?U)\b(?:TOTAL(?: AMOUNT)?|GRAND TOTAL|AMOUNT PAID|TOTAL FARE)\b[^0-9]{0,15}([0-9,]+(?:\.\d{1,2})?)"
BASE = r"(?U)\b(?:BASE FARE|FARE)\b[^0-9]{0,12}([0-9,]+(?:\.\d{1,2})?)"
TAXES = r"(?U)\b(?:TAX|TAXES|FEES|TAXES AND FEES)\b[^0-9]{0,12}([0-9,]+(?:\.\d{1,2})?)"
TITLED = r"(?U)\b(?:MR|MRS|MS|MISS|MSTR|CHD|INF)\.?\s+([A-Z][A-Z\s']{2,40})\b"
FLIGHT_NUMBER = r"(?U)\b([A-Z]{2,3})\s?-?\s?(\d{2,4})\b"
FLIGHT_IN_LINE = r"(?U)\b([A-Z]{2,3})\s?-?\s?(\d{3,4})\b"
ROUTE_TIMES = r"(?U)\b([A-Z]{3})\s+([0-2]\d[:.][0-5]\d)\b.*?\b([0-2]\d[:.][0-5]\d)\b\s+([A-Z]{3})\b"
CODE_NUMBER = r"(?U)\b[A-Z]{2,3}\s?\d{2,4}\b"
ROUTE = r"(?U)\b([A-Z]{3})\s*[-–]\s*([A-Z]{3})\b"
FROM_TO = r"(?U)\bFROM\b[^A-Z]{0,10}([A-Z]{3})\b.*\bTO\b[^A-Z]{0,10}([A-Z]{3})\b"
THREE_LETTERS = r"(?U)\b[A-Z]{3}\b"
LAST_THREE = r"(?U)[A-Z]{3}\b"
HOUR_MINUTE = r"(?U)[0-2]\d[:.][0-5]\d"
TITLE = r"(?:M(?:R|S|ISS)|CHD|INF)"  # the beginnings of what TITLED begins with
LINE_BREAKS = r"(?U)(?<!\s)[\s&&[^\n\x0B\f\r\x85\u2028\u2029]]*+[\n\x0B\f\r\x85\u2028\u2029\x1c\x1d\x1e][\s\x1c\x1d\x1e]*+"
OUTER_BLANKS = r"(?U)\A[\s\x1c\x1d\x1e]++|(?<![\s\x1c\x1d\x1e])[\s\x1c\x1d\x1e]++\z"

# Words of which each pattern needs one.
NEEDED = {
    PNR[0]: ("PNR",), PNR[1]: ("REF",), BOOKING_ID[0]: ("BOOKING",), BOOKING_ID[1]: ("TRIP",), BOOKING_ID[2]: ("ORDER",), BOOKING_ID[3]: ("TRANSACTION",),
    BOOKING_DATE: ("BOOKING DATE", "BOOKED ON", "DATE OF BOOKING", "ISSUE DATE"), EMAIL: ("@",), TOTAL: ("TOTAL", "AMOUNT PAID"), BASE: ("FARE",), TAXES: ("TAX", "FEES"),
}

STOP = tuple(dims.STOPWORDS.split())
SEGMENT = "struct<from_code:string,to_code:string,date:string,dep_time_raw:string,arr_time_raw:string,flight_no:string,airline:string>"


def lines_of(c: Column) -> Column:
    """Stripped lines that are not blank."""
    whole = F.regexp_replace(F.regexp_replace(text(c), OUTER_BLANKS, ""), LINE_BREAKS, "\n")
    return F.array_remove(F.split(whole, "\n"), "")


def adjacent(lines: Column, uppers: Column | None = None) -> Column:
    """Array of (u, next, line): each line in upper case, what follows it, and as it is.
    ``uppers``: the lines in upper case, where a column has them."""
    if uppers is None:
        return F.transform(lines, lambda x, i: F.struct(F.upper(x).alias("u"), F.upper(F.coalesce(F.get(lines, i + 1), F.lit(""))).alias("next"), x.alias("line")))
    return F.transform(uppers, lambda u, i: F.struct(u.alias("u"), F.coalesce(F.get(uppers, i + 1), F.lit("")).alias("next"), F.get(lines, i).alias("line")))


def first_phone(c: Column) -> Column:
    """The first run that has ten to thirteen digits, empty if none has."""
    digits = lambda x: F.length(F.regexp_replace(x, r"(?U)\D", ""))
    found = F.filter(F.regexp_extract_all(c, F.lit(PHONE), F.lit(0)), lambda x: digits(x).between(10, 13))
    return F.coalesce(strip(F.get(found, 0)), F.lit(""))


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def gated(c: Column, pattern: str, group: int = 1) -> Column:
    """As :func:`capture`; the pattern is tried where one of the words occurs that it needs."""
    return F.when(contains_any(c, NEEDED[pattern]), capture(c, pattern, group)).otherwise("")


def first_capture(c: Column, patterns: tuple[str, ...]) -> Column:
    """First pattern whose first match has a digit and five characters or more."""
    found = F.filter(F.array(*[strip(gated(c, p)) for p in patterns]), lambda v: v.rlike(r"(?U)\d") & (F.length(v) >= 5))
    return F.coalesce(F.get(found, 0), F.lit(""))


def _map(rows: list[tuple[str, str]]) -> Column:
    """A small fixed table as a map literal."""
    return F.create_map(*[F.lit(x) for row in rows for x in row])


def _get(table: Column, key: Column) -> Column:
    return F.try_element_at(table, key)


def airline_code(flight_no: Column) -> Column:
    """As :func:`waybill.operators.lookups.with_airline_code`, inside arrays."""
    airline, alias = [k for k, _ in dims.airline_rows()], dims.alias_rows()
    known = lambda k: F.when(k.isin(*airline), k).when(k.isin(*[a for a, _ in alias]), _get(_map(alias), k))  # noqa: E731  # a set first: maps are searched from end to end
    c = F.regexp_replace(F.upper(flight_no), "[^A-Z0-9]", "")
    return F.coalesce(known(F.substring(c, 1, 3)), known(F.substring(c, 1, 2)), F.substring(c, 1, 2))


def airline_name(flight_no: Column) -> Column:
    return F.coalesce(_get(_map(dims.airline_rows()), airline_code(flight_no)), F.lit(""))


def _no_stop(words: Column) -> Column:
    return ~F.exists(words, lambda w: w.isin(*STOP))


def records(texts: DataFrame, airport_codes: list[str] | None = None, own_names: tuple[str, ...] = (), always_own: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``texts`` (filename, text, ...) and the record's fields.

    ``airport_codes`` is the known airports' code list (an airport dimension is
    some thousands of rows); without it no bare code counts as an airport.
    A text with one of ``own_names`` and no platform is our own paper and gives a
    blank record, and so do a text with one of ``always_own``, whatever its
    platform, and one that has no platform and no word of ``dims.RELEVANT``."""
    df = texts.select("filename", "text", F.struct(*texts.columns).alias("__caller"))  # whatever it holds, no name of its columns matters here
    df = df.withColumn("__text", text(F.col("text"))).withColumn("__up", F.upper("__text"))
    df = df.withColumn("__lines", lines_of(F.col("text")))
    up, lines = F.col("__up"), F.col("__lines")
    haystack = F.concat(up, F.lit(" "), F.upper(text(F.col("filename"))))
    df = df.withColumn("booking_platform", first_keyword(haystack))
    named = lambda names: contains_any(up, tuple(n.upper() for n in names)) if names else F.lit(False)
    platform = F.col("booking_platform")
    df = df.withColumn("__blank", (platform == "") & (named(own_names) | ~contains_any(up, dims.RELEVANT)) | named(always_own))

    df = df.withColumn("__uppers", F.transform(lines, F.upper))
    uppers = F.col("__uppers")
    df = df.withColumn("__after", adjacent(lines, uppers))
    paytm_pnr = F.transform(
        F.filter("__after", lambda x: F.contains(x["u"], F.lit("FLIGHT PNR")) & (F.size(F.regexp_extract_all(x["next"], F.lit("[A-Z0-9]{5,8}"), F.lit(0))) > 0)),
        lambda x: F.try_element_at(F.regexp_extract_all(x["next"], F.lit("[A-Z0-9]{5,8}"), F.lit(0)), F.lit(-1)),
    )
    df = df.withColumn("pnr", F.when(platform == "Paytm", F.coalesce(F.try_element_at(paytm_pnr, F.lit(-1)), first_capture(up, PNR))).otherwise(first_capture(up, PNR)))
    df = df.withColumn("booking_id", first_capture(up, BOOKING_ID))
    df = df.withColumn("__labelled", gated(up, BOOKING_DATE))  # a column, since a date names its text many times
    labelled = date_iso(F.col("__labelled"))
    booked_lines = F.filter(F.transform(F.filter("__after", lambda x: F.contains(x["u"], F.lit("BOOKED ON"))), lambda x: date_iso(x["line"])), lambda d: d != "")
    df = df.withColumn("booking_date", first_filled(labelled, F.when(platform == "Paytm", F.get(booked_lines, 0)).when(platform == "MakeMyTrip", date_iso(capture(up, BOOKED_ON)))))
    df = df.withColumns({
        "customer_email": gated(up, EMAIL, 0),
        "customer_phone": first_phone(F.col("__text")),
        "total_fare": amount_text(gated(up, TOTAL)),
        "base_fare": amount_text(gated(up, BASE)),
        "taxes_fees": amount_text(gated(up, TAXES)),
    })

    # travellers
    identity = (platform != "") | (F.col("pnr") != "") | (F.col("booking_id") != "")
    own_words = tuple(w for n in (*own_names, *always_own) for w in n.upper().split())
    plain = F.filter(uppers, lambda u: u.rlike(TITLE) & ~u.rlike(r"(?U)\d") & ~contains_any(u, dims.NO_NAME_LINE + own_words))
    names = F.filter(F.transform(plain, lambda u: strip(collapse_spaces(capture(u, TITLED)))), lambda n: n != "")
    words = lambda n: F.filter(F.split(n, r"(?U)\s+"), lambda w: w != "")
    names = F.array_distinct(F.transform(F.filter(names, lambda n: n.rlike(r"(?U)\s") & _no_stop(words(n))), title_case))
    titled = F.when(identity | contains_any(up, ("TRAVELLER", "PASSENGER")), names).otherwise(F.array().cast("array<string>"))
    loose = F.filter("__after", lambda x: ~contains_any(x["u"], dims.HEAD_LINE) & x["u"].rlike(r"(?U)\b[A-Z]{2,}\b") & (F.size(words(x["u"])) <= 4) & _no_stop(words(x["u"])))
    df = df.withColumn("__titled", titled)
    found = F.when(F.size("__titled") > 0, F.col("__titled")).when(identity, F.transform(loose, lambda x: title_case(x["line"]))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("passengers", F.transform(found, lambda n: F.struct(n.alias("name"))))

    # flight numbers and segments
    alias, airline = dims.alias_rows(), [k for k, _ in dims.airline_rows()]
    hits = F.transform(F.regexp_extract_all("__up", F.lit(FLIGHT_NUMBER), F.lit(0)), lambda x: F.struct(capture(x, FLIGHT_NUMBER, 1).alias("c"), capture(x, FLIGHT_NUMBER, 2).alias("n")))
    hits = F.transform(hits, lambda h: F.struct(F.when(h["c"].isin(*[a for a, _ in alias]), _get(_map(alias), h["c"])).otherwise(h["c"]).alias("c"), h["n"].alias("n")))
    df = df.withColumn("__numbers", F.array_distinct(F.transform(F.filter(hits, lambda h: h["c"].isin(*airline)), lambda h: F.concat(h["c"], F.lit(" "), h["n"]))))
    df = _segments(df, airport_codes or [])
    df = df.withColumn("__segments", F.when(~identity & (F.size("__segments") > 6), F.array().cast(f"array<{SEGMENT}>")).otherwise(F.col("__segments")))
    key = lambda s: F.concat_ws("|", *[text(s[f]) for f in ("from_code", "to_code", "dep_time_raw", "arr_time_raw", "flight_no")])  # noqa: E731  # no field has a bar
    keys = F.transform("__segments", key)
    df = df.withColumn("__keys", keys)
    df = df.withColumn("__segments", F.when(F.size("__keys") > 1, F.filter("__segments", lambda s, i: F.array_position("__keys", F.get("__keys", i)) == i + 1)).otherwise(F.col("__segments")))
    empty = F.lit(None).cast(SEGMENT)
    df = df.withColumn("__segments", F.when(F.size("__segments") == 0, F.transform("__numbers", lambda n: empty)).otherwise(F.col("__segments")))
    number = lambda i: F.get("__numbers", i)
    df = df.withColumn("flights", F.transform("__segments", lambda s, i: F.struct(
        *[s[f].alias(f) for f in ("from_code", "to_code", "date", "dep_time_raw", "arr_time_raw")],
        F.coalesce(number(i), s["flight_no"]).alias("flight_no"),
        F.when(number(i).isNotNull(), airline_name(number(i))).otherwise(s["airline"]).alias("airline"),
    )))
    fields = ("booking_platform", "pnr", "booking_id", "booking_date", "customer_email", "customer_phone", "base_fare", "taxes_fees", "total_fare")
    blank = F.col("__blank")
    out = [F.when(blank, F.lit("")).otherwise(F.col(f)).alias(f) for f in fields]
    out += [F.when(blank, F.array().cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in ("flights", "passengers")]
    return df.select(*[F.col("__caller")[c].alias(c) for c in texts.columns if c not in (*fields, "flights", "passengers", "raw_excerpt")], *out, cut(F.col("__text"), "excerpt").alias("raw_excerpt"))


def _segments(df: DataFrame, known: list[str]) -> DataFrame:
    """``__segments``: what the lines of ``__after`` tell, in order."""
    u = lambda x: x["u"]
    keep = lambda x, *names: [x[n].alias(n) for n in names]

    valid = [c for c in known if c not in STOP]
    is_valid = lambda c: c.isin(*valid) if valid else F.lit(False)

    # others tell nothing: times come in the line or the next, and a route without times has known codes
    coded = lambda x: F.exists(F.regexp_extract_all(u(x), F.lit(LAST_THREE), F.lit(0)), is_valid) if valid else F.lit(False)
    df = df.withColumn("__hits", F.filter("__after", lambda x: u(x).rlike(HOUR_MINUTE) | x["next"].rlike(HOUR_MINUTE) | coded(x)))

    # a flight number and a route with its times, in the line or across it and the next
    df = df.withColumn("__hits", F.transform("__hits", lambda x: F.struct(
        *keep(x, "u"), F.when(x["next"] != "", F.concat(u(x), F.lit(" "), x["next"])).otherwise(u(x)).alias("both"),
        capture(u(x), ROUTE_TIMES, 0).alias("route"),
    )))
    df = df.withColumn("__hits", F.transform("__hits", lambda x: F.struct(
        *keep(x, "u", "both"), F.when(x["route"] != "", x["route"]).otherwise(capture(x["both"], ROUTE_TIMES, 0)).alias("route"),
    )))
    df = df.withColumn("__hits", F.transform("__hits", lambda x: F.struct(
        *keep(x, "u", "both", "route"), F.when(x["route"] != "", capture(u(x), FLIGHT_IN_LINE, 0)).otherwise("").alias("flight"),
    )))
    df = df.withColumn("__hits", F.transform("__hits", lambda x: F.struct(
        *keep(x, "u", "route"), F.when((x["route"] != "") & (x["flight"] == ""), capture(x["both"], FLIGHT_IN_LINE, 0)).otherwise(x["flight"]).alias("flight"),
    )))
    df = df.withColumn("__hits", F.transform("__hits", lambda x: F.struct(
        *keep(x, "u", "route"), F.when(x["flight"] != "", F.struct(
            capture(x["flight"], FLIGHT_IN_LINE, 2).alias("number"), F.concat(capture(x["flight"], FLIGHT_IN_LINE, 1), F.lit(" "), capture(x["flight"], FLIGHT_IN_LINE, 2)).alias("flight_no"),
            capture(x["route"], ROUTE_TIMES, 1).alias("first"), capture(x["route"], ROUTE_TIMES, 4).alias("last"),
        )).alias("timed"),
    )))
    timed = lambda x: x["timed"].isNotNull()
    zero = lambda x: timed(x) & F.startswith(x["timed"]["number"], F.lit("0"))
    by_time = lambda x: F.coalesce(timed(x) & ~x["timed"]["first"].isin(*STOP) & ~x["timed"]["last"].isin(*STOP), F.lit(False))
    gate = lambda x: contains_any(u(x), dims.SEGMENT_LINE) | u(x).rlike(CODE_NUMBER)
    df = df.withColumn("__hits", F.filter("__hits", lambda x: ~F.coalesce(zero(x), F.lit(False)) & (by_time(x) | gate(x))))

    # other lines: a named route, or the first two known codes
    df = df.withColumn("__hits", F.transform("__hits", lambda x: F.struct(*keep(x, "u", "route", "timed"), by_time(x).alias("by_time"), F.when(~by_time(x), capture(u(x), ROUTE, 0)).alias("named"))))
    df = df.withColumn("__hits", F.transform("__hits", lambda x: F.struct(
        *keep(x, "u", "route", "timed", "by_time"), F.when(x["named"] != "", F.array(capture(x["named"], ROUTE, 1), capture(x["named"], ROUTE, 2)))
        .when(x["named"] == "", F.array(capture(u(x), FROM_TO, 1), capture(u(x), FROM_TO, 2))).alias("pair"),
    )))
    df = df.withColumn("__hits", F.transform("__hits", lambda x: F.struct(
        *keep(x, "u", "route", "timed", "by_time"), F.when(x["by_time"], F.array().cast("array<string>")).when(is_valid(F.get(x["pair"], 0)) & is_valid(F.get(x["pair"], 1)), x["pair"])
        .otherwise(F.filter(F.regexp_extract_all(u(x), F.lit(THREE_LETTERS), F.lit(0)), is_valid)).alias("pair"),
    )))
    df = df.withColumn("__hits", F.filter("__hits", lambda x: x["by_time"] | (F.size(x["pair"]) >= 2)))

    nothing = F.lit(None).cast("string")
    make = lambda *v: F.struct(*[a.cast("string").alias(n) for a, n in zip(v, ("from_code", "to_code", "date", "dep_time_raw", "arr_time_raw", "flight_no", "airline"), strict=True)])
    df = df.withColumn("__hits", F.transform("__hits", lambda x: F.struct(*keep(x, "u", "route", "timed", "by_time", "pair"), F.when(~x["by_time"], times_in(u(x))).alias("times"))))
    return df.withColumn("__segments", F.transform("__hits", lambda x: F.when(x["by_time"], make(
        x["timed"]["first"], x["timed"]["last"], nothing, time_token(capture(x["route"], ROUTE_TIMES, 2)), time_token(capture(x["route"], ROUTE_TIMES, 3)), x["timed"]["flight_no"], airline_name(x["timed"]["flight_no"]),
    )).otherwise(make(F.get(x["pair"], 0), F.get(x["pair"], 1), blank_to_null(date_iso(u(x))), F.get(x["times"], 0), F.get(x["times"], 1), nothing, nothing))))


def text_status(text_: Column, pnr: Column, booking: Column, platform: Column) -> Column:
    """Why a text cannot be used, null if it can."""
    blank = reduce(lambda a, b: a & b, [text(c) == "" for c in (pnr, booking, platform)])
    return F.when(strip(text(text_)) == "", "empty").when(F.length(strip(text(text_))) < 50, "too short").when(blank, "not a booking")
