"""Operators on small bookings, checked by hand."""

import datetime
import os
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill import session
from waybill.functions import scalars
from waybill.operators import claims, extract, fares, itinerary, keywords, ledger, lookups, place_index, search
from waybill.plans import catalogue
from waybill.session import stored
from waybill.sources import dims, heads, readers

PAPER = """MakeMyTrip Itinerary
Booking ID: AB12CD34EF56, (Booked on 6 May 2026)
PNR: QX7K2M
Mr Test Person
AI 6093 HYD 15:40 to 18:00 DEL
Total Amount INR 27,138.50
Base Fare 20,000 Taxes 7,138.50
"""


def record(spark, text, filename="t.pdf", **more):
    return extract.records(spark.createDataFrame([(filename, text)], "filename string, text string"), ["HYD", "DEL", "BOM"], **more).first().asDict(True)


def test_extracts_a_paper(spark):
    r = record(spark, PAPER)
    assert (r["booking_platform"], r["pnr"], r["booking_id"], r["booking_date"]) == ("MakeMyTrip", "QX7K2M", "AB12CD34EF56", "2026-05-06")
    assert (r["total_fare"], r["base_fare"], r["taxes_fees"]) == ("27138.50", "20000", "7138.50")
    assert [p["name"] for p in r["passengers"]] == ["Test Person"]
    assert [(f["from_code"], f["to_code"], f["dep_time_raw"], f["arr_time_raw"], f["flight_no"], f["airline"]) for f in r["flights"]] == [("HYD", "DEL", "15:40", "18:00", "AI 6093", "Air India")]


def test_irrelevant_and_own_papers_are_blank(spark):
    for text in ("some other text", "", None, "ACME TRAVEL booking PNR: AB1234"):
        r = record(spark, text, own_names=("Acme Travel",))
        assert r["pnr"] == "" and r["flights"] == [] and r["passengers"] == []


def test_quirks_that_callers_see(spark):
    r = record(spark, "PNR: ABCDE\nBooking Ref: XY12Z9\nmail a.b@c.org\nFlight 6E 201 HYD-DEL 3/4/26 09:05 11:10\n")
    assert r["pnr"] == "XY12Z9"  # a match without a digit leads to the next pattern
    assert r["customer_email"] == "A.B@C.ORG"
    assert [(f["from_code"], f["to_code"], f["date"], f["dep_time_raw"], f["arr_time_raw"]) for f in r["flights"]] == [("HYD", "DEL", "2026-04-03", "09:05", "11:10")]


def test_paytm_takes_the_last_token_after_the_heading(spark):
    assert record(spark, "paytm\nFlight PNR\nAI-123 ABC123 ZZ99ZZ\nmore")["pnr"] == "ZZ99ZZ"


def test_lines_that_tell_no_segment_are_left_out_and_texts_read_once(spark):
    r = record(spark, "PNR: AB1234\x1c\n \x1d FROM 1HYD, TO \u00c9DEL\r\nAI 201\x85 HYD 15:40\nsector 18.00 DEL\nROUTE QQQ-DEL\nto BOM \u2013 HYD x")
    assert [(f["from_code"], f["to_code"], f["dep_time_raw"], f["arr_time_raw"], f["flight_no"]) for f in r["flights"]] == [("HYD", "DEL", None, None, "AI 201"), ("BOM", "HYD", None, None, None)]
    df = extract.records(spark.createDataFrame([("t.pdf", PAPER)], "filename string, text string"), ["HYD", "DEL"])
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 22))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.maxPlanStringLength")
    assert plan.count(extract.BOOKING_DATE) <= 1 < len(plan)


def test_repeated_segments_count_once(spark):
    r = record(spark, "PNR: AB1234\nRoute HYD-DEL\nRoute HYD-DEL\nRoute DEL-BOM\n")
    assert [(f["from_code"], f["to_code"]) for f in r["flights"]] == [("HYD", "DEL"), ("DEL", "BOM")]


FORM = {
    "flight_0_flight_no": "AIX 123", "flight_0_from_code": "del", "flight_0_to_code": "BOM", "flight_0_date": "2026-05-21", "flight_0_dep_time_raw": "15:40",
    "flight_0_arr_time_raw": "18:00", "flight_0_seat": "1A", "flight_2_flight_no": "6E-201", "flight_2_from_code": "BOM", "flight_2_to_code": "XXX",
    "flight_2_date": "2026-05-22", "flight_2_dep_time_raw": "04:20", "flight_2_seat": "2B", "flight_2_airline": "Mine",
    "pax_10_name": "B", "pax_9_name": "A", "pax_9_seat_0": "9Z",
}


@pytest.fixture(scope="module")
def form(spark):
    return readers.form_values(spark.createDataFrame([("r1", FORM), ("r2", {"flight_count": "2", "pax_count": "1"})], "request_id string, form map<string,string>"))


def test_flights(spark, form):
    rows = [r.asDict() for r in itinerary.flights(form, spark, dims.airports(spark)).where("request_id = 'r1'").orderBy("position").collect()]
    assert [r["airline_code"] for r in rows] == ["IX", "6E"] and [r["airline"] for r in rows] == ["Air India Express", "Mine"]
    assert [r["from_full"] for r in rows] == ["Delhi (DEL)", "Mumbai (BOM)"] and rows[1]["to_full"] == "XXX"
    assert [r["layover"] for r in rows] == [None, "10h 20m (Long layover)"]
    assert rows[0]["checkin_closing"] == "14:40" and rows[0]["date"] == "Thu, 21 May 2026"


def test_requests_without_flights_use_their_count(spark, form):
    assert itinerary.flights(form, spark, dims.airports(spark)).where("request_id = 'r2'").count() == 2


def test_travellers_are_in_numeric_order_and_take_seats_by_precedence(spark, form):
    f = itinerary.flights(form, spark, dims.airports(spark))
    rows = itinerary.travellers(form, f).where("request_id = 'r1'").orderBy("pax").collect()
    assert [r["name"] for r in rows] == ["A", "B"]
    assert [r["seat_by_flight"] for r in rows] == [["9Z", "2B"], ["1A", "2B"]]
    assert rows[0]["meal_by_flight"] == ["Not selected"] * 2
    old = itinerary.travellers(form, f, positional=True).where("request_id = 'r1'").orderBy("pax").collect()
    assert [r["seat_by_flight"] for r in old] == [["9Z", ""], ["1A", ""]]


def test_route_summary(spark, form):
    r = itinerary.route_summary(itinerary.flights(form, spark, dims.airports(spark))).where("request_id = 'r1'").first()
    assert (r["route"], r["flight_nos"], r["segments"]) == ("DEL → XXX", "AIX 123, 6E-201", 2)


def test_segment_pnrs(spark):
    df = spark.createDataFrame([(["A", "", "C"],)], "p array<string>")
    assert df.select(itinerary.segment_pnrs(F.col("p"))).first()[0] == "Flight 1: A | Flight 3: C"


def test_fares_are_all_or_nothing(spark):
    rows = [("10", "2.5", None, None, None, None, None, "1"), ("10", "", None, None, None, None, None, None), ("1d", "1", None, None, None, None, None, None)]
    out = fares.parsed_fares(spark.createDataFrame(rows, ", ".join(f"{p} string" for p in fares.PARTS))).select(fares.total_fare()).collect()
    assert [r[0] for r in out] == [11.5, 0.0, 0.0]


def test_fare_lines_keep_the_two_that_are_always_shown(spark):
    df = fares.parsed_fares(spark.createDataFrame([(1, "0", "0", None, "5", None, None, None, "2")], "k int, " + ", ".join(f"{p} string" for p in fares.PARTS)))
    assert [(r["label"], r["shown"]) for r in fares.fare_lines(df, "k").orderBy("position").collect()] == [("Base Fare", "INR 0.00"), ("Airline Taxes & Fees", "INR 0.00"), ("Meals", "INR 5.00"), ("Discount", "INR -2.00")]


def places(spark, rows):
    return spark.createDataFrame([(c, t, a, "", i) for i, (c, t, a) in enumerate(rows)], dims.AIRPORT_SCHEMA)


def test_search_ranks_and_breaks_ties_by_order(spark):
    p = places(spark, [("AAB", "x", "y"), ("ZZZ", "Aab City", "y"), ("QQQ", "x", "big aab field"), ("AABX", "x", "y"), ("Q_Q", "x", "y")])
    assert [(r["code"], r["priority"]) for r in search.top_matches(p, " aab ").collect()] == [("AAB", 0), ("AABX", 1), ("ZZZ", 2), ("QQQ", 3)]
    assert search.top_matches(p, "").count() == 0 and search.top_matches(p, "%").count() == 0
    assert [r["code"] for r in search.top_matches(p, "_Q").collect()] == []


def test_search_with_early_exit_misses_later_matches(spark):
    p = places(spark, [(f"C{i:02d}", "Xcity", "n") for i in range(40)] + [("X", "late", "n")])
    assert search.top_matches(p, "x").first()["code"] == "X"
    assert "X" not in [r["code"] for r in search.top_matches(p, "x", scan_limit=30).collect()]


def test_batch_search_equals_single_searches(spark):
    p = places(spark, [("AAB", "Bcity", "an aab"), ("BAA", "Aab", ""), ("ABA", "", "aaa")])
    asked = ["a", "aab", "b", "ba", "zz", "", "aa"]
    got = search.batch_matches(p, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")).orderBy("query_id", "rank").collect()
    want = [(i, r["code"], r["priority"]) for i, q in enumerate(asked) for r in search.top_matches(p, q).collect()]
    assert [(r["query_id"], r["code"], r["priority"]) for r in got] == want


def test_batch_search_reads_all_parts(spark):
    from waybill.plans import catalogue

    data = "/root/testdata/sf0.01"
    parts = [(r["p_brand"].upper(), r["p_type"].upper(), r["p_name"].upper(), r["p_partkey"]) for r in catalogue.table(spark, data, "part").collect()]
    want = {}
    for q in {r["query"].upper() for r in catalogue._searches(spark, data).select("query").distinct().collect()}:
        ranks = ((0 if c == q else 1 if c.startswith(q) else 2 if t.startswith(q) else 3 if q in n else None, k, c) for c, t, n, k in parts)
        want[q] = [(i, p, c) for i, (p, _, c) in enumerate(sorted(x for x in ranks if x[0] is not None)[:15], 1)]
    got = {}
    for r in catalogue.search_batch_all(spark, data).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["priority"], r["code"]))
    asked = {r["query_id"]: r["query"].upper() for r in catalogue._searches(spark, data).collect()}
    assert len(parts) > 200 and got == {i: want[q] for i, q in asked.items() if want[q]}


def test_airline_codes(spark):
    df = spark.createDataFrame([("AIX 123",), ("6E-201",), ("ZZ9",), ("",), (None,)], "flight_no string")
    got = {r[0]: r[1] for r in lookups.with_airline_code(df, spark).collect()}
    assert got == {"AIX 123": "IX", "6E-201": "6E", "ZZ9": "ZZ", "": "", None: ""}


def test_dimensions(spark):
    payload = dims.airline_payload(spark)
    assert payload.count() == 195 and payload.where("alias_of IS NOT NULL").count() == 96
    assert payload.select("code").distinct().count() == 195
    assert len(dims.STOPWORDS.split()) == len(set(dims.STOPWORDS.split())) == 51


def test_ledger_numbers_and_append(spark, tmp_path):
    path = str(tmp_path / "ledger")
    spark.createDataFrame([], readers.LEDGER_SCHEMA).write.parquet(path)
    assert ledger.next_booking_id(readers.ledger(spark, path), F.lit("ab"), F.lit("2026-05-06").cast("date")).first()[0] == "AB-20260506-0001"
    names = [f.name for f in readers.ledger(spark, path).schema.fields]
    rows = spark.range(5).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in readers.ledger(spark, path).schema.fields if f.name not in ("sno", "booking_id")], F.col("id").cast("string").alias("booking_id"), (F.col("id") == 2).alias("is_dummy"))
    ledger.append(spark, rows, path, ["booking_id"])
    ledger.append(spark, rows, path, ["booking_id"])
    got = readers.ledger(spark, path)
    assert sorted(r["sno"] for r in got.collect()) == list(range(1, 9)) and got.columns == names


def test_numbering_over_many_partitions(spark):
    n = ledger.numbered(spark.range(1000).repartition(7), ["id"])
    assert all(r["sno"] == r["id"] + 1 for r in n.collect())


def test_numbering_of_wide_rows_over_coalesced_partitions(spark):
    """Range partitions that adaptive execution puts together, and rows much wider than their order."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "400k"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        tables = []
        got = ledger.numbered(rows, ["id"], start=5, put=lambda df, name: tables.append(stored(df, name)) or tables[0])
        assert got.count() == got.select("sno").distinct().count() == 60_000
        assert got.where("sno <> id + 6").isEmpty() and got.columns == ["id", "wide", "sno"]
        assert tables[0].select(F.shiftright(tables[0].columns[-1], 33)).distinct().count() > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stream_numbers_go_on_through_batches(spark, tmp_path):
    from waybill.streaming.ledger_stream import append_stream

    for i in range(3):
        spark.createDataFrame([(f"{i}{x}", False) for x in "abc"], "booking_id string, is_dummy boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("booking_id string, is_dummy boolean").parquet(str(tmp_path / "in"))
        append_stream(source, str(tmp_path / "out"), str(tmp_path / "ck"), ["booking_id"]).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("sno").collect()
    assert [(r["booking_id"], r["sno"]) for r in got] == [(f"{i}{x}", 3 * i + k + 1) for i in range(3) for k, x in enumerate("abc")]


def test_first_of_a_repeated_key_counts(spark):
    rows = [("r", 1, "flight_0_flight_no", "B 2"), ("r", 0, "flight_0_flight_no", "A 1"), ("r", 2, "pax_0_name", None), ("r", 3, None, "x"), (None, 0, "flight_1_flight_no", "C")]
    kv = spark.createDataFrame(rows, "request_id string, ord int, key string, value string")
    got = {r["request_id"]: r["flight_no"] for r in itinerary.wide(kv, "flight", itinerary.FLIGHT_FIELDS, "flight_no", "flight_count").collect()}
    assert got == {"r": "A 1", None: "C"}
    assert itinerary.bookings(kv.limit(0), spark, dims.airports(spark), F.current_timestamp()).count() == 0


def test_own_paper_of_a_known_platform_is_blank(spark):
    assert record(spark, PAPER + "Acme Travel", always_own=("Acme Travel",))["pnr"] == ""
    assert record(spark, PAPER + "Acme Travel", own_names=("Acme Travel",))["pnr"] == "QX7K2M"


def test_fallback_names_and_overflowing_routes(spark):
    r = record(spark, "Cleartrip\nGuest list\nANNA PLAIN\nANNA PLAIN\nthe way home\nA B C D E\n")
    assert [p["name"] for p in r["passengers"]] == ["Cleartrip", "Anna Plain", "Anna Plain"]
    seven = "BOARDING\n" + "\n".join(f"ROUTE HYD-DEL {h:02d}:00" for h in range(7))
    assert record(spark, seven)["flights"] == [] and len(record(spark, seven[: seven.rindex("\n")])["flights"]) == 6


def test_settings_of_the_environment_win(spark, tmp_path):
    (tmp_path / "env").write_text("A=1\nB=2\n")
    assert {r["key"]: r["value"] for r in readers.settings(spark, str(tmp_path / "env"), {"B": "set", "C": "x"}).collect()} == {"A": "1", "B": "set"}


def test_settings_and_uploads(spark, tmp_path):
    (tmp_path / "env").write_text("# no\nA = '1=2'\n\nB=x\nA=3\nnothing\n")
    assert {r["key"]: r["value"] for r in readers.settings(spark, str(tmp_path / "env")).collect()} == {"A": "1=2", "B": "x"}
    rows = [(None, 1, b"%PDF"), ("", 1, b"%PDF"), ("a.txt", 1, b"%PDF"), ("a.PDF", 16 << 20, b"%PDF"), ("a.pdf", 4, b"PK.."), ("a.pdf", 4, b"%PDF-1")]
    df = spark.createDataFrame(rows, "filename string, length long, content binary")
    assert [r[0] for r in df.select(readers.upload_error(F.col("filename"), F.col("length"), F.col("content"))).collect()] == ["no file", "no file name", "not a pdf", "too large", "not a pdf inside", None]


def test_document_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_text(PAPER)
    r = extract.records(readers.document_texts(spark, str(tmp_path)), ["HYD", "DEL"]).first()
    assert (r["filename"], r["pnr"]) == ("t.txt", "QX7K2M")


def test_stream_appends_each_batch_once(spark, tmp_path):
    from waybill.streaming.ledger_stream import append_stream

    spark.createDataFrame([("a", False), ("b", True), ("c", False)], "booking_id string, is_dummy boolean").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("booking_id string, is_dummy boolean").parquet(str(tmp_path / "in"))
    for _ in range(2):
        append_stream(source, str(tmp_path / "out"), str(tmp_path / "ck"), ["booking_id"]).awaitTermination(60)
    assert sorted((r["booking_id"], r["sno"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("c", 2)]


# --- the ledger with several writers ------------------------------------------


def bookings_of(spark, n, tag):
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], readers.LEDGER_SCHEMA).schema.fields if f.name not in ("sno", "booking_id")]
    return spark.range(n).select(*rest, F.concat(F.lit(tag), F.format_string("%04d", "id")).alias("booking_id"), F.lit(False).alias("is_dummy"))


def test_writers_at_the_same_time_leave_no_gap_and_no_repeat(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sizes = {"a": 7, "b": 1, "c": 12, "d": 5}
    with ThreadPoolExecutor(4) as pool:
        firsts = dict(zip(sizes, pool.map(lambda tag: ledger.append(spark, bookings_of(spark, sizes[tag], tag), path, ["booking_id"]), sizes), strict=True))
    got = {r["booking_id"]: r["sno"] for r in readers.ledger(spark, path).collect()}
    assert sorted(got.values()) == list(range(1, 26))
    assert all(got[f"{tag}{i:04d}"] == firsts[tag] + i for tag, n in sizes.items() for i in range(n))
    assert ledger.open_ranges(spark, path).count() == 0
    assert ledger.append(spark, bookings_of(spark, 0, "e"), path, ["booking_id"]) is None
    ids = [r["booking_id"] for r in ledger.reserved_booking_ids(spark, path, 2, F.lit("mmt"), F.lit("2026-05-06").cast("date")).orderBy("number").collect()]
    assert ids == ["MMT-20260506-0026", "MMT-20260506-0027"] and claims.next_number(spark, path) == 28
    assert [(r["first"], r["last"], r["rows"]) for r in ledger.open_ranges(spark, path).collect()] == [(26, 27, 0)]


def test_claims_by_many_threads_do_not_overlap(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda n: (claims.claim(spark, path, n), n), [1 + i % 3 for i in range(40)]))
    assert sorted(x for first, n in got for x in range(first, first + n)) == list(range(1, sum(n for _, n in got) + 1))


def test_a_claim_that_was_never_filled_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(claims, "PATIENCE", 0.1)
    assert claims.claim(spark, str(tmp_path), 3) == 1
    (tmp_path / "_claims" / f"{4:019d}").write_text("")
    with pytest.raises(RuntimeError, match="never filled"):
        claims.claim(spark, str(tmp_path), 1)


def test_damaged_files_are_quarantined_and_numbering_goes_on(spark, tmp_path):
    path = tmp_path / "ledger"
    for tag in "abcd":
        ledger.append(spark, bookings_of(spark, 4, tag).coalesce(1), str(path), ["booking_id"])
    parts = {f: sorted(path.glob(f"rows-{4 * i + 1:019d}/part-*"))[0] for i, f in enumerate("abcd")}
    whole = parts["b"].read_bytes()
    parts["b"].write_bytes(whole[: len(whole) // 2])
    parts["c"].write_bytes(b"")
    parts["d"].write_bytes(b"XXXX" + parts["d"].read_bytes()[4:])
    moved = ledger.quarantine(spark, str(path))
    assert sorted(reason for _, reason in moved) == ["empty", "no beginning", "no end"]
    assert len(list((path / "_quarantine").glob("*.parquet"))) == 3 and ledger.quarantine(spark, str(path)) == []
    assert sorted(r["sno"] for r in readers.ledger(spark, str(path)).collect()) == [1, 2, 3, 4]
    assert [(r["first"], r["rows"]) for r in ledger.open_ranges(spark, str(path)).orderBy("first").collect()] == [(5, 0), (9, 0), (13, 0)]
    assert ledger.append(spark, bookings_of(spark, 2, "e"), str(path), ["booking_id"]) == 17
    assert sorted(r["sno"] for r in readers.ledger(spark, str(path)).collect()) == [1, 2, 3, 4, 17, 18]


def test_a_footer_longer_than_its_file_is_damage(spark):
    whole = lambda n: n.to_bytes(4, "little") + b"PAR1"
    rows = [(100, b"PAR1....", whole(88)), (100, b"PAR1....", whole(89)), (8, b"PAR1PAR1", b"PAR1PAR1"), (0, b"", b"")]
    df = spark.createDataFrame(rows, "length long, head binary, tail binary")
    assert [r[0] for r in df.select(ledger.damage(F.col("length"), F.col("head"), F.col("tail"))).collect()] == [None, "footer longer than the file", "no end", "empty"]


# --- files by their first bytes -----------------------------------------------


def test_uploads_read_heads_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 and more")
    (tmp_path / "in" / "b.PDF").write_bytes(b"PK..")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "_hidden.pdf").write_bytes(b"%PDF")
    with (tmp_path / "large.pdf").open("wb") as f:
        f.truncate(readers.MOST_UPLOAD_BYTES + 1)
    got = {r["filename"]: (r["length"], None if r["content"] is None else bytes(r["content"])) for r in readers.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (17, b"%PDF-1.7"), "b.PDF": (4, b"PK.."), "c.txt": (0, b""), "large.pdf": (readers.MOST_UPLOAD_BYTES + 1, None)}
    checked = readers.uploads(spark, str(tmp_path)).select("filename", readers.upload_error(F.col("filename"), F.col("length"), F.col("content")))
    assert {r[0]: r[1] for r in checked.collect()} == {"a.pdf": None, "b.PDF": "not a pdf inside", "c.txt": "not a pdf", "large.pdf": "too large"}
    whole = {r["filename"]: bytes(r["tail"]) for r in heads.file_heads(spark, f"file://{tmp_path}", 4, 100).where("tail IS NOT NULL").collect()}
    assert whole == {"a.pdf": b"more", "b.PDF": b"PK..", "c.txt": b""}


def test_filters_on_names_and_lengths_reach_the_listing(spark, tmp_path):
    session.prepared(spark)
    for i in range(4):
        (tmp_path / f"f{i}.pdf").write_bytes(b"x" * i)
    some = heads.file_heads(spark, str(tmp_path)).where((F.col("length") > 1) & F.col("filename").endswith(".pdf") & (F.col("length") <= 2))
    assert [r["filename"] for r in some.collect()] == ["f2.pdf"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan


# --- document numbers ----------------------------------------------------------


def test_scrambled_numbers_are_a_permutation(spark):
    n = spark.range(50_000).select((F.col("id") * 199_999).alias("n"))
    out = n.select("n", scalars.scrambled(F.col("n"), "k").alias("x")).withColumn("back", scalars.unscrambled(F.col("x"), "k"))
    assert out.where("n <> back OR x < 0 OR x >= 10000000000").isEmpty() and out.select("x").distinct().count() == 50_000
    edge = spark.createDataFrame([(0,), (10**10 - 1,), (10**10,), (-1,), (None,)], "n long")
    got = [r[0] for r in edge.select(scalars.unscrambled(scalars.scrambled(F.col("n"), "k"), "k")).collect()]
    assert got == [0, 10**10 - 1, None, None, None]


# --- columns of callers --------------------------------------------------------


def test_helpers_do_not_clash_with_the_callers_columns(spark):
    extra = {c: F.lit(f"mine {c}") for c in ("key", "value", "_key", "three", "two", "of_three", "of_two", "alias", "target", "place", "part", "before", "row", "__key", "__3", "airline_name")}
    df = spark.createDataFrame([("AIX 1", "IGO", "")], "flight_no string, code string, airline string").withColumns(extra)
    kept = lambda out: all(out.first()[c] == f"mine {c}" for c in extra)
    coded = lookups.with_airline_code(df, spark)
    assert kept(coded) and coded.first()["airline_code"] == "IX" and coded.columns == [*df.columns, "airline_code"]
    filled = lookups.fill_blank(coded, "airline", "airline_code", dims.airlines(spark), "iata", "name")
    assert kept(filled) and filled.first()["airline"] == "Air India Express" and filled.columns == coded.columns
    named = lookups.canonical(df, "code", dims.airline_aliases(spark))
    assert kept(named) and named.first()["code"] == "6E"
    assert kept(ledger.numbered(df, ["code"])) and kept(ledger.keep_first(df, ["code"], ["flight_no"]))


def test_records_keep_whatever_columns_a_caller_has(spark):
    extra = ("__up", "__text", "__lines", "__after", "__hits", "__caller", "__blank", "raw")
    df = spark.createDataFrame([("t.pdf", PAPER)], "filename string, text string").withColumns({c: F.lit(f"mine {c}") for c in extra})
    r = extract.records(df, ["HYD", "DEL"]).first()
    assert r["pnr"] == "QX7K2M" and all(r[c] == f"mine {c}" for c in extra)


# --- forms of any size ---------------------------------------------------------


def test_a_count_of_twenty_million_makes_its_rows(spark):
    n = 20_000_000
    kv = spark.createDataFrame([("big", "flight_count", str(n)), ("big", "flight_3_date", "2026-01-02"), ("two", "flight_count", "2"), ("none", "flight_count", "0"), ("word", "flight_count", "x"), ("other", "pnr", "P")], "request_id string, key string, value string")
    w = itinerary.wide(kv, "flight", ("flight_no", "date"), "flight_no", "flight_count")
    got = {r[0]: r[1:] for r in w.groupBy("request_id").agg(F.count("*"), F.min("idx"), F.max("position"), F.sum("idx"), F.count("date"), F.max(F.when(F.col("date").isNotNull(), F.col("idx")))).collect()}
    assert got == {"big": (n, 0, n - 1, (n - 1) * n // 2, 1, 3), "two": (2, 0, 1, 1, 0, None), "word": (1, 0, 0, 0, 0, None), "other": (1, 0, 0, 0, 0, None)}


def test_a_request_of_a_million_keys(spark):
    kv = spark.range(250_000).select(F.lit("r").alias("request_id"), F.explode(F.array(*[F.struct(F.concat(F.lit("flight_"), (F.col("id") * 3).cast("string"), F.lit(f"_{f}")).alias("key"), F.col("id").cast("string").alias("value")) for f in ("flight_no", "date", "seat", "meal")])).alias("x")).select("request_id", "x.*")
    w = itinerary.wide(kv, "flight", ("flight_no", "date", "seat"), "flight_no", "flight_count")
    assert w.count() == 250_000 and w.where("idx <> 3 * position OR flight_no <> cast(position as string) OR date IS NULL OR seat IS NULL").isEmpty()


def test_odd_spellings_of_an_index_name_it_once(spark):
    rows = [("r", "flight_01_flight_no", "A"), ("r", "flight_1_date", "d"), ("r", "flight_99999999999_flight_no", "B"), ("r", "flight_5_date", "e"), ("r", "flight_2_flight_no", None), ("r", "xflight_7_flight_no", "C"), ("r", None, "D")]
    w = itinerary.wide(spark.createDataFrame(rows, "request_id string, key string, value string"), "flight", ("flight_no", "date"), "flight_no", "flight_count")
    assert [(r["idx"], r["position"], r["flight_no"], r["date"]) for r in w.orderBy("idx").collect()] == [(1, 0, None, "d"), (2, 1, None, None)]


# --- written indexes -----------------------------------------------------------


def test_indexed_search_equals_single_searches(spark, tmp_path, monkeypatch):
    rows = [("AAB", "Bcity", "an aab"), ("BAA", "Aab", ""), ("ABA", "", "aaa"), ("ZED", "Ünd", "100%_ field"), *((f"X{i:03d}", f"city {i % 7}", f"common name {i}") for i in range(120))]
    p = places(spark, rows)
    for block in (4096, 10):
        monkeypatch.setattr(place_index, "BLOCK", block)
        place_index.write_index(p, str(tmp_path / str(block)))
        listed = spark.read.parquet(str(tmp_path / str(block) / "postings")).groupBy("gram", "block").count().agg(F.max("count")).first()[0]
        assert listed == 121 if block > 200 else listed < 4 * block
        asked = ["a", "aab", "b", "ba", "zz", "", "aa", "common", "common name 11", "city 3", "x01", "%_", "100%", "ünd", "aaab", None, "common"]
        got = place_index.indexed_matches(spark, str(tmp_path / str(block)), spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")).orderBy("query_id", "rank").collect()
        want = [(i, n, r["code"], r["priority"]) for i, q in enumerate(asked) for n, r in enumerate(search.top_matches(p, q or "").collect(), 1)]
        assert [(r["query_id"], r["rank"], r["code"], r["priority"]) for r in got] == want


def scanned_rows(df):
    """Rows that the scan of a plan put out when it was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    return sum(found)


def test_lookups_skip_row_groups(spark, tmp_path):
    p = spark.range(100_000).select(F.format_string("C%06d", F.col("id") * 2).alias("code"), F.sha2(F.col("id").cast("string"), 256).alias("city"), F.lit("a").alias("airport"), F.lit("").alias("country"), F.col("id").cast("int").alias("ord"))
    place_index.write_lookup(p, str(tmp_path / "dim"), 5000)
    got = place_index.looked_up(spark, str(tmp_path / "dim"), [" c000002", "C000003", "C000002", "nowhere"])
    assert sorted((r["code"], r["found"], r["airport"]) for r in got.collect()) == [("C000002", True, "a"), ("C000003", False, None), ("NOWHERE", False, None)]
    stored_ = spark.read.parquet(str(tmp_path / "dim"))
    assert 0 < scanned_rows(stored_.where("code = 'C000002'").select("city")) < 20_000
    assert scanned_rows(stored_.where("code = 'C000003'").select("city")) == 0  # between two codes of a row group: its Bloom filter


# --- a table of keywords -------------------------------------------------------


def test_first_keywords_match_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    letters = "abé中 .%"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", None, "x" * 5000 + "needle" + "y" * 5000]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(200)] + ["needle", "", None, "absent words", "a", "a", "é中"]
    order = list(range(len(words)))
    rng.shuffle(order)
    table = [(w, o, f"l{o}") for w, o in zip(words, order, strict=True)]
    want = {}
    for i, t in enumerate(texts):
        found = [(o, w, label) for w, o, label in table if w and t is not None and w in t]
        if found:
            want[i] = min(found)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumns({c: F.lit("clash") for c in ("gram", "around", "keyword", "ord")})
    got = keywords.first_keywords(df.repartition(3), spark.createDataFrame(table, "keyword string, ord int, label string"), "id", "t")
    assert {r["id"]: (r["ord"], r["keyword"], r["label"]) for r in got.collect()} == want and len(want) > 100
    plan = got._jdf.queryExecution().toString()
    assert "needle" not in plan
    none = spark.createDataFrame([], "keyword string, ord int, label string")
    assert keywords.first_keywords(df, none, "id", "t").count() == 0


def test_grams_are_found_across_pieces(monkeypatch):
    data = bytes(range(97, 117)) * 3
    whole = lambda: [(p, g) for at, gram in keywords._places(data, lambda h: np.ones(len(h), bool), [2, 4]) for p, g in zip(at.tolist(), gram.tolist(), strict=True)]
    want = sorted(whole())
    for piece in (1, 3, 10):
        monkeypatch.setattr(keywords, "PIECE", piece)
        assert sorted(whole()) == want


def python_rows(df):
    """Rows that Python functions of a plan gave back when it was run."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.finalPhysicalPlan()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.metrics().contains("pythonNumRowsReceived"):
            found += node.metrics().apply("pythonNumRowsReceived").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_short_keywords_meet_lists_of_texts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(keywords, "stored", lambda df, label: [made.append(python_rows(df)), stored(df, label)][1])
    texts = spark.range(200).select(F.col("id"), F.repeat(F.concat(F.lit("n "), F.col("id") % 2 + 123456, F.lit(" ")), 300).alias("t")).repartition(2)
    numbers = spark.range(100_000, 130_000).select(F.col("id").cast("string").alias("keyword"), F.col("id").alias("ord"), F.lit("l").alias("label"))
    got = keywords.first_keywords(texts, numbers, "id", "t")
    assert {r["id"]: r["keyword"] for r in got.collect()} == {i: str(i % 2 + 123456) for i in range(200)}
    assert 0 < made[0] < 50  # not a row for each place of a text


def test_keywords_about_as_long_as_a_gram(spark):
    data = ["abcdefgh", "abcdefghi", "xabcdefghij", "\x01abcdefg", "\x07\x01", "ééééé", "\0\0\0", "abcdefg\0"]
    df = spark.createDataFrame(list(enumerate(data)), "id int, t string")
    for words in (["abcdefgh", "abcdefghij", "bcdefghi", "\x01abcdefg", "abcdefg", "éééé", "ééééé", "\0", "\0\0\0\0", "abcdefg\0"], ["abcdefghi"]):
        table = spark.createDataFrame([(w, -i, "") for i, w in enumerate(words)], "keyword string, ord int, label string")
        want = {i: min((-n, w) for n, w in enumerate(words) if w in t) for i, t in enumerate(data) if any(w in t for w in words)}
        assert {r["id"]: (r["ord"], r["keyword"]) for r in keywords.first_keywords(df, table, "id", "t").collect()} == want


# --- bodies as submitted ---------------------------------------------------------


def test_bodies_are_split_and_decoded(spark):
    bodies = [("r", "a=1&b=x+y%20z&&c&=v&a=2&d=%C3%A9%3D%26&e=100%&f=a=b"), ("s", ""), ("t", None)]
    got = [(r["request_id"], r["key"], r["value"]) for r in readers.form_bodies(spark.createDataFrame(bodies, "request_id string, body string")).orderBy("request_id", "ord").collect()]
    assert got == [("r", "a", "1"), ("r", "b", "x y z"), ("r", "c", ""), ("r", "", "v"), ("r", "a", "2"), ("r", "d", "é=&"), ("r", "e", "100%"), ("r", "f", "a=b")]
    pairs = [("r", 2, "k &=", "é 中"), ("r", 1, "k", None), ("r", 3, None, "x")]
    body = readers.form_body(spark.createDataFrame(pairs, "request_id string, n int, key string, value string"), ["n"])
    back = readers.form_bodies(body).orderBy("ord").collect()
    assert [(r["key"], r["value"]) for r in back] == [("k", ""), ("k &=", "é 中")]


# --- streams -----------------------------------------------------------------------


def test_a_submission_sent_again_gets_no_second_row(spark, tmp_path):
    from waybill.streaming.ledger_stream import append_stream, once

    schema = "booking_id string, is_dummy boolean, sent timestamp"
    batches = [[("a", 0), ("b", 1)], [("a", 2), ("c", 3)], [("c", 4), ("b", 5), ("d", 6)]]
    for i, rows in enumerate(batches):
        data = [(b, False, datetime.datetime(2026, 1, 1, 0, m)) for b, m in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "booking_id", "sent")
        append_stream(source, str(tmp_path / "out"), str(tmp_path / "ck"), ["booking_id"]).awaitTermination(120)
        if i == 1:  # another writer's numbers in between
            assert claims.claim(spark, str(tmp_path / "out"), 10) == 4
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("sno").collect()
    assert [(r["booking_id"], r["sno"]) for r in got] == [("a", 1), ("b", 2), ("c", 3), ("d", 14)]


def test_a_batch_that_is_run_again_gets_its_numbers(spark, tmp_path):
    path = str(tmp_path)
    assert [claims.claim_of_batch(spark, path, n, "stream", b) for b, n in ((0, 5), (1, 2))] == [1, 6]
    assert claims.claim(spark, path, 3) == 8
    assert [claims.claim_of_batch(spark, path, 2, "stream", 1), claims.claim_of_batch(spark, path, 1, "other", 1), claims.claim_of_batch(spark, path, 1, "stream", 2)] == [6, 11, 12]
    with pytest.raises(RuntimeError, match="claimed"):
        claims.claim_of_batch(spark, path, 4, "stream", 1)


def test_cells_are_the_travellers_grid(spark, form):
    f = itinerary.flights(form, spark, dims.airports(spark))
    for positional in (False, True):
        want = {(r["request_id"], r["idx"], i): (s, m) for r in itinerary.travellers(form, f, positional).collect() for i, (s, m) in enumerate(zip(r["seat_by_flight"], r["meal_by_flight"], strict=True))}
        got = {(r["request_id"], r["idx"], r["position"]): (r["seat"], r["meal"]) for r in itinerary.cells(form, positional).collect()}
        assert got == want and len(want) == 6
    big = spark.createDataFrame([("b", "flight_count", "100000"), ("b", "pax_count", "2"), ("b", "pax_1_seat_7", "1A")], "request_id string, key string, value string")
    assert [(r["seat"], r["n"]) for r in itinerary.cells(big).groupBy("seat").agg(F.count("*").alias("n")).orderBy("seat").collect()] == [("", 199_999), ("1A", 1)]


def shuffled_rows(df):
    """Rows that each exchange of a plan wrote when it was run; a reused one counts once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    return found


def test_keys_meet_before_they_are_dealt(spark):
    n, fields = 2000, ("flight_no", "date", "seat", "meal", "class")
    keys = [F.struct(F.lit(f"flight_{i}_{f}").alias("key"), F.concat(F.lit(f), F.col("id")).alias("value")) for i in (0, 1) for f in fields]
    kv = spark.range(n).repartition(2).select(F.col("id").alias("request_id"), F.explode(F.array(*keys)).alias("x")).select("request_id", "x.*")
    w = itinerary.wide(kv, "flight", fields, "flight_no", "flight_count")
    found = shuffled_rows(w)
    assert found and max(found) <= 2 * n and w.count() == 2 * n
    assert w.where("flight_no <> concat('flight_no', request_id) OR class <> concat('class', request_id) OR idx <> position").isEmpty()


def test_a_request_with_only_an_odd_index_keeps_its_row(spark):
    kv = spark.createDataFrame([("r", "flight_01_date", "d"), ("s", "flight_4_date", "e"), ("s", "flight_count", "6"), ("t", "flight_9_date", "f"), ("t", "flight_1_date", "g"), ("t", "flight_count", "3")], "request_id string, key string, value string")
    w = itinerary.wide(kv, "flight", ("flight_no", "date"), "flight_no", "flight_count")
    got = sorted((r["request_id"], r["idx"], r["position"], r["date"] or "") for r in w.collect())
    assert got == [("r", 0, 0, ""), *(("s", i, i, "e" if i == 4 else "") for i in range(6)), *(("t", i, i, "g" if i == 1 else "") for i in range(3))]


def test_searches_deal_no_grams_and_no_queries(spark):
    """Nothing but each task's best places is dealt where queries are few, and no query is dealt."""
    n = 3000
    p = spark.range(n).select(F.concat(F.lit("BR"), (F.col("id") % 25).cast("string")).alias("code"), F.lit("large brushed tin").alias("city"), F.concat(F.lit("spring green "), F.col("id")).alias("airport"), F.lit("").alias("country"), F.col("id").alias("ord"))
    asked = spark.range(4000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "ring").otherwise("br1").alias("query"))
    found = search.batch_matches(p, asked)
    assert sum(shuffled_rows(found)) == 0 and found.count() == 4000 * 15
    one = [(r["code"], r["airport"], r["priority"]) for r in found.where("query_id = 1").orderBy("rank").collect()]
    assert one == [(r["code"], r["airport"], r["priority"]) for r in search.top_matches(p, "br1").collect()]


def test_places_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(place_index, "PLACES", 100)
    p = spark.range(0, 1000, 1, 1).select(F.lit("AB").alias("code"), F.lit("tin").alias("city"), F.lit("green").alias("airport"), F.lit("").alias("country"), F.col("id").alias("ord"))
    made = []
    monkeypatch.setattr(place_index, "dealt", lambda df, rows: made.append(session.dealt(df, rows)) or made[0])
    place_index.write_index(p, str(tmp_path / "index"))
    assert made[0].rdd.getNumPartitions() == 10 and max(made[0].groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 200


def test_append_makes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def made(x):
        seen.add(1)
        return f"B{x:04d}"

    fields = spark.createDataFrame([], readers.LEDGER_SCHEMA).schema.fields
    rows = spark.range(0, 500, 1, 4).select(F.udf(made, "string")("id").alias("booking_id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name != "booking_id"])
    assert ledger.append(spark, rows, str(tmp_path / "once"), ["booking_id"]) == 1
    assert seen.value == 500 and readers.ledger(spark, str(tmp_path / "once")).where("booking_id <> format_string('B%04d', sno - 1)").isEmpty()


def test_grids_need_no_map_of_a_whole_request(spark, form):
    f = itinerary.flights(form, spark, dims.airports(spark))
    for df in (itinerary.travellers(form, f), itinerary.bookings(form, spark, dims.airports(spark), F.current_timestamp())):
        assert "map_filter" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = [("r", "flight_0_flight_no", "A"), ("r", "flight_0_seat", "1A"), ("r", "pax_3_name", "N"), ("r", "pax_3_seat_0", ""), ("r", "pax_03_meal_0", "no"), ("r", "pax_3_meal_0", "VG")]
    kv = spark.createDataFrame(rows, "request_id string, key string, value string")
    t = itinerary.travellers(kv, itinerary.flights(kv, spark, dims.airports(spark))).first()
    assert (t["pax"], t["idx"], t["name"], t["seat_by_flight"], t["meal_by_flight"]) == (0, 3, "N", ["1A"], ["VG"])


def test_named_and_counted_rows_share_an_aggregate(spark):
    rows = [("a", "flight_1_flight_no", "X"), ("a", "flight_1_date", "d"), ("b", "flight_count", "2"), ("b", "flight_1_date", "e")]
    kv = spark.createDataFrame(rows, "request_id string, key string, value string").repartition(3)
    w = itinerary.wide(kv, "flight", ("flight_no", "date"), "flight_no", "flight_count")
    assert sorted((r["request_id"], r["idx"], r["position"], r["flight_no"], r["date"]) for r in w.collect()) == [("a", 1, 0, "X", "d"), ("b", 0, 0, None, None), ("b", 1, 1, None, "e")]
    w.collect()
    plan = w._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("functions=[partial_min(") == 1


def test_a_booking_is_made_where_its_keys_are(spark):
    n = 2000
    keys = [F.struct(F.lit(k).alias("key"), F.concat(F.lit(v), F.col("id")).alias("value")) for k, v in (("flight_0_flight_no", "AI "), ("flight_1_flight_no", "BA "), ("pax_0_name", "P"), ("pax_0_seat_1", "S"))]
    kv = spark.range(0, n, 1, 3).select(F.col("id").alias("request_id"), F.explode(F.array(*keys)).alias("x")).select("request_id", "x.*")
    b = itinerary.bookings(kv, spark, dims.airports(spark), F.current_timestamp())
    assert [x for x in shuffled_rows(b) if x >= n] == [4 * n] and b.count() == n  # keys once; dimensions are small
    assert b.where("size(flights) <> 2 OR flights[1].flight_no <> concat('BA ', request_id) OR travellers[0].seat_by_flight[1] <> concat('S', request_id)").isEmpty()


def test_bookings_of_counted_and_repeated_keys(spark):
    rows = [
        ("c", 0, "flight_count", "3"), ("c", 1, "flight_1_date", "2026-05-21"), ("c", 2, "flight_7_date", "2026-05-22"), ("c", 3, "pax_count", "2"), ("c", 4, "pax_1_seat_2", "9Z"), ("c", 5, "pax_1_seat_2", "8Z"),
        ("n", 0, "flight_2_flight_no", "B"), ("n", 1, "flight_2_flight_no", "A"), ("n", 2, "flight_01_flight_no", "X"), ("n", 3, "flight_1_seat", "1A"), ("n", 4, "pax_0_seat_0", ""), (None, 0, "junk", "x"), ("o", 0, "flight_5_seat", "5A"),
    ]
    kv = spark.createDataFrame(rows, "request_id string, ord int, key string, value string").repartition(3)
    got = {r["request_id"]: r for r in itinerary.bookings(kv, spark, dims.airports(spark), F.current_timestamp()).collect()}
    told = lambda k: [(f["position"], f["idx"], f["flight_no"], f["date_raw"], f["seat"]) for f in got[k]["flights"]]
    assert told("c") == [(0, 0, "", "", ""), (1, 1, "", "2026-05-21", ""), (2, 2, "", "", "")]
    assert told("n") == [(0, 1, "", "", "1A"), (1, 2, "B", "", "")] and told("o") == told(None) == [(0, 0, "", "", "")]
    assert [(t["pax"], t["idx"], t["name"], t["seat_by_flight"]) for t in got["c"]["travellers"]] == [(0, 0, "", ["", "", ""]), (1, 1, "", ["", "", "9Z"])]
    assert [t["seat_by_flight"] for t in got["n"]["travellers"]] == [["1A", ""]] and len(got) == 4


@pytest.mark.parametrize("name", ["nested_bookings", "ledger_row"])
def test_lines_are_dealt_not_their_keys(spark, name, monkeypatch):
    """The rows that meet are lines and orders, once each; ledger rows are kept in one table."""
    sf_dir, made = "/root/testdata/sf0.001", []
    monkeypatch.setattr(itinerary, "bookings", lambda *a, real=itinerary.bookings: made.append(real(*a)) or made[0])
    folder = session.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert sum(shuffled_rows(made[0])) <= lines + orders + 1000
    assert len(set(os.listdir(folder)) - before) == (name == "ledger_row")
