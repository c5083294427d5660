"""Queries that use the operators on the driver's tables, each with its SQL.

The tables hold no travel papers, so queries print them from orders and their
lines, or use an operator on what there is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.functions import scalars as S
from waybill.operators import extract, fares, itinerary, keywords, ledger, lookups, place_index, search
from waybill.session import Tables, shared_dir, spread
from waybill.sources import dims, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.upper("p_brand").alias("code"), F.col("p_type").alias("city"), F.col("p_name").alias("airport"), F.lit("").alias("country"), F.col("p_partkey").alias("ord")
    )


_PRIORITY = """CASE WHEN upper(p_brand) = {q} THEN 0 WHEN starts_with(upper(p_brand), {q}) THEN 1
  WHEN starts_with(upper(p_type), {q}) THEN 2 WHEN contains(upper(p_name), {q}) THEN 3 END"""
_FOUND = f"""SELECT upper(p_brand) AS code, p_type AS city, p_name AS airport, '' AS country, p_partkey AS ord, {_PRIORITY} AS priority FROM part"""


@query(f"SELECT code, city, airport, country, priority FROM ({_FOUND.format(q="'BRAND#1'")}) WHERE priority IS NOT NULL ORDER BY priority, ord LIMIT 15")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_matches(_places(spark, sf_dir), " brand#1 ")


@query(f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM ({_FOUND.format(q="'S'")}) WHERE priority IS NOT NULL),
stop AS (SELECT min(ord) AS cut FROM m WHERE n >= 30 AND priority > 1)
SELECT code, city, airport, country, priority FROM m, stop WHERE cut IS NULL OR ord <= cut ORDER BY priority, ord LIMIT 15""")
def search_topk_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_matches(_places(spark, sf_dir), "s", scan_limit=30)


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("brand#"), (F.col("c_custkey") % 30).cast("string"))).when(F.col("c_custkey") % 3 == 1, F.substring("c_mktsegment", 1, 2)).otherwise("ring").alias("query"),
    )


@query("""WITH q AS (SELECT c_custkey AS query_id, upper(CASE c_custkey % 3 WHEN 0 THEN 'brand#' || (c_custkey % 30) WHEN 1 THEN substr(c_mktsegment, 1, 2) ELSE 'ring' END) AS q FROM customer),
m AS (SELECT query_id, upper(p_brand) AS code, p_type AS city, p_name AS airport, '' AS country, p_partkey,
  CASE WHEN upper(p_brand) = q THEN 0 WHEN starts_with(upper(p_brand), q) THEN 1 WHEN starts_with(upper(p_type), q) THEN 2 WHEN contains(upper(p_name), q) THEN 3 END AS priority
  FROM q, part),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, p_partkey) AS rank FROM m WHERE priority IS NOT NULL)
SELECT query_id, rank, code, city, airport, country, priority FROM r WHERE rank <= 15""")
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many searches at once, in all parts."""
    return search.batch_matches(_places(spark, sf_dir), _searches(spark, sf_dir))


@query("""WITH q AS (SELECT c_custkey AS query_id, upper(CASE c_custkey % 3 WHEN 0 THEN 'brand#' || (c_custkey % 30) WHEN 1 THEN substr(c_mktsegment, 1, 2) ELSE 'ring' END) AS q FROM customer),
m AS (SELECT q, upper(p_brand) AS code, p_type AS city, p_name AS airport, '' AS country, p_partkey,
  CASE WHEN upper(p_brand) = q THEN 0 WHEN starts_with(upper(p_brand), q) THEN 1 WHEN starts_with(upper(p_type), q) THEN 2 WHEN contains(upper(p_name), q) THEN 3 END AS priority
  FROM (SELECT DISTINCT q FROM q), part),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY priority, p_partkey) AS rank FROM m WHERE priority IS NOT NULL)
SELECT query_id, rank, code, city, airport, country, priority FROM q JOIN r USING (q) WHERE rank <= 15""")
def search_batch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same searches (its SQL searches each distinct query once)."""
    return search_batch(spark, sf_dir)


@query("""SELECT c_custkey, c_mktsegment, coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END, ''), n_name) AS label, n_name, r_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def enrich_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").withColumn("label", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")))
    c = lookups.fill_blank(c, "label", "c_nationkey", nation, "n_nationkey", "n_name")
    c = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.select("c_custkey", "c_mktsegment", "label", "n_name", "r_name")


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in row)) for row in rows)


_AIRLINES = f"""airline(iata, name) AS (VALUES {_values(dims.airline_rows())}), alias(code, iata) AS (VALUES {_values(dims.alias_rows())}),
prefix(iata, prefix) AS (VALUES {_values(dims.prefix_rows())}),
payload AS (SELECT iata AS code, name, iata, NULL::VARCHAR AS alias_of FROM airline UNION ALL SELECT code, name, iata, iata FROM alias JOIN airline USING (iata))"""


@query(f"WITH {_AIRLINES} SELECT code, name, iata, alias_of FROM payload")
def airline_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.airline_payload(spark).select("code", "name", "iata", "alias_of")


@query(f"""WITH {_AIRLINES}, c AS (SELECT s_suppkey, (['IGO', 'ai', 'AIX', 'ZZZ', 'BAW', ''])[(s_suppkey % 6 + 1)::INT] AS code FROM supplier)
SELECT s_suppkey, coalesce(iata, c.code) AS code FROM c LEFT JOIN alias ON alias.code = c.code""")
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in ("IGO", "ai", "AIX", "ZZZ", "BAW", "")])
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.get(codes, (F.col("s_suppkey") % 6).cast("int")).alias("code"))
    return lookups.canonical(s, "code", dims.airline_aliases(spark))


@query("""WITH p AS (SELECT 'C' || c_custkey AS code, c_name AS city, c_mktsegment AS airport FROM customer)
SELECT upper(trim(' c' || (s_suppkey * 7) || ' ')) AS code, p.code IS NOT NULL AS found, city, airport, CASE WHEN p.code IS NOT NULL THEN '' END AS country
FROM supplier LEFT JOIN p ON p.code = upper(trim(' c' || (s_suppkey * 7) || ' '))""")
def place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_name").alias("city"), F.col("c_mktsegment").alias("airport"), F.lit("").alias("country"))
    asked = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" c"), (F.col("s_suppkey") * 7).cast("string"), F.lit(" ")).alias("code"))
    return search.place_info(places, asked)


@query(f"""WITH {_AIRLINES}, f AS (SELECT s_suppkey, (['AIX ', '6E-', 'ZZ', 'BAW', 'ai'])[(s_suppkey % 5 + 1)::INT] || (100 + s_suppkey) AS flight_no FROM supplier),
c AS (SELECT *, regexp_replace(upper(flight_no), '[^A-Z0-9]', '', 'g') AS compact FROM f),
r AS (SELECT s_suppkey, flight_no, coalesce(x.iata, y.iata, substr(compact, 1, 2)) AS airline_code
  FROM c LEFT JOIN payload x ON x.code = substr(compact, 1, 3) LEFT JOIN payload y ON y.code = substr(compact, 1, 2))
SELECT s_suppkey, flight_no, airline_code, coalesce(prefix, '000') AS prefix FROM r LEFT JOIN prefix ON prefix.iata = airline_code""")
def alias_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.lit(x) for x in ("AIX ", "6E-", "ZZ", "BAW", "ai")])
    f = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.get(heads, (F.col("s_suppkey") % 5).cast("int")), (F.col("s_suppkey") + 100).cast("string")).alias("flight_no"))
    f = lookups.with_airline_code(f, spark)
    p = dims.number_prefixes(spark).withColumnRenamed("iata", "airline_code")
    return f.join(p, "airline_code", "left").select("s_suppkey", "flight_no", "airline_code", F.coalesce("prefix", F.lit("000")).alias("prefix"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def known_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return lookups.known_only(table(spark, sf_dir, "customer"), big, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def unknown_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return lookups.unknown_only(table(spark, sf_dir, "customer"), big, "c_custkey", "o_custkey").select("c_custkey", "c_name")


_SITES = (("BLOG.", "blog"), ("SHOP.", "shop"), ("M.", "mobile"), ("EXAMPLE.NET", "net"))


@query("""SELECT page_id, CASE WHEN contains(u, 'BLOG.') THEN 'blog' WHEN contains(u, 'SHOP.') THEN 'shop' WHEN contains(u, 'M.') THEN 'mobile' WHEN contains(u, 'EXAMPLE.NET') THEN 'net' ELSE '' END AS platform
FROM (SELECT page_id, upper(url) AS u FROM pages)""")
def platform_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", lookups.first_keyword(F.upper("url"), _SITES).alias("platform"))


@query(f"""SELECT doc_id, {' OR '.join(f"contains(u, '{w}')" for w in (*dims.RELEVANT, 'LICENSE'))} AS relevant
FROM (SELECT doc_id, upper(text) AS u FROM documents)""")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.contains_any(F.upper("text"), (*dims.RELEVANT, "LICENSE")).alias("relevant"))


@query("""SELECT 'c' || c_custkey AS code, c_name AS name, NULL::VARCHAR AS alias_of FROM customer
UNION ALL SELECT 's' || s_suppkey, c_name, 'c' || c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey""")
def dim_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_name").alias("name"), "c_custkey")
    s = table(spark, sf_dir, "supplier").join(c, F.col("s_suppkey") == F.col("c_custkey"))
    alias = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("code"), "name", F.col("code").alias("alias_of"))
    return c.drop("c_custkey").unionByName(alias, allowMissingColumns=True).select("code", "name", "alias_of")


def _form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of up to four distinct line numbers as submitted forms."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_shipdate").alias("d"), F.min("l_suppkey").alias("s"))
    i = F.col("l_linenumber").cast("string")
    put = lambda k, v: F.struct(k.alias("key"), v.cast("string").alias("value"))
    kv = F.array(
        put(F.concat(F.lit("flight_"), i, F.lit("_flight_no")), F.concat(F.lit("AI "), F.col("p").cast("string"))),
        put(F.concat(F.lit("flight_"), i, F.lit("_date")), F.date_format("d", "yyyy-MM-dd")),
        put(F.concat(F.lit("flight_"), i, F.lit("_from_code")), F.concat(F.lit("q"), (F.col("s") % 90 + 10).cast("string"))),
        put(F.concat(F.lit("flight_"), i, F.lit("_to_code")), F.concat(F.lit("Q"), (F.col("p") % 90 + 10).cast("string"))),
        put(F.concat(F.lit("flight_"), i, F.lit("_seat")), F.when(F.col("s") % 2 == 0, F.concat((F.col("s") % 30).cast("string"), F.lit("A"))).otherwise("")),
        put(F.concat(F.lit("pax_"), i, F.lit("_name")), F.concat(F.lit("P"), F.col("s").cast("string"))),
        put(F.concat(F.lit("pax_"), i, F.lit("_seat_0")), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("W"), i))),
    )
    return li.select(F.col("l_orderkey").alias("request_id"), F.explode(kv).alias("kv")).select("request_id", "kv.key", "kv.value").where("value IS NOT NULL")


_LINES = """l AS (SELECT l_orderkey, l_linenumber AS i, min(l_partkey) AS p, min(l_shipdate) AS d, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {_LINES} SELECT l_orderkey AS request_id, i AS idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS position,
  'AI ' || p AS flight_no, strftime(d, '%Y-%m-%d') AS date, 'q' || (s % 90 + 10) AS from_code, CASE WHEN s % 2 = 0 THEN (s % 30) || 'A' ELSE '' END AS seat FROM l""")
def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = itinerary.wide(_form(spark, sf_dir), "flight", itinerary.FLIGHT_FIELDS, "flight_no", "flight_count")
    return w.select("request_id", "idx", F.col("position").cast("long").alias("position"), "flight_no", "date", "from_code", "seat")


@query(f"""WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS position FROM l)
SELECT t.l_orderkey AS request_id, t.i AS idx, 'P' || t.s AS name,
  string_agg(CASE WHEN f.position = 0 AND t.i % 2 = 0 THEN 'W' || t.i WHEN f.s % 2 = 0 THEN (f.s % 30) || 'A' ELSE '' END, ',' ORDER BY f.position) AS seats,
  count(*) AS cells
FROM l t JOIN f ON f.l_orderkey = t.l_orderkey GROUP BY t.l_orderkey, t.i, t.s""")
def allocation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _form(spark, sf_dir)
    f = itinerary.wide(kv, "flight", itinerary.FLIGHT_FIELDS, "flight_no", "flight_count")
    t = itinerary.travellers(kv, f)
    return t.select("request_id", "idx", "name", F.array_join("seat_by_flight", ",").alias("seats"), F.size("seat_by_flight").cast("long").alias("cells"))


@query(f"""WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS position FROM l)
SELECT t.l_orderkey AS request_id, t.i AS idx, t.position + 1 AS pax, f.position,
  CASE WHEN f.position = 0 AND t.i % 2 = 0 THEN 'W' || t.i WHEN f.s % 2 = 0 THEN (f.s % 30) || 'A' ELSE '' END AS seat, 'Not selected' AS meal
FROM f t JOIN f ON f.l_orderkey = t.l_orderkey""")
def seat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid, a row for each traveller and flight."""
    c = itinerary.cells(_form(spark, sf_dir))
    return c.select("request_id", "idx", F.col("pax").cast("long").alias("pax"), F.col("position").cast("long").alias("position"), "seat", "meal")


@query("""WITH e AS (SELECT user_id, event_id, ts, date_trunc('minute', ts) AS dep, date_trunc('minute', ts) + to_minutes((event_id * 7 % 240)::INT) AS arr FROM events),
w AS (SELECT *, epoch(dep)::BIGINT - epoch(lag(arr) OVER u)::BIGINT AS sec, row_number() OVER u AS n FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, event_id, CASE WHEN n > 1 AND event_id % 11 = 0 THEN 'Self transfer' WHEN sec > 0 THEN (sec // 3600) || 'h ' || (sec % 3600 // 60) || 'm (' || CASE WHEN sec >= 10800 THEN 'Long' ELSE 'Short' END || ' layover)' END AS layover FROM w""")
def layover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as flights: they arrive some minutes after they depart."""
    clock = lambda c: F.date_format(c, "HH:mm")
    arrival = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") * 7 % 240).cast("int"))
    e = table(spark, sf_dir, "events").withColumns({
        "date_raw": F.date_format("ts", "yyyy-MM-dd"), "dep_time_raw": clock("ts"), "arr_time_raw": clock(arrival),
        "manual_layover": F.when(F.col("event_id") % 11 == 0, "Self transfer").otherwise(""),
    })
    return e.select("user_id", "event_id", itinerary.layover("user_id", "ts").alias("layover"))


@query("SELECT doc_id, text, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return ledger.keep_first(d, ["text"], ["doc_id"])


def _fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kept = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("q"), F.max("l_tax").alias("tax"), F.max("l_discount").alias("disc"))
    raw = kept.select(
        "l_orderkey", "l_linenumber", F.col("price").cast("string").alias("base_fare"),
        F.when(F.col("q") == 13, "x").otherwise((F.col("tax") * 100).cast("string")).alias("taxes_fees"),
        F.lit(None).cast("string").alias("insurance"), F.col("q").cast("string").alias("meals_fee"), F.lit("0").alias("baggage_fee"),
        F.lit("0").alias("seats_fee"), F.lit("0").alias("zero_cancel"), (F.col("disc") * 100).cast("string").alias("discount"),
    )
    return fares.parsed_fares(raw)


_FARES = """k AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price, max(l_quantity) AS q, max(l_tax) AS tax, max(l_discount) AS disc FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey, l_linenumber, CASE WHEN q = 13 THEN 0 ELSE price END AS base, CASE WHEN q = 13 THEN 0 ELSE tax * 100 END AS tax, CASE WHEN q = 13 THEN 0 ELSE q END AS meals, CASE WHEN q = 13 THEN 0 ELSE disc * 100 END AS disc FROM k)"""


@query(f"WITH {_FARES} SELECT l_orderkey, l_linenumber, round(base + tax + meals - disc, 2) AS total, 'INR ' || format('{{:,.2f}}', base) AS base_shown FROM f")
def fare_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fares(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(fares.total_fare(), 2).alias("total"), S.money(F.col("base_fare")).alias("base_shown"))


@query(f"""WITH {_FARES}, i AS (
  SELECT l_orderkey, l_linenumber, 0 AS position, 'Base Fare' AS label, base AS amount FROM f
  UNION ALL SELECT l_orderkey, l_linenumber, 1, 'Airline Taxes & Fees', tax FROM f
  UNION ALL SELECT l_orderkey, l_linenumber, 3, 'Meals', meals FROM f WHERE meals <> 0
  UNION ALL SELECT l_orderkey, l_linenumber, 7, 'Discount', -disc FROM f WHERE disc <> 0)
SELECT l_orderkey, l_linenumber, position, label, round(amount, 4) AS amount FROM i""")
def fare_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fares.fare_lines(_fares(spark, sf_dir), "l_orderkey", "l_linenumber")
    return lines.select("l_orderkey", "l_linenumber", "position", "label", F.round("amount", 4).alias("amount"))


@query(f"""WITH {_LINES} SELECT l_orderkey AS request_id, upper(arg_min('q' || (s % 90 + 10), i)) || ' → ' || arg_max('Q' || (p % 90 + 10), i) AS route,
  string_agg('AI ' || p, ', ' ORDER BY i) AS flight_nos, count(*) AS segments FROM l GROUP BY l_orderkey""")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = itinerary.wide(_form(spark, sf_dir), "flight", itinerary.FLIGHT_FIELDS, "flight_no", "flight_count")
    w = w.withColumns({"from_code": F.upper("from_code"), "to_code": F.upper("to_code")})
    return itinerary.route_summary(w).withColumn("segments", F.col("segments").cast("long"))


@query("""SELECT o_orderkey, n AS sno, 'AT-' || strftime(o_orderdate, '%Y%m%d') || '-' || printf('%04d', n) AS booking_id
FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""")
def ledger_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ledger.numbered(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])
    return n.select("o_orderkey", F.col("sno").cast("long").alias("sno"), S.booking_id(S.platform_code(F.lit("")), F.col("o_orderdate"), F.col("sno")).alias("booking_id"))


_WIDTH = "SELECT '{c}' AS \"column\", least(max(length(coalesce({c}::VARCHAR, ''))) + 2, 50) AS width FROM customer"


@query(" UNION ALL ".join(_WIDTH.format(c=c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.column_widths(table(spark, sf_dir, "customer")).withColumn("width", F.col("width").cast("long"))


@query("""SELECT o_orderkey, 'MakeMyTrip' AS booking_platform, 'P' || printf('%06d', o_orderkey) AS pnr, 'MMT' || printf('%09d', o_orderkey) AS booking_id,
  strftime(o_orderdate, '%Y-%m-%d') AS booking_date, printf('%.2f', o_totalprice) AS total_fare, 'Anna Test' AS passenger,
  'AI ' || (1000 + o_orderkey % 9000) AS flight_no, 'HYD' AS from_code, 'DEL' AS to_code FROM orders""")
def round_trip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed as papers and read back."""
    o = spread(table(spark, sf_dir, "orders"))
    text = F.concat_ws(
        "\n", F.lit("MakeMyTrip Itinerary"), F.format_string("Booking ID: MMT%09d, (Booked on %s)", F.col("o_orderkey"), F.date_format("o_orderdate", "d MMM yyyy")),
        F.format_string("PNR: P%06d", F.col("o_orderkey")), F.lit("Mrs Anna Test"),
        F.format_string("AI %d HYD 15:40 to 18:00 DEL", F.col("o_orderkey") % 9000 + 1000), F.concat(F.lit("Total Amount INR "), F.format_number("o_totalprice", 2)),
    )
    r = extract.records(o.select("o_orderkey", F.lit("t.pdf").alias("filename"), text.alias("text")), ["HYD", "DEL"])
    first = F.get("flights", 0)
    return r.select("o_orderkey", "booking_platform", "pnr", "booking_id", "booking_date", "total_fare", F.get("passengers", 0)["name"].alias("passenger"), first["flight_no"].alias("flight_no"), first["from_code"].alias("from_code"), first["to_code"].alias("to_code"))


@query(r"""WITH e AS (SELECT doc_id, regexp_extract(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') AS email,
  regexp_replace(regexp_extract(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}'), '[^0-9]', '', 'g') AS d FROM documents)
SELECT doc_id, email, CASE WHEN length(d) = 11 THEN d ELSE '' END AS phone FROM e""")
def email_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    upper = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return d.select("doc_id", extract.capture(upper, extract.EMAIL, 0).alias("email"), S.messaging_number(extract.capture(F.col("text"), r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0)).alias("phone"))


@query("""SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN length(text) < 50 THEN 'too short' WHEN NOT contains(upper(text), 'TOKEN') THEN 'not a booking' END AS status FROM documents""")
def text_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mark = lookups.first_keyword(F.upper("text"), (("TOKEN", "token"),))
    return d.select("doc_id", extract.text_status(F.col("text"), F.lit(""), F.lit(""), mark).alias("status"))


@query(r"""WITH s AS (SELECT doc_id, [trim(x, ' ' || chr(9)) FOR x IN string_split(text, chr(10)) IF trim(x, ' ' || chr(9)) <> ''] AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM s)
SELECT doc_id, n, md5(line) AS line, md5(coalesce(upper(replace(lead(line) OVER (PARTITION BY doc_id ORDER BY n), 'ß', 'SS')), '')) AS next_line FROM l""")
def line_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", extract.lines_of(F.col("text")).alias("lines"))
    pairs = d.select("doc_id", F.posexplode(extract.adjacent(F.col("lines"))).alias("i", "x"))
    return pairs.select("doc_id", (F.col("i") + 1).cast("long").alias("n"), F.md5("x.line").alias("line"), F.md5("x.next").alias("next_line"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y') AS shown, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes((o_orderkey % 1440)::INT) - INTERVAL 60 MINUTE, '%H:%M') AS cutoff FROM orders""")
def date_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    clock = F.format_string("%d:%d", F.floor(F.col("o_orderkey") % 1440 / 60), F.col("o_orderkey") % 60)
    return o.select("o_orderkey", S.date_display(F.date_format("o_orderdate", "yyyy-M-d")).alias("shown"), S.minutes_before(clock).alias("cutoff"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type || ':' || (props->>'$.k') AS tag FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.try_cast("long").alias("k"), F.concat("event_type", F.lit(":"), k).alias("tag"))


@query("""SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'P' || o_orderkey END, ''), nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'B' || o_orderkey END, ''), 'output') AS stem,
  'PNR:' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'P' || o_orderkey END || '|BOOKING:' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'B' || o_orderkey END || '|ROUTE:A → B|PAX:' || (o_orderkey % 5) AS code_text,
  'Paid via ' || CASE WHEN o_orderkey % 2 = 0 THEN 'UPI' ELSE 'Credit Card ending in ' || (1000 + o_orderkey % 9000) END AS paid FROM orders""")
def render_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pnr = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("P"), k.cast("string")))
    bid = F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("B"), k.cast("string")))
    method = F.when(k % 2 == 0, "UPI").otherwise("Credit Card")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.file_stem(pnr, bid).alias("stem"), S.code_text(pnr, bid, F.lit("A → B"), k % 5).alias("code_text"), S.payment_text(method, (k % 9000 + 1000).cast("string")).alias("paid")
    )


@query(r"""SELECT doc_id, coalesce(trim(list_filter(regexp_extract_all(text, '\b\+?\d[\d\s\-]{8,}\d\b'), lambda x: length(regexp_replace(x, '\D', '', 'g')) BETWEEN 10 AND 13)[1]), '') AS phone FROM documents""")
def first_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", extract.first_phone(F.col("text")).alias("phone"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'm' || event_id END AS message, CASE event_id % 3 WHEN 0 THEN 'E' || user_id WHEN 1 THEN 'plain ' || event_type ELSE substr(repeat('no json ', 40), 1, 200) END AS error FROM events""")
def json_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as JSON and read back."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 3
    id_ = F.concat(F.lit("m"), F.col("event_id").cast("string"))
    e = e.withColumn("messages", F.when(k != 0, F.array(F.struct(id_.alias("id"), F.col("event_type").alias("kind")))))
    e = e.withColumn("error", F.when(k == 0, F.to_json(F.struct(F.struct(F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("message")).alias("error")))).when(k == 1, F.to_json(F.struct(F.concat(F.lit("plain "), F.col("event_type")).alias("error")))).otherwise(F.lit("no json " * 40)))
    return e.select("event_id", S.message_id(S.as_json("event_id", "messages")).alias("message"), S.error_text(F.col("error")).alias("error"))


_CAPTION = """'Hello P' || o_orderkey || ',' || chr(10) || 'your travel document is attached.' || chr(10) || chr(10) || 'Record ' ||
  CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE 'X' || o_orderkey END || ', A → B' || chr(10) || 'First day: -' || chr(10) || chr(10) || 'Waybill'"""


@query(f"""SELECT o_orderkey, n || ' SEGMENT' || CASE WHEN n = 1 THEN '' ELSE 'S' END AS badge, n || ' Segment' || CASE WHEN n > 1 THEN 's' ELSE '' END AS heading,
  (o_orderkey % 6)::INT // 3 AS row, (o_orderkey % 3)::INT AS col, o_orderkey % 4 = 0 AS alert, CASE n WHEN 0 THEN '' WHEN 1 THEN 'Flight 1: N/A' WHEN 2 THEN 'Flight 1: N/A | Flight 2: 3C' ELSE 'Flight 1: N/A | Flight 2: 3C | Flight 3: N/A' END AS seats,
  {_CAPTION} AS caption,
  'https://example.com/airlines/64/' || substr(o_orderpriority, 1, 2) || '.png' AS logo, strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '2026-01-02 03:04:05' END, '%a, %d %b %Y') AS booked
FROM (SELECT *, o_orderkey % 4 AS n FROM orders)""")
def render_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    key, n = k.cast("string"), k % 4
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.segments_badge(n).alias("badge"), S.segments_heading(n).alias("heading"), S.grid_place(k % 6)["row"].alias("row"), S.grid_place(k % 6)["col"].alias("col"),
        S.no_refund(F.when(n == 0, "Non-Refundable fare").when(n == 1, "Refundable")).alias("alert"),
        S.by_segment(F.slice(F.array(F.lit(None), F.lit("3C"), F.lit("")), F.lit(1), n.cast("int")), "N/A", " | ").alias("seats"),
        ledger.caption(F.concat(F.lit("P"), key), F.when(k % 3 != 0, F.concat(F.lit("X"), key)), F.lit("A → B"), F.lit(""), "Waybill").alias("caption"),
        S.logo_url(F.substring("o_orderpriority", 1, 2)).alias("logo"),
        S.booking_date_display(F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("booked"),
    )


@query("SELECT 'MMTX-20260506-' || printf('%04d', count(*) + 1) AS booking_id FROM orders")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.next_booking_id(table(spark, sf_dir, "orders"), F.lit(" mmt-x "), F.lit("2026-05-06").cast("date"))


@query(ORACLES["search_batch_all"])
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same searches again, from a written index."""
    folder = f"{shared_dir(spark)}/place-index-{uuid.uuid4().hex}"
    place_index.write_index(_places(spark, sf_dir), folder)
    return place_index.indexed_matches(spark, folder, _searches(spark, sf_dir))


@query("""WITH k AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE substr(p_name, 1, 3 + (p_partkey % 4)::INT) END AS keyword, p_partkey AS ord, p_brand AS label FROM part),
f AS (SELECT keyword, min(ord) AS ord, arg_min(label, ord) AS label FROM k WHERE keyword <> '' GROUP BY keyword)
SELECT doc_id, keyword, ord, label FROM (SELECT doc_id, keyword, ord, label, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM documents, f WHERE contains(text, keyword)) WHERE n = 1""")
def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of keywords, made of parts, in documents: the first of each."""
    k = F.col("p_partkey")
    word = F.when(k % 2 == 0, k.cast("string")).otherwise(F.substring(F.col("p_name"), F.lit(1), (3 + k % 4).cast("int")))
    words = table(spark, sf_dir, "part").select(word.alias("keyword"), k.alias("ord"), F.col("p_brand").alias("label"))
    return keywords.first_keywords(spread(table(spark, sf_dir, "documents")), words, "doc_id", "text")


_HALVES = "SELECT o_orderkey, o_orderkey % 2 AS half, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) AS place, (SELECT count(*) FROM orders) AS numbers FROM orders"


@query(f"SELECT 'B' || printf('%09d', o_orderkey) AS booking_id, half, place, numbers, numbers AS most FROM ({_HALVES})")
def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the orders appended to one ledger at the same time: each half's
    numbers follow one another, and all together are 1, 2, ... without gap or repeat."""
    path = f"{shared_dir(spark)}/two-writers-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders")
    values = {"booking_id": F.format_string("B%09d", "o_orderkey"), "total_amount": F.col("o_totalprice"), "notes": (F.col("o_orderkey") % 2).cast("string")}
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], readers.LEDGER_SCHEMA).schema.fields if f.name not in values]
    rows = o.select(*blank, *[v.alias(k) for k, v in values.items()])
    with ThreadPoolExecutor(2) as writers:
        list(writers.map(lambda half: ledger.append(spark, rows.where(F.col("notes") == half), path, ["booking_id"]), ("0", "1")))
    got = readers.ledger(spark, path).select("booking_id", F.col("notes").cast("long").alias("half"), "sno")
    of_half = got.groupBy("half").agg(F.min("sno").alias("first"))
    whole = got.agg(F.countDistinct("sno").alias("numbers"), F.max("sno").alias("most"))
    # two rows, and one
    return got.join(F.broadcast(of_half), "half").join(F.broadcast(whole)).select("booking_id", "half", (F.col("sno") - F.col("first") + 1).alias("place"), "numbers", "most")


def _round(i: int, key: int) -> str:
    stirred = f"(r + {key}) * (r + {key}) % 2147483647 * (r + {key}) % 2147483647 % 100000"
    return f"f{i + 1} AS (SELECT o_orderkey, sno, r AS l, (l + {stirred}) % 100000 AS r FROM f{i})"


_ROUNDS = ", ".join(_round(i, k) for i, k in enumerate(S.round_keys("books")))


@query(f"""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS sno FROM orders), f0 AS (SELECT o_orderkey, sno, sno // 100000 AS l, sno % 100000 AS r FROM n), {_ROUNDS}
SELECT o_orderkey, sno, '098-' || printf('%010d', l * 100000 + r) AS document_no, sno AS back, 1 AS bearers FROM f6""")
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document numbers made of ledger numbers: no two alike, and the ledger number comes back."""
    n = ledger.numbered(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"])
    n = n.withColumn("document_no", S.numbered_document(F.lit("098"), F.col("sno"), "books"))
    back = S.unscrambled(F.substring("document_no", 5, 10).cast("long"), "books")
    return n.select("o_orderkey", F.col("sno").cast("long").alias("sno"), "document_no", back.alias("back"), F.count("*").over(Window.partitionBy("document_no")).alias("bearers"))


@query("""SELECT page_id, CASE WHEN filename IS NULL THEN 'no file' WHEN filename = '' THEN 'no file name' WHEN NOT ends_with(lower(filename), '.pdf') THEN 'not a pdf'
  WHEN bytes > 15728640 THEN 'too large' WHEN page_id % 7 = 6 THEN 'not a pdf inside' END AS refused
FROM (SELECT page_id, CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN url ELSE url || (CASE WHEN page_id % 2 = 0 THEN '.PDF' ELSE '.pdf' END) END AS filename,
  CASE WHEN page_id % 7 = 5 THEN 15728640 + length(html) ELSE length(html) END AS bytes FROM pages)""")
def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads: why each is refused, if it is."""
    k, url = F.col("page_id") % 7, F.col("url")
    name = F.when(k == 0, None).when(k == 1, "").when(k == 2, url).otherwise(F.concat(url, F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(".pdf")))
    length = F.length("html").cast("long") + F.when(k == 5, readers.MOST_UPLOAD_BYTES).otherwise(0)
    inside = F.when(k == 6, F.lit(b"<html>")).otherwise(F.lit(b"%PDF-1.7"))
    return table(spark, sf_dir, "pages").select("page_id", readers.upload_error(name, length, inside).alias("refused"))


_HEADS = ("AI ", "6E-", "AIX ", "ZZ ", "BAW")
_AS_OF = "2026-01-02 03:04:05"


#: A task makes the forms of so many lines: a line becomes ten keys, and files' bytes do not tell that.
LINES = 60_000


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES))


def _trips(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Orders as submitted forms: their lines are flights, the odd ones travellers too.
    With ``tasks``, lines and orders are dealt into so many by order before they become
    keys, which are several times as large, so the keys of a form lie together."""
    dealt_by = lambda name, key: table(spark, sf_dir, name).repartition(tasks, key) if tasks else table(spark, sf_dir, name)
    li = dealt_by("lineitem", "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_shipdate").alias("d"), F.min("l_suppkey").alias("s"))
    i, p, s = F.col("l_linenumber").cast("string"), F.col("p"), F.col("s")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    put = lambda k, v: F.struct(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in k]).alias("key"), v.cast("string").alias("value"))
    clock = lambda hour: F.format_string("%02d:%02d", hour % 24, s % 60)
    flight = lambda name, v: put(("flight_", i, f"_{name}"), v)
    lines = F.array(
        flight("flight_no", F.concat(pick(_HEADS, s), (p % 900 + 100).cast("string"))), flight("date", F.date_format("d", "yyyy-MM-dd")),
        flight("from_code", pick(("del", "BOM", "Q9X"), p)), flight("to_code", pick(("HYD", "lhr"), s)),
        flight("dep_time_raw", clock(p)), flight("arr_time_raw", clock(p + 2)), flight("dep_time", F.concat(clock(p), F.lit(" hrs"))),
        flight("layover", F.when(F.col("l_linenumber") == 5, "Self transfer")),
        put(("pax_", i, "_name"), F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("P"), s.cast("string")))),
        put(("pax_", i, f"_{dims.DOCUMENT_FIELD}"), F.concat(F.lit(" N"), s.cast("string"))),
    )
    o, k = dealt_by("orders", "o_orderkey"), F.col("o_orderkey")
    key = k.cast("string")
    rest = F.array(
        put(("pnr",), F.concat(F.lit("P"), key)), put(("booking_id",), F.format_string("B%09d", k)), put(("customer_phone",), F.lit(" 123 ")),
        put(("flight_count",), F.when(k % 7 == 0, "0")), put(("base_fare",), F.round("o_totalprice", 2)), put(("taxes_fees",), F.when(k % 10 == 0, "x").otherwise("10.25")),
        put(("discount",), F.when(k % 2 == 0, "5")), put(("refund_status",), F.when(k % 4 == 0, "Non-Refundable fare")), put(("is_dummy",), F.when(k % 6 == 0, "true")),
        put(("payment_method",), F.when(k % 3 == 0, "Credit Card")),
    )
    kv = li.select(F.col("l_orderkey").alias("request_id"), F.explode(lines).alias("kv")).unionByName(o.select(F.col("o_orderkey").alias("request_id"), F.explode(rest).alias("kv")))
    return kv.select("request_id", "kv.key", "kv.value").where("value IS NOT NULL")


_TRIPS = f"""{_LINES.replace('l AS (', 'li AS (')}, {_AIRLINES}, lf AS (SELECT l_orderkey AS request_id, i AS idx, (['AI ', '6E-', 'AIX ', 'ZZ ', 'BAW'])[(s % 5 + 1)::INT] || (p % 900 + 100) AS flight_no,
  (['AI', '6E', 'IX', 'ZZ', 'BA'])[(s % 5 + 1)::INT] AS airline_code, (['DEL', 'BOM', 'Q9X'])[(p % 3 + 1)::INT] AS from_code, (['HYD', 'LHR'])[(s % 2 + 1)::INT] AS to_code,
  (['Delhi (DEL)', 'Mumbai (BOM)', 'Q9X'])[(p % 3 + 1)::INT] AS from_full, (['Hyderabad (HYD)', 'London (LHR)'])[(s % 2 + 1)::INT] AS to_full, strftime(d, '%a, %d %b %Y') AS date,
  printf('%02d:%02d', p % 24, s % 60) AS dep, date_trunc('day', d) + to_minutes((p % 24 * 60 + s % 60)::INT) AS dep_at, CASE WHEN i = 5 THEN 'Self transfer' ELSE '' END AS manual, 'P' || s AS person FROM li
  UNION ALL SELECT o_orderkey, 0, '', '', '', '', '', '', '', '', NULL, '', '' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM li) AND o_orderkey % 7 <> 0),
fl AS (SELECT lf.*, coalesce(airline.name, '') AS airline, row_number() OVER r - 1 AS position, epoch(dep_at)::BIGINT - epoch(lag(dep_at + INTERVAL 2 HOUR) OVER r)::BIGINT AS sec
  FROM lf LEFT JOIN airline ON airline.iata = airline_code WINDOW r AS (PARTITION BY request_id ORDER BY idx)),
nested AS (SELECT o_orderkey AS request_id, count(fl.idx) AS segments, coalesce(min(CASE WHEN position = 0 THEN from_code END) || ' → ' || arg_max(to_code, position), 'N/A') AS route,
  coalesce(string_agg(flight_no, ', ' ORDER BY position), '') AS flight_nos, coalesce(min(CASE WHEN position = 0 THEN date END), '') AS travel_date,
  coalesce(min(CASE WHEN position = 0 AND dep <> '' THEN dep || ' hrs' END), '') AS departure_time, coalesce(string_agg(CASE WHEN idx % 2 = 1 THEN person END, ',' ORDER BY idx), '') AS people,
  greatest(count(CASE WHEN idx % 2 = 1 THEN 1 END), 1) AS n_people, coalesce(arg_min(CASE WHEN idx % 2 = 1 THEN person END, CASE WHEN idx % 2 = 1 THEN idx END), '') AS lead,
  min(CASE WHEN position = 0 THEN airline END) AS first_airline
  FROM orders LEFT JOIN fl ON fl.request_id = o_orderkey GROUP BY o_orderkey),
money AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE round(o_totalprice, 2) END AS base, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 10.25::DOUBLE END AS tax, CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 2 = 0 THEN 5 ELSE 0 END AS disc FROM orders)"""


@query(f"""WITH {_TRIPS} SELECT request_id, idx, position, flight_no, airline_code, airline, from_full, to_full, date,
  CASE WHEN dep = '' THEN '' ELSE strftime(dep_at - INTERVAL 60 MINUTE, '%H:%M') END AS checkin_closing,
  CASE WHEN position > 0 AND manual <> '' THEN manual WHEN sec > 0 THEN (sec // 3600) || 'h ' || (sec % 3600 // 60) || 'm (' || CASE WHEN sec >= 10800 THEN 'Long' ELSE 'Short' END || ' layover)' END AS layover FROM fl""")
def booked_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = itinerary.flights(_trips(spark, sf_dir), spark, dims.airports(spark))
    return f.select("request_id", F.col("idx").cast("long").alias("idx"), F.col("position").cast("long").alias("position"), "flight_no", "airline_code", "airline", "from_full", "to_full", "date", "checkin_closing", "layover")


@query(f"""WITH {_TRIPS} SELECT request_id, idx, position, nullif(flight_no, '') AS flight_no, CASE WHEN dep <> '' THEN dep || ' hrs' END AS dep_time, nullif(manual, '') AS layover FROM fl""")
def submitted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms sent as url-encoded bodies, and their flights read from those."""
    bodies = readers.form_body(_trips(spark, sf_dir), ["key", "value"])
    w = itinerary.wide(readers.form_bodies(bodies), "flight", itinerary.FLIGHT_FIELDS, "flight_no", "flight_count")
    return w.select("request_id", F.col("idx").cast("long").alias("idx"), F.col("position").cast("long").alias("position"), "flight_no", "dep_time", "layover")


@query(f"""WITH {_TRIPS} SELECT request_id, segments, route, flight_nos, people, n_people, round(base + tax - disc, 2) AS total,
  'Base Fare=INR ' || format('{{:,.2f}}', base) || ';Airline Taxes & Fees=INR ' || format('{{:,.2f}}', tax) || CASE WHEN disc <> 0 THEN ';Discount=INR -5.00' ELSE '' END AS lines,
  request_id % 4 = 0 AS alert, first_airline AS airline, CASE WHEN request_id % 3 = 0 THEN 'Credit Card' ELSE 'UPI' END AS paid FROM nested JOIN money USING (request_id)""")
def nested_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested record of each form, written as JSON and partly read back."""
    tasks = _tasks(spark, sf_dir)
    # ten airports, whose size Spark knows only when it has read them: until then their join would deal all flights
    b = itinerary.bookings(_trips(spark, sf_dir, tasks), spark, F.broadcast(dims.airports(spark)), F.lit(_AS_OF).cast("timestamp"), tasks)
    people = F.transform("travellers", lambda t: t["name"])
    b = b.withColumn("json", S.as_json("route", "flights", "travellers", "fare_lines"))
    return b.select(
        "request_id", F.size("flights").cast("long").alias("segments"), F.get_json_object("json", "$.route").alias("route"), F.array_join("flights.flight_no", ", ").alias("flight_nos"),
        F.array_join(people, ",").alias("people"), F.size("travellers").cast("long").alias("n_people"), F.round("total_fare", 2).alias("total"),
        F.array_join(F.transform("fare_lines", lambda x: F.concat(x["label"], F.lit("="), x["shown"])), ";").alias("lines"), F.col("refund_alert").alias("alert"),
        F.get_json_object("json", "$.flights[0].airline").alias("airline"), F.col("payment_method").alias("paid"),
    )


@query(f"""WITH {_TRIPS} SELECT row_number() OVER (ORDER BY request_id) AS sno, '{_AS_OF}' AS generated_on, 'Direct' AS booking_platform, 'P' || request_id AS pnr, 'B' || printf('%09d', request_id) AS booking_id,
  lead AS lead_passenger, n_people::INT AS total_pax, '123' AS customer_phone, route, travel_date, departure_time, flight_nos, round(base + tax - disc, 2) AS total_amount,
  CASE WHEN request_id % 3 = 0 THEN 'Credit Card' ELSE 'UPI' END AS payment_mode, 'REGULAR' AS fare_type, CASE WHEN request_id % 4 = 0 THEN 'Non-Refundable fare' ELSE 'Refundable' END AS refund_status,
  'Confirmed' AS flight_status, '' AS notes FROM nested JOIN money USING (request_id) WHERE request_id % 6 <> 0""")
def ledger_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms to ledger rows: nested, without dummies, numbered."""
    as_of, tasks = F.lit(_AS_OF).cast("timestamp"), _tasks(spark, sf_dir)
    rows = ledger.ledger_rows(itinerary.bookings(_trips(spark, sf_dir, tasks), spark, F.broadcast(dims.airports(spark)), as_of, tasks), as_of)
    with Tables(spark, "ledger-rows") as tables:
        rows = ledger.numbered(tables.put(ledger.real(rows), "unnumbered"), ["booking_id"], put=tables.keep).drop("is_dummy")
    return rows.withColumns({"total_amount": F.round("total_amount", 2), "sno": F.col("sno").cast("long")})


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, printf('%06d', o_orderkey) AS n, strftime(o_orderdate, '%Y-%m-%d') AS day, chr((65 + o_orderkey % 26)::INT) AS c FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'Paytm' WHEN 1 THEN 'Cleartrip' WHEN 2 THEN 'Goibibo' WHEN 3 THEN 'MakeMyTrip' ELSE '' END AS booking_platform,
  CASE WHEN k = 0 OR k = 2 THEN 'Z' || n WHEN k = 4 THEN 'Y' || n ELSE '' END AS pnr, CASE WHEN k = 1 THEN 'CT' || n ELSE '' END AS booking_id,
  CASE WHEN k = 0 THEN day ELSE '' END AS booking_date, CASE WHEN k = 2 THEN '98765 43210' ELSE '' END AS customer_phone, CASE WHEN k = 2 THEN 'A' || n || '@EXAMPLE.ORG' ELSE '' END AS customer_email,
  CASE WHEN k = 0 THEN 'Anna Xa' || lower(c) || 'b' WHEN k = 1 THEN 'Cleartrip,Trip Id: Ct' || n || ',Ann Plain' WHEN k = 2 THEN 'Ann O''Neil' WHEN k = 3 THEN 'Max Two' WHEN k = 4 THEN 'Ada Byron' ELSE '' END AS people,
  CASE WHEN k = 0 THEN 'HYD-DEL 15:40 18:00 AI 123 Air India;HYD-DEL - 15:40 18:00' WHEN k = 1 THEN 'HYD-BOM 2026-04-03 09:05 11:10 AI 201 Air India' WHEN k = 2 THEN '- AI 0123 Air India' WHEN k = 3 THEN 'DEL-HYD BA 77 British Airways'
    WHEN k = 4 THEN 'BOM-DEL - 07:00 08:30' WHEN k = 5 THEN '' ELSE '' END AS flights FROM o""")
def extract_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed in the layouts of several platforms, and as papers that give no record."""
    o, k = spread(table(spark, sf_dir, "orders")), F.col("o_orderkey")
    n, kind = F.format_string("%06d", k), k % 8
    letter = F.char(k % 26 + 65)
    page = lambda *lines: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    many = [f"ROUTE HYD-DEL {h:02d}:00" for h in range(7)]
    text = (
        F.when(kind == 0, page("paytm", "Flight PNR", line("AI-123 Z", n), line("Booked on ", F.date_format("o_orderdate", "d MMM yyyy")), line("Mrs Anna Xa", letter, "b"), "AI 123", "HYD 15:40 to 18.00 DEL"))
        .when(kind == 1, page("Cleartrip", line("Trip ID: CT", n), "Ann Plain", "Route HYD-BOM 3/4/26 09:05 11:10 AI 201"))
        .when(kind == 2, page("Goibibo", line("PNR: Z", n), "mr.  ann   o'neil", line("mail a", n, "@example.org tel +98765 43210"), "AI 0123 HYD 15:40 to 18:00 DEL"))
        .when(kind == 3, page("on MakeMyTrip 2020", "Ms Max Two", "Ms Max Two", "FLIGHT BA 77 FROM DEL TO HYD"))
        .when(kind == 4, page(line("Booking Ref: Y", n), "PASSENGER 1", "Miss Ada Byron", "Depart BOM DEL QQQ 7:00 8.30"))
        .when(kind == 5, page("BOARDING", *many))
        .when(kind == 6, page("MakeMyTrip by Fly Papers", line("PNR: Z", n)))
        .otherwise(page("nothing of that kind", "HYD-DEL"))
    )
    r = extract.records(o.select("o_orderkey", F.lit("a.pdf").alias("filename"), text.alias("text")), ["HYD", "DEL", "BOM"], always_own=("Fly Papers",))
    shown = lambda f: F.concat_ws(" ", F.concat_ws("-", F.coalesce(f["from_code"], F.lit("")), F.coalesce(f["to_code"], F.lit(""))), f["date"], F.when((f["date"].isNull()) & (f["dep_time_raw"].isNotNull()) & (f["flight_no"].isNull()), "-"), f["dep_time_raw"], f["arr_time_raw"], f["flight_no"], f["airline"])
    fields = ("booking_platform", "pnr", "booking_id", "booking_date", "customer_phone", "customer_email")
    return r.select("o_orderkey", *fields, F.array_join(F.transform("passengers", lambda p: p["name"]), ",").alias("people"), F.array_join(F.transform("flights", shown), ";").alias("flights"))


@query("""WITH k AS (SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice, 2) AS total FROM orders),
l AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS segments, min('Q' || (l_suppkey % 90 + 10)) AS hub FROM lineitem GROUP BY l_orderkey)
SELECT n_name AS nation, count(*) AS bookings, sum(segments)::BIGINT AS segments, round(sum(total), 2) AS total, min(hub) AS first_hub
FROM k JOIN l ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def booking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: bookings with their segments, enriched and summed by nation."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("total"))
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("segments"), F.min(F.concat(F.lit("Q"), (F.col("l_suppkey") % 90 + 10).cast("string"))).alias("hub"))  # noqa: E741
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    b = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return b.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("bookings"), F.sum("segments").alias("segments"), F.round(F.sum("total"), 2).alias("total"), F.min("hub").alias("first_hub"))
