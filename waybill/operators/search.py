"""Ranked search over a place dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.scalars import strip, text
from waybill.session import Tables, dealt

#: Characters of a query that find its candidates.
GRAM = 3
#: Places of a task: each lists as many grams as its name is long, three times over.
PLACES = 1 << 15


def priority(code: Column, city: Column, name: Column, query: Column) -> Column:
    """0 exact code, 1 code begins, 2 city begins, 3 name contains, else null.

    ``startswith`` and ``contains`` rather than LIKE: queries may hold % or _."""
    return (
        F.when(code == query, 0)
        .when(F.startswith(code, query), 1)
        .when(F.startswith(F.upper(city), query), 2)
        .when(F.contains(F.upper(name), query), 3)
    )


def top_matches(places: DataFrame, query: str, most: int = 15, scan_limit: int | None = None) -> DataFrame:
    """The best matches of (code, city, airport, country, ord) for a query.

    Ties go by ``ord``.  With ``scan_limit`` the scan in order of ``ord`` stops
    at the first match of priority over 1 that has at least that many matches up
    to it (30 behaves as an early-exit search does, and can miss later ones).
    An empty query matches nothing."""
    wanted = query.strip().upper()
    found = places.withColumn("priority", priority(F.col("code"), F.col("city"), F.col("airport"), F.lit(wanted)))
    found = found.where(F.col("priority").isNotNull() & F.lit(wanted != ""))
    if scan_limit is not None:
        # the place where the scan may stop comes from the first matches, then from a minimum
        head = found.select("ord").orderBy("ord").limit(scan_limit).agg(F.count("*").alias("n"), F.max("ord").alias("ord")).first()
        if head["n"] >= scan_limit:
            stop = found.where((F.col("ord") >= head["ord"]) & (F.col("priority") > 1)).agg(F.min("ord")).first()[0]
            if stop is not None:
                found = found.where(F.col("ord") <= stop)
    return found.orderBy("priority", "ord").limit(most).select("code", "city", "airport", "country", "priority")


def batch_matches(places: DataFrame, queries: DataFrame, most: int = 15) -> DataFrame:
    """The same for a table of (query_id, query), without comparing all with all.

    Each distinct query is searched once.  Its first ``GRAM`` characters (a
    shorter one: all) are among the first characters of a code or city that
    begins with it, and among the grams of a name that contains it: a place lists
    those, as many as its name is long, and an equi-join finds the candidates,
    which are then ranked by the whole query."""
    asked = queries.select("query_id", F.upper(strip(text(F.col("query")))).alias("q")).where("q <> ''")
    begins = lambda c: F.array(*[F.substring(c, 1, n) for n in range(1, GRAM + 1)])
    grams = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    code, city, name = (F.coalesce(F.upper(c), F.lit("")) for c in ("code", "city", "airport"))
    keyed = dealt(places, PLACES).withColumn("gram", F.explode(F.array_distinct(F.concat(begins(code), begins(city), *[grams(name, n) for n in range(1, GRAM + 1)]))))
    best = Window.partitionBy("q").orderBy("priority", "ord")
    with Tables(asked.sparkSession, "search") as tables:
        # written, so that Spark knows their size and broadcasts them while they are small: then
        # neither the places' grams nor the queries are dealt by a key that many of them share
        each = tables.put(asked.select("q").distinct().withColumn("gram", F.substring("q", 1, GRAM)), "each")
        met = each.join(keyed, "gram").withColumn("priority", priority(F.col("code"), F.col("city"), F.col("airport"), F.col("q")))
        met = met.where(F.col("priority").isNotNull()).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
        met = tables.keep(met.select("q", "rank", "code", "city", "airport", "country", "priority"), "matches")
    return asked.join(met, "q").select("query_id", "rank", "code", "city", "airport", "country", "priority")


def place_info(places: DataFrame, codes: DataFrame) -> DataFrame:
    """code, found, city, airport, country for each asked code."""
    asked = codes.select(F.upper(strip(text(F.col("code")))).alias("code"))
    info = places.select("code", "city", "airport", "country").withColumn("found", F.lit(True))
    return asked.join(info, "code", "left").select("code", F.coalesce("found", F.lit(False)).alias("found"), "city", "airport", "country")
