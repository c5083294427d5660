"""Source divergence audit: how far the sources of a language differ in their words.

Terms are runs of letters (ASCII letters, lower-cased, and everything beyond ASCII); a
language keeps those in at least ``MIN_DOCS`` of its documents.  Each (language, source)
group, and each language as a whole, gives every kept term a smoothed share
p = 1 + floor(10**9 * (count + 2) / (N + 2 V)); two shares differ by
f = floor((p - q)**2 / (p + q)).

Part ``pair`` ranks a group's other sources by f summed over all kept terms, part
``term`` the group's ten terms that stand out most from the language.

Deduplicated columns: terms with the same counts in the same sources contribute the
same, so they become one vector with a multiplicity (two 64-bit digests, the number of
sources and the total tell vectors apart).  A pair of sources (a, b) is evaluated once
for each vector that both have, by f(a, b) - f(a, 0) - f(0, b) + f(0, 0), once for each
count that one of them has, by f(a, 0) - f(0, 0), and once for the terms neither has;
the sum is exact.  Terms come back for the ranking: of each vector the first ten, since
a group's list cannot hold more of one.

All arithmetic is in integers (decimals where 10**9 times a count may pass a long).
Tasks count their documents' terms in bounded dictionaries, which are added up in Spark.

Defined results: null text, lang and source count as ''; groups without terms have rows
all the same, with value 0 for a language that keeps no term; a language's only source
has no pairs; repeated rows are documents of their own; long texts are read in pieces;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import Tables, dealt_table, small_batches, stored

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_MARK = re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of text read at a time, and terms that a task holds before it passes them on.
PIECE, HELD, BATCH_BYTES = 1 << 20, 300_000, 1 << 22


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of each piece of a text, in order."""
    text, lo = text.lower(), 0
    while lo < len(text):
        end = _MARK.search(text, lo + PIECE) if len(text) - lo > PIECE else None
        hi = end.start() if end else len(text)
        yield _TERM.findall(text, lo, hi)
        lo = hi


def terms_of(text: bytes) -> Counter:
    """How often each term occurs."""
    return Counter(chain.from_iterable(term_lists(text)))


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: each task's part of the counts.  A
    group's row with a null term says that the group occurs."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = documents.select(blank("lang"), blank("source"), blank("text")).select("lang", "source", F.col("text").cast("binary").alias("text"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}  # of occurrences and of documents
        seen: set[tuple] = set()
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs) in held.items():
                new, size = (lang, source) not in seen, len(counts)
                seen.add((lang, source))
                none = [0] * new
                columns = [
                    pa.repeat(pa.scalar(lang, pa.string()), size + new), pa.repeat(pa.scalar(source, pa.string()), size + new), pa.array([None] * new + list(counts), pa.binary()),
                    pa.array(none + list(counts.values()), pa.int64()), pa.array(none + [docs[t] for t in counts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()
            if len(seen) > HELD:
                seen.clear()

        for b in small_batches(rows, "text", BATCH_BYTES):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                counts, docs = held[lang, source]
                before, own = len(counts), set()
                for terms in term_lists(text):
                    counts.update(terms)
                    own.update(terms)
                docs.update(own)
                size += 1 + len(counts) - before
            if size > HELD:
                yield from passed_on()
                size = 0
        yield from passed_on()

    parts = rows.mapInArrow(batches, "lang string, source string, term binary, n long, docs long")
    return parts.withColumn("term", F.col("term").cast("string"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term that occurs n times; null for a language without kept terms."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    below = F.nullif((total + 2 * terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (1 + F.call_function("div", top, below)).cast("long")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _kept_counts(documents: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(groups, kept): lang, source, total, terms of every group; lang, source, term, n
    and the vector's names d1, d2, wide, sum of every kept term."""
    # tasks have added up their documents, so terms are dealt as they are, once: for the sums and for the window
    counts = term_counts(documents).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    column = Window.partitionBy("lang", "term")
    digest = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "source", "n")).over(column)
    kept = counts.withColumns({"d1": digest(1), "d2": digest(2), "wide": F.count("*").over(column), "sum": F.sum("n").over(column), "in_docs": F.sum("docs").over(column)})
    occurs = F.col("term").isNull()  # a group's own row
    both = tables.put(kept.where((F.col("in_docs") >= MIN_DOCS) | occurs).select("lang", "source", "term", "n", "d1", "d2", "wide", "sum"), "kept")
    kept = both.where(~occurs)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    groups = both.where(occurs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    return tables.put(groups.na.fill(0, ["total", "terms"]), "groups"), kept


def _pairs(groups: DataFrame, vectors: DataFrame, vector: list[str]) -> DataFrame:
    """lang, source, item, value for each two sources of a language, both ways."""
    zero = groups.withColumn("none", share(F.lit(0), F.col("total"), F.col("terms")))
    side = lambda x: zero.select("lang", F.col("source").alias(x), F.col("none").alias(f"none_{x}"), "terms")
    both = side("a").join(side("b").drop("terms"), "lang").where("a <> b")
    base = both.select("lang", "a", "b", (F.col("terms") * gap(F.col("none_a"), F.col("none_b"))).alias("value")).where("a < b")

    # what a source alone has, once for each of its counts
    counts = vectors.groupBy("lang", F.col("source").alias("a"), F.col("p")).agg(F.sum("times").alias("times"))
    alone = counts.join(both, ["lang", "a"])
    step = F.col("times") * (gap(F.col("p"), F.col("none_b")) - gap(F.col("none_a"), F.col("none_b")))
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), step.alias("value"))

    # what both have, once for each vector
    with_none = vectors.join(zero.select("lang", "source", "none"), ["lang", "source"])
    of = lambda x: with_none.select(*vector, F.col("source").alias(x), F.col("p").alias(f"p_{x}"), F.col("none").alias(f"none_{x}"), F.col("times").alias(f"times_{x}"))
    met = of("a").join(of("b"), vector).where("a < b")
    pa_, pb, na, nb = (F.col(c) for c in ("p_a", "p_b", "none_a", "none_b"))
    together = met.select("lang", "a", "b", (F.col("times_a") * (gap(pa_, pb) - gap(pa_, nb) - gap(na, pb) + gap(na, nb))).alias("value"))

    parts = [df.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for df in (base, alone, together)]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return total.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def _terms(groups: DataFrame, kept: DataFrame, vectors: DataFrame, vector: list[str]) -> DataFrame:
    """lang, source, item, value of the terms that may be among a group's first."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.first("terms").alias("terms"))
    q = share(F.col("sum"), F.col("all"), F.col("terms"))
    stand_out = vectors.join(whole, "lang").withColumn("q", q).where("p > q").select(*vector, "source", gap(F.col("p"), F.col("q")).alias("value"))
    first = Window.partitionBy(*vector).orderBy("term")
    names = kept.select(*vector, "term").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= TOP).select(*vector, F.col("term").alias("item"))
    return stand_out.join(names, vector).select("lang", "source", "item", "value")


def divergence(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    vector = ["lang", "d1", "d2", "wide", "sum"]
    with Tables(documents.sparkSession, "divergence") as tables:
        groups, kept = _kept_counts(documents, tables)
        vectors = kept.groupBy(*vector, "source", "n").agg(F.count("*").alias("times"))
        p = share(F.col("n"), F.col("total"), F.col("terms"))
        vectors = tables.put(vectors.join(groups, ["lang", "source"]).select(*vector, "source", p.alias("p"), "times"), "vectors")
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = _pairs(groups, vectors, vector).withColumn("rank", F.row_number().over(best))
        terms = _terms(groups, kept, vectors, vector).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
        columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        return stored(columns(pairs, "pair").unionByName(columns(terms, "term")), "divergence")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(dealt_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), kept AS MATERIALIZED (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10
), c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY ALL) USING (lang)
), p AS MATERIALIZED (
  SELECT g.lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v))::HUGEINT AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)))::HUGEINT AS q
  FROM p JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), t AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source)
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
FROM t QUALIFY rank <= 10
"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLES = {"op12_source_divergence": ORACLE}
