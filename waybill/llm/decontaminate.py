"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of everything beyond ASCII,
lower-cased in A-Z.  A window is ``WINDOW`` consecutive words of a benchmark
item; an item of fewer words is one window by itself.  A document word is hit
if it lies inside an occurrence of a window.

Winnowing keeps, of each document window, the smallest of its k-gram hashes
(k = ``KGRAM``, so ``WINDOW - KGRAM + 1`` k-grams in each).  Equal windows
choose equal k-grams, hence every shared span of ``WINDOW`` words or more has
a shared fingerprint.  Documents' fingerprints meet the benchmark's twice:
first in a bit table, sized by the benchmark's windows within a bound, that is
sent to all tasks and drops nearly all that match nothing; then the windows
around the remaining ones are joined with the benchmark's windows by their words
themselves, which extends hits and leaves no doubt about hash collisions.  A
benchmark too large for the table's bound lets more candidates through to the
join, with equal results.  Items shorter than a window have fingerprints of
their own length.

Candidates are few beside the input, so what is shuffled follows the hits.
A window that a third of all documents contain is a skewed key of an ordinary
join, which adaptive execution splits.  Documents meet classes of items (those
that share a window), not items, and each combination of classes is turned into
its list of items once, however many documents have it.

Defined results: null or empty texts have no words and no hits; null item
texts have no windows; every input row gives one row, repeated doc_ids too;
item_ids that repeat count once; empty tables give no hits (benchmark) or no
rows (documents); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import Tables, bit_table, dealt_table, drop_rows, in_table, read_table, small_batches, stored, table_bits, unused
from waybill.llm.words import MARKS, ODD, hashed_words, mixed, sliding_min, window_hashes

WINDOW = 10
KGRAM = 5

BATCH_BYTES = 1 << 19


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


_APART = bytes(32 if MARKS[c] else c for c in range(256))


def _split(raw: bytes) -> list[bytes]:
    return raw.translate(_APART).split()


def slots(fingerprints: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Places in the bit table; spans of different length use different ones.
    Smallest hashes are small numbers, so they are mixed once more."""
    return (mixed((fingerprints + np.uint64(length)) * ODD) >> np.uint64(64 - bits)).astype(np.int64)


def window_fingerprints(h: np.ndarray) -> np.ndarray:
    """The winnowed k-gram hash of each full window."""
    return sliding_min(window_hashes(h, KGRAM), WINDOW - KGRAM + 1)


def _prints(h: np.ndarray, n: int) -> np.ndarray:
    return window_fingerprints(h) if n == WINDOW else window_hashes(h, n)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text", BATCH_BYTES):
        rows = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = _raw(text)
            words = _split(raw)
            n = min(len(words), WINDOW)
            if n:
                found = _prints(hashed_words([raw], MARKS)[0], n).view(np.int64).tolist()
                rows += [(item, n, x, b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass")) for i, x in enumerate(found)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["item_id", "n", "print", "window"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id string, n, print, window): all windows of all items."""
    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text IS NOT NULL").mapInArrow(_item_windows, "item_id string, n int, print bigint, window string")


def fingerprint_table(windows: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """The benchmark's fingerprints as a bit table, its bits, and its short items' lengths."""
    sizes = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # WINDOW rows at most
    bits = table_bits(sum(sizes.values()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            at = np.zeros(len(n), np.int64)
            for length in np.unique(n).tolist():
                at[n == length] = slots(found[n == length], length, bits)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    at = windows.select("n", "print").mapInArrow(places, "at long")
    return bit_table(at, F.col("at"), bits), bits, sorted(n for n in sizes if n < WINDOW)


def candidates(documents: DataFrame, table: np.ndarray, bits: int, short: list[int], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words and the document's windows whose fingerprint the
    bit table has: array of (at, n, window)."""
    struct = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("window", pa.string())])

    def near_of(raws: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
        h, counts = hashed_words(raws, MARKS)
        ends = np.cumsum(counts)
        found: list[list[dict]] = [[] for _ in raws]
        words: dict[int, list[bytes]] = {}
        for n in (WINDOW, *short):
            at = np.flatnonzero(in_table(table, slots(_prints(h, n), n, bits)))
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc] if len(at) else np.zeros(0, bool)
            for d, i in zip(doc[inside].tolist(), (at - (ends - counts)[doc])[inside].tolist(), strict=True):
                if d not in words:
                    words[d] = _split(raws[d])
                found[d].append({"at": i, "n": n, "window": b" ".join(words[d][i : i + n]).decode("utf-8", "surrogatepass")})
        return counts, found

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(rows, 0, BATCH_BYTES):
            counts, found = near_of([_raw(t) for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts), pa.array(found, pa.list_(struct))], names=[*b.schema.names[1:], "n_words", "near"])

    (name,) = unused(documents, "text_")
    given = documents.select(F.col("text").cast("string").alias(name), *[F.col(c) for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    return given.mapInArrow(batches, f"{schema + ', ' if schema else ''}n_words bigint, near array<struct<at:int,n:int,window:string>>")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (array), contaminated by row."""
    with Tables(documents.sparkSession, "contamination") as tables:
        windows = tables.put(benchmark_windows(benchmark), "windows")
        table, bits, short = fingerprint_table(windows)
        found = candidates(documents, table, bits, short).withColumn("row", F.monotonically_increasing_id())
        found = tables.put(found, "candidates")

        # windows that the same items have are one class; an item_id that is null lists nothing
        classes = windows.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("class", F.md5(F.to_json("items")))
        classes = tables.put(classes, "classes")
        near = found.where(F.size("near") > 0).select("row", F.explode("near").alias("w")).select("row", "w.at", "w.n", "w.window")
        hits = near.join(classes.select("window", "class"), "window")
        spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans"), F.sort_array(F.collect_set("class")).alias("classes"))
        covered = F.aggregate(
            "spans",
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, s: F.struct(
                F.greatest(a["end"], s["at"] + s["n"]).alias("end"),
                (a["n"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(a["end"], s["at"]))).alias("n"),
            ),
            lambda a: a["n"].cast("long"),
        )
        measured = tables.put(spans.select("row", covered.alias("n_hit"), "classes", F.md5(F.to_json("classes")).alias("set")), "measured")

        sets = measured.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class"))
        listed = sets.join(classes.select("class", "items").dropDuplicates(["class"]), "class").select("set", F.explode("items").alias("item"))
        items = listed.groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))
        measured = measured.select("row", "n_hit", "set").join(items, "set", "left").select("row", "n_hit", "items")
        none = F.coalesce("items", F.array().cast("array<string>"))
        return stored(found.select("row", "doc_id", "n_words").join(measured, "row", "left").select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(none).cast("long").alias("n_items"),
            none.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
        ), "contamination")


def uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns as they were, that contain no benchmark window.

    Contamination is a matter of the text alone, so equal texts (by MD5) go or
    stay together, whatever their doc_ids; only rows that may be listed leave
    their tasks."""
    text = lambda: F.md5(F.col("text").cast("string").cast("binary"))
    with Tables(documents.sparkSession, "contamination") as tables:
        windows = tables.put(benchmark_windows(benchmark), "windows")
        table, bits, short = fingerprint_table(windows)
        texts = documents.select(F.col("text").cast("string").alias("text"), text().alias("key"))
        found = candidates(texts, table, bits, short, ("key",)).where(F.size("near") > 0)
        near = found.select("key", F.explode("near").alias("w")).select("key", "w.window")
        gone = stored(near.join(windows.select("window").distinct(), "window", "left_semi").select("key").distinct(), "contaminated")
    return drop_rows(documents, text(), gone)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(dealt_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS x
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM d, lengths, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS t(i)
), hits AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES = {"op8_decontaminate": ORACLE}
