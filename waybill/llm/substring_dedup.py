"""Substring dedup: words of repeated 50-word windows go from all but the first document.

A window is ``WINDOW`` consecutive words of one document.  A word is removed if
a window covers it whose word sequence also starts in a document with a smaller
doc_id.

1. Equal word sequences: each document but the one with the smallest doc_id is
   covered wholly by repeated windows and needs no further search.
2. Candidate passages: winnowing chooses, in each window, the smallest hash of
   its ``PHRASE``-word phrases; equal windows choose equal phrases.  A phrase
   that two different texts choose is a recurring phrase.  A bit table sized by
   their number tells all tasks of them (beyond its bound it lets more through).
3. Confirming: only windows whose chosen phrase recurs are hashed whole and
   grouped; the group's smallest doc_id owns the window.  What is shuffled
   follows the repeated text, once per window and document.
4. Locating: each document gets the windows that others own and streams its
   words once more to find every occurrence.

Step 4 uses window hashes where sharded Aho-Corasick automata were meant: the
phrases of step 2 grow with the corpus, so every document would have to pass
every shard, which is quadratic (the README has figures).
:func:`locate_phrases` is that operator, for phrase tables that stay small.

Hot windows: groups are aggregated map-side, and the join that brings owners
back to documents is between two written tables, so that adaptive execution
can split a window that a third of all documents contain.

Defined results: null, empty and shorter texts lose nothing; every input row
gives one row; rows of one doc_id never remove from one another; a null doc_id
is neither smaller nor larger than another, so such rows lose and remove
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import Tables, bit_table, flagged, in_table, read_table, small_batches, stored, table_bits
from waybill.llm.words import ODD, hashed_words, mixed, sliding_min, window_hashes

WINDOW = 50
PHRASE = 25
BATCH_BYTES = 1 << 19


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    if not texts:
        return []
    hashes, counts = hashed_words([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    return np.split(hashes, np.cumsum(counts)[:-1])


def sequence_key(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def chosen_phrases(h: np.ndarray) -> np.ndarray:
    """The winnowed phrase of each window.  Smallest hashes are small numbers, so
    they are mixed again before their leading bits choose a place in a table."""
    return mixed(sliding_min(window_hashes(h, PHRASE), WINDOW - PHRASE + 1) * ODD)


class _Seen(dict):
    """The smallest doc_id met for each word sequence; bounded."""

    def again(self, key: bytes, doc: int) -> bool:
        if self.get(key, doc + 1) <= doc:
            return True
        if len(self) >= 100_000:
            self.clear()
        self[key] = doc
        return False


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key) of long documents, and (phrase, text) of what they choose."""
    seen = _Seen()
    names = ["doc_id", "key", "phrase", "of"]
    for b in small_batches(batches, "text", BATCH_BYTES):
        docs, keys, phrases, of = [], [], [], []
        for doc, h in zip(b.column(0).to_pylist(), _hashes(b.column(1).to_pylist()), strict=True):
            if len(h) < WINDOW:
                continue
            key = sequence_key(h)
            docs.append(doc)
            keys.append(key)
            if not seen.again(key, doc):
                chosen = np.unique(chosen_phrases(h))
                phrases.append(chosen)
                of.append(np.full(len(chosen), int.from_bytes(key[:8], "big", signed=True)))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(len(docs), pa.int64()), pa.nulls(len(docs), pa.int64())], names=names)
        if phrases:
            x, y = np.concatenate(phrases).view(np.int64), np.concatenate(of)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary()), pa.array(x), pa.array(y)], names=names)


def _windows(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """(window, doc_id): distinct windows of each document whose phrase is one of ``phrases``."""
    bits = table_bits(phrases.count())
    table = bit_table(phrases, F.shiftrightunsigned("phrase", 64 - bits), bits)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for b in small_batches(rows, "text", BATCH_BYTES):
            found, docs = [], []
            for doc, h in zip(b.column(0).to_pylist(), _hashes(b.column(1).to_pylist()), strict=True):
                if len(h) < WINDOW:
                    continue
                near = in_table(table, (chosen_phrases(h) >> np.uint64(64 - bits)).astype(np.int64))
                if not near.any() or seen.again(sequence_key(h), doc):
                    continue
                windows = np.unique(window_hashes(h, WINDOW)[near])
                found.append(windows)
                docs.append(np.full(len(windows), doc))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(docs))], names=["window", "doc_id"])

    return documents.mapInArrow(batches, "window long, doc_id long")


def kept_words(text: str | None, h: np.ndarray, foreign: np.ndarray | None) -> tuple[int, bytes]:
    """(how many words go, the others joined) given the windows others own."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if foreign is None or not len(foreign) or len(h) < WINDOW:
        return 0, b" ".join(words)
    starts = np.flatnonzero(np.isin(window_hashes(h, WINDOW), foreign))
    edge = np.zeros(len(h) + 1, np.int32)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _removing(keep_text: bool):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(rows, "text", BATCH_BYTES):
            out = []
            texts = b.column(1).to_pylist()
            listed = b.num_columns > 2
            hashes = _hashes(texts) if listed else [None] * len(texts)
            foreign = b.column(2) if listed else [None] * len(texts)
            copies = b.column(3).to_pylist() if listed else [None] * len(texts)
            for doc, text, h, f, keys in zip(b.column(0).to_pylist(), texts, hashes, foreign, copies, strict=True):
                if keys and len(h) >= WINDOW and sequence_key(h) in keys:
                    out.append((doc, len(h), len(h), b""))
                    continue
                f = f.values.to_numpy(zero_copy_only=False).view(np.uint64) if listed and f.is_valid else None
                gone, kept = kept_words(text, h if h is not None else np.zeros(0, np.uint64), f)
                out.append((doc, len(h) if h is not None else kept.count(b" ") + 1 if kept else 0, gone, kept))
            ids, n, gone, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.array([k.decode("utf-8", "surrogatepass") if keep_text else None for k in kept], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return batches


def deduplicated(documents: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (null unless ``keep_text``).

    What it returns reads one table of the shared folder (what documents lose)."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    with Tables(documents.sparkSession, "substrings") as tables:
        survey = tables.put(known.mapInArrow(_survey, "doc_id long, key binary, phrase long, of long"), "survey")
        recurring = survey.where("phrase IS NOT NULL").groupBy("phrase").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo < hi")
        recurring = tables.put(recurring.select("phrase"), "recurring")
        keyed = survey.where("key IS NOT NULL").select("doc_id", "key")
        firsts = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        firsts = tables.put(firsts.select("key", "first"), "firsts")
        copies = keyed.join(firsts, "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("copies"))

        windows = tables.put(_windows(known, recurring), "windows")
        owners = windows.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
        owners = tables.put(owners.select("window", "owner"), "owners")
        foreign = tables.put(windows.join(owners, "window").where("doc_id > owner").select("doc_id", "window"), "foreign")
        tables.drop(windows, owners)
        lists = foreign.groupBy("doc_id").agg(F.collect_set("window").alias("foreign"))
        listed = stored(lists.join(copies, "doc_id", "full").select("doc_id", "foreign", "copies"), "losses")

    # most documents have nothing to lose: they stay in their task
    marked = flagged(docs, F.col("doc_id"), listed.select("doc_id"), "loses")
    far = marked.where("NOT loses").select("doc_id", "text").mapInArrow(_removing(keep_text), RESULT)
    near = marked.where("loses").join(listed, "doc_id", "left").select("doc_id", "text", "foreign", "copies").mapInArrow(_removing(keep_text), RESULT)
    return far.unionByName(near)


def locate_phrases(documents: DataFrame, phrases: DataFrame, shard_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, phrase_id, start, end) of every occurrence of every phrase, by
    Aho-Corasick automata over (phrase_id, text) rows, cut into shards of about
    ``shard_chars``; positions count code points, ends are exclusive.

    Each shard is one automaton that all documents stream through.  Overlapping
    occurrences are all reported; empty and null phrases have none."""
    sized = phrases.where("text IS NOT NULL AND text <> ''").select("phrase_id", F.col("text").cast("string"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-total // shard_chars)
    sized = stored(sized.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(max(1, shards)))), "phrases")
    out = None
    for shard in range(shards):
        words = [(r["phrase_id"], r["text"]) for r in sized.where(F.col("shard") == shard).collect()]
        if not words:
            continue

        def batches(rows: Iterator[pa.RecordBatch], words: list = words) -> Iterator[pa.RecordBatch]:
            by_text: dict[str, list] = {}
            for i, w in words:
                by_text.setdefault(w, []).append(i)
            automaton = ahocorasick.Automaton()
            for w, ids in by_text.items():
                automaton.add_word(w, (len(w), ids))
            automaton.make_automaton()
            for b in small_batches(rows, "text", BATCH_BYTES):
                hits = [(d, i, e + 1 - n, e + 1) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for e, (n, ids) in automaton.iter(t) for i in ids]
                cols = list(zip(*hits, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "phrase_id", "start", "end"])

        found = documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, phrase_id long, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else documents.sparkSession.createDataFrame([], "doc_id long, phrase_id long, start long, end long")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS x FROM w, unnest(range(1, greatest(len(w) - 48, 1))) AS t(i)
), own AS (SELECT x, min(doc_id) AS owner FROM win GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, p FROM win JOIN own USING (x), unnest(range(i, i + 50)) AS t(p) WHERE owner < doc_id
), kept AS (
  SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES = {"op10_substring_dedup": ORACLE}
