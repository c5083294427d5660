"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set are its distinct 5-word shingles (a shorter one: its words as one
shingle), as 64-bit hashes; its sketch are the ``SKETCH`` smallest of them (a smaller
set: all).  Documents link when their sets' Jaccard similarity is at least
``PERCENT``; documents that links connect form a component.

1. Equal sets become one (a 128-bit digest of the set stands for it).
2. Inverted lists: the first ``INDEX`` values of a sketch are its retained values.
   Linked sets share at least :func:`least_shared` of them, so that under one global
   order, rare first by a count sketch, they share one of the first of each: those
   are listed.  Values that many documents have (licences, quoted passages) come last
   in the order and are mostly not listed.
3. Overlaps: each list has a head, the member whose sketch has the most common values
   (as an original beside its edited copies).  Each set is paired with the one head
   that most of its lists name; their number is the first estimate of overlap.
4. Union-sketch estimation: how many values two sketches share tells what their sets
   share; pairs with fewer than linked sets of these sizes have go.
5. Exact Jaccard of the full sets, made again from the texts, verifies the rest.
6. The members of all lists with one head form a group.  Groups that hold several of
   the components found so far are read once more, with their members' sketches: the
   shared values of all pairs across components come from one product of the group's
   incidence matrix inside the task, and only pairs that pass the estimate, and that
   the head both were tested against does not rule out (:func:`possible_overlap`),
   become rows.  They are verified in the same way.  Of pairs that are linked for sure
   (their sketches are the sets) those of a spanning tree are enough, and pairs that
   such a tree connects already are left out.

No pairs within a component are formed after step 3, so a group of thousands of near
copies gives about one pair for each.  Large groups are cut into blocks of ``BLOCK`` members,
and pairs of blocks are dealt over tasks.

Exactness: the links found are true ones.  A linked pair is missed in step 2 or 4 with
probability ``LOSS`` at most each (shared values among the smallest are hypergeometric,
with tails below the binomial's); sets whose sketch is the set are never missed.

Defined results: null, empty and white-space texts have no shingles and are alone; a
component's id is its smallest doc_id; every input row gives one row, repeated doc_ids
too; ``kept`` is whether the row's doc_id is that id.  Rows with a null doc_id count as
members but cannot name a component (an all-null one has a null id); they are kept only
if their component has no other rows' id.  An empty table gives no rows; other columns
are ignored, and kept by :func:`deduplicated`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import Tables, dealt_table, drop_rows, small_batches, stored
from waybill.llm.components import component_labels
from waybill.llm.jaccard_join import BATCH_BYTES, SLICE_BITS, needed, order_sketch, set_key, shingle_sets, short, verified
from waybill.llm.jaccard_join import ORACLE as JACCARD_SQL

PERCENT = 85
#: Values of a set that lists retain (whole), and that estimates use (the others' low halves).
INDEX, SKETCH = 32, 192
#: Probability, at most, that a linked pair has fewer shared values than is asked for.
LOSS = 1e-12
#: The order's counters, 2**bits of one byte in each task: between these sizes.
LEAST_BITS, MOST_BITS = 16, 24
#: Members of a group's block; pairs estimated, and values multiplied, at a time.
BLOCK, PAIRS, COLUMNS = 512, 2048, 4096


@lru_cache(maxsize=1024)
def _tail(k: int, p: float, loss: float) -> int:
    """The largest t with at most ``loss`` probability of fewer than t of k, each with p."""
    tail = 0.0
    for t in range(k + 1):
        tail += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > loss:
            return t
    return k


def least_shared(k: int, percent: int = PERCENT, loss: float = LOSS) -> int:
    """Values shared among the k smallest of a linked pair's union, at least, but for
    a probability of ``loss``: the binomial's lower tail bounds the hypergeometric's."""
    return _tail(k, percent / 100, loss)


@lru_cache(maxsize=8)
def _thresholds(percent: int) -> np.ndarray:
    """:func:`fewest` for shares of 0, 0.001, ... 1."""
    return np.array([_tail(SKETCH, max(i, 10 * percent) / 1000, LOSS / 2) for i in range(1001)])


def fewest(na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Values that the sketches of linked sets of these sizes share, at least.

    The sketch with the smaller last value has its shared values in the other one, and
    is a sample of its set, of which a share of I / max(na, nb) at least is in both; I
    is what linked sets have in common.  It may be either, hence half the loss."""
    common = -(-percent * (na + nb) // (100 + percent))
    return _thresholds(percent)[np.minimum(1000, common * 1000 // np.maximum(np.maximum(na, nb), 1))]


def packed(s: np.ndarray) -> bytes:
    """A set's sketch: the first values whole, of the others the low halves."""
    return s[:INDEX].tobytes() + s[INDEX:SKETCH].astype(np.uint32).tobytes()


def retained(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, np.uint64, min(INDEX, len(sketch) // 8))


def codes(sketch: bytes) -> np.ndarray:
    """The sketch's values as 32 bits each; values that meet there only let more pairs through."""
    first = retained(sketch)
    return np.concatenate([first.astype(np.uint32), np.frombuffer(sketch, np.uint32, offset=8 * len(first))])


def listed_length(n: int, percent: int = PERCENT) -> int:
    """How many of the retained values of a set of n shingles are listed."""
    whole = n * 100 <= INDEX * percent  # no linked set has more than INDEX values
    return n - -(-percent * n // 100) + 1 if whole else min(n, INDEX) - least_shared(INDEX, percent) + 1


def summaries_of(documents: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n, sid, and the sketch where the task sees the
    set for the first time."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in small_batches(rows, "text", BATCH_BYTES):
            sizes, keys, sketches = [], [], []
            for s in shingle_sets(b.column(1).to_pylist()):
                key = set_key(s)
                new = key is not None and key not in seen
                if new:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(key)
                sizes.append(len(s))
                keys.append(key)
                sketches.append(packed(s) if new else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n", "sid", "sketch"])

    return documents.select("doc_id", "text").mapInArrow(batches, "doc_id long, n long, sid binary, sketch binary")


def _value_counts(sketches: DataFrame, bits: int) -> DataFrame:
    """Each task's counts of sketches' values by slice of the order's counters."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for b in rows:
            values = [codes(x) for x in b.column(0).to_pylist()]
            at, n = np.unique(_counter(np.concatenate([np.zeros(0, np.uint32), *values]), bits), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 65_535)
        filled = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(counts.reshape(-1, 1 << SLICE_BITS)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in filled], pa.int32()), pa.array([c for _, c in filled], pa.binary())], names=["slice", "counts"])

    return sketches.select("sketch").mapInArrow(batches, "slice int, counts binary")


def _counter(values: np.ndarray, bits: int) -> np.ndarray:
    """The counter of a value: by its low bits, as the high ones of retained values are small."""
    return (values & values.dtype.type((1 << bits) - 1)).astype(np.int64)


def list_entries(sketches: DataFrame, rank: np.ndarray, percent: int) -> DataFrame:
    """(v, s, n, rare): the inverted lists; ``rare`` is less the more common the values of
    the set's sketch are."""
    bits = len(rank).bit_length() - 1
    listed = {n: listed_length(n, percent) for n in range(1, INDEX + 1)}

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            values, owners, sizes, rare = [np.zeros(0, np.uint64)], [], [], []
            for s, n, sketch in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = retained(sketch)
                x = x[np.lexsort((x, rank[_counter(x, bits)]))][: listed[len(x)] if n <= INDEX else listed[INDEX]]
                values.append(x)
                owners += [s] * len(x)
                sizes += [n] * len(x)
                rare += [-int(16 * rank[_counter(codes(sketch), bits)].mean())] * len(x)
            columns = [pa.array(np.concatenate(values).view(np.int64)), pa.array(owners, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rare, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["v", "s", "n", "rare"])

    return sketches.select("s", "n", "sketch").mapInArrow(batches, "v long, s long, n long, rare int")


def same_size(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def may_link(shared: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of these sizes may be linked whose sketches share so many values;
    exactly where both sketches are the sets."""
    whole = (na <= SKETCH) & (nb <= SKETCH)
    return np.where(whole, shared * (100 + percent) >= percent * (na + nb), shared >= fewest(na, nb, percent))


def shared_values(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many values the sketches of each pair share."""
    rows = np.arange(2 * len(a) * SKETCH, dtype=np.uint64).reshape(len(a), 2 * SKETCH) + np.uint64(1 << 32)  # what occurs nowhere else
    for i, pair in enumerate(zip(a, b, strict=True)):
        for j, sketch in enumerate(pair):
            x = codes(sketch)
            rows[i, j * SKETCH : j * SKETCH + len(x)] = x
    rows.sort(axis=1)
    return (rows[:, 1:] == rows[:, :-1]).sum(axis=1)


def _estimated_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the union sketch lets through."""
    side = lambda x: sketches.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sketch_a", "sketch_b")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for lo in range(0, whole.num_rows, PAIRS):
                b = whole.slice(lo, PAIRS)
                keep = may_link(shared_values(b.column(4).to_pylist(), b.column(5).to_pylist()), b.column(2).to_numpy(), b.column(3).to_numpy(), percent)
                yield b.filter(pa.array(keep)).select(["a", "b"])

    return met.mapInArrow(batches, "a long, b long")


def possible_overlap(nx: np.ndarray, nz: np.ndarray, ox: np.ndarray, oz: np.ndarray) -> np.ndarray:
    """The most that two sets can share whose overlaps with one third set are known."""
    return np.minimum(ox, oz) + np.minimum(nx - ox, nz - oz)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared values of each of ``a`` with each of ``b``, as the product of their
    incidence matrices, some values at a time."""
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    values, column, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    kept = often[column]
    owner, column = owner[kept], place[column[kept]]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(often.sum()), COLUMNS):
        inside = (column >= lo) & (column < lo + COLUMNS)
        n = min(COLUMNS, int(often.sum()) - lo)
        m = np.bincount(owner[inside] * n + column[inside] - lo, minlength=(len(a) + len(b)) * n).reshape(-1, n).astype(np.float32)
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


class _Members:
    """Members of groups' blocks that a task reads, as columns; a group's rows follow one another."""

    FIELDS = ("hub", "bi", "bj", "block", "s", "n", "comp", "r", "overlap")

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        for f in self.FIELDS:
            setattr(self, f, table[f].to_numpy())
        self.codes = [codes(x) for x in table["sketch"].to_pylist()]
        new = (np.diff(self.hub) != 0) | (np.diff(self.bi) != 0) | (np.diff(self.bj) != 0)
        self.starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        self.ends = np.append(self.starts[1:], len(self.hub))

    def linked(self, percent: int) -> Iterator[pa.RecordBatch]:
        found = [self._pairs(lo, hi, percent) for lo, hi in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def _pairs(self, lo: int, hi: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets of pairs across components that may be linked."""
        rows = np.arange(lo, hi)
        one_block = self.bi[lo] == self.bj[lo]
        x, y = (rows, rows) if one_block else (rows[self.block[lo:hi] == self.bi[lo]], rows[self.block[lo:hi] == self.bj[lo]])
        side = lambda f: (getattr(self, f)[x][:, None], getattr(self, f)[y][None, :])
        (nx, nz), (cx, cz), (sx, sz), (rx, rz), (ox, oz) = (side(f) for f in ("n", "comp", "s", "r", "overlap"))
        ok = (cx != cz) & (np.minimum(nx, nz) * 100 >= np.maximum(nx, nz) * percent) & (rz != sx) & (rx != sz)
        ok &= sx < sz if one_block else True
        most = possible_overlap(nx, nz, ox, oz)
        ok &= (rx != rz) | (ox < 0) | (oz < 0) | (most * (100 + percent) >= percent * (nx + nz))
        if not ok.any():
            return self.s[:0], self.s[:0]
        shared = overlaps([self.codes[i] for i in x], [self.codes[i] for i in y])
        # three values that meet by chance in a pair of sketches are out of the question
        sure = ok & (nx <= SKETCH) & (nz <= SKETCH) & ((shared - 2) * (100 + percent) >= percent * (nx + nz))
        (i, j), of_x, of_y = spanning(sure | sure.T if one_block else sure, one_block)
        k, m = np.nonzero(ok & may_link(shared, nx, nz, percent) & (of_x[:, None] != of_y[None, :]))
        return np.concatenate([self.s[x[i]], self.s[x[k]]]), np.concatenate([self.s[y[j]], self.s[y[m]]])


def spanning(linked: np.ndarray, square: bool) -> tuple[tuple[list[int], list[int]], np.ndarray, np.ndarray]:
    """(pairs, parts of the rows, parts of the columns): for each connected part of a
    graph, the pairs (row, column) of a spanning tree.  ``square``: rows are columns."""
    of_row, of_column = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    if square:
        of_column = of_row
    rows, columns = [], []
    for start in range(len(of_row)):
        if of_row[start] >= 0:
            continue
        of_row[start] = start
        todo = [(True, start)]
        while todo:
            is_row, at = todo.pop()
            near, of = (linked[at], of_column) if is_row else (linked[:, at], of_row)
            new = np.flatnonzero(near & (of < 0))
            of[new] = start
            rows += [at] * len(new) if is_row else new.tolist()
            columns += new.tolist() if is_row else [at] * len(new)
            todo += [(square or not is_row, i) for i in new.tolist()]
    alone = of_column < 0
    of_column[alone] = len(of_row) + np.flatnonzero(alone)
    return (rows, columns), of_row, of_column


def _pairs_across(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs across components among ``members`` (hub, s, comp, r, overlap,
    blocks) of one hub that the union sketch lets through."""
    block = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "s", "comp", "r", "overlap")
    rows = dealt.join(sketches, "s").select(*_Members.FIELDS, "sketch").repartition("hub", "bi", "bj").sortWithinPartitions("hub", "bi", "bj")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in rows:
            if not b.num_rows:
                continue
            # the last group of a batch may go on in the next one
            key = [b.column(c).to_numpy() for c in range(3)]
            last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or tuple(k[0] for k in key) != tuple(held[-1].column(c)[-1].as_py() for c in range(3))):
                yield from _Members([*held, b.slice(0, cut)]).linked(percent)
                held = []
            elif cut:
                yield from _Members([b.slice(0, cut)]).linked(percent)
            held.append(b.slice(cut))
        if held:
            yield from _Members(held).linked(percent)

    return rows.mapInArrow(batches, "a long, b long")


def links(docs: DataFrame, summaries: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(v, label): the component labels of all sets that have links, by whole key."""
    key = F.conv(F.hex(F.substring("sid", 1, 8)), 16, -10).cast("long")
    classes = tables.put(summaries.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("min_id")).withColumn("s", key), "classes")
    sketches = tables.put(summaries.where("sketch IS NOT NULL").select(key.alias("s"), "n", "sketch").dropDuplicates(["s"]), "sketches")
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(SKETCH // 4 * sketches.count() + 1))))
    rank = order_sketch(_value_counts(sketches, bits), bits, tables)
    entries = tables.put(list_entries(sketches, rank, percent), "entries")

    # each set against the head that most of its lists name
    heads = entries.groupBy("v").agg(F.min(F.struct("rare", "s", "n")).alias("head"), F.count("*").alias("members")).where("members > 1")
    heads = tables.put(heads.select("v", F.col("head.s").alias("hub"), F.col("head.n").alias("hub_n")), "heads")
    lists = tables.put(entries.join(heads, "v").select("s", "n", "hub", "hub_n"), "lists")
    tables.drop(entries, heads)
    named = lists.where("s <> hub").where(same_size(F.col("n"), F.col("hub_n"), percent)).select("s", "hub").repartition("s")
    named = named.groupBy("s", "hub").agg(F.count("*").alias("overlaps")).groupBy("s").agg(F.min(F.struct(-F.col("overlaps"), "hub"))["hub"].alias("hub"))
    heads_of = tables.put(named.select(F.col("hub").alias("a"), F.col("s").alias("b")), "pairs")
    pairs = tables.put(_estimated_pairs(heads_of, sketches, percent), "pairs")
    tested = verified(pairs, docs, classes, tables)
    linked = F.col("overlap") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    labels = component_labels(tested.where(linked), "ka", "kb", tables)

    # pairs across components, in groups that hold several (64 bits of a label name a component)
    comps = tables.put(classes.join(labels.select(F.col("v").alias("sid"), "label"), "sid").select("s", F.xxhash64("label").alias("comp")), "comps")
    known = heads_of.join(tested.select("a", "b", "overlap"), ["a", "b"], "left").select(F.col("b").alias("s"), F.col("a").alias("r"), F.coalesce("overlap", F.lit(-1)).cast("long").alias("overlap"))
    members = lists.select("hub", "s").distinct().join(comps, "s", "left").join(known, "s", "left")
    members = tables.put(members.select("hub", "s", F.coalesce("comp", "s").alias("comp"), F.coalesce("r", "s").alias("r"), F.coalesce("overlap", F.lit(-1).cast("long")).alias("overlap")), "members")
    tables.drop(lists)
    several = members.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    several = several.select("hub", (F.floor(F.col("size") / BLOCK) + 1).cast("int").alias("blocks"))
    across = tables.put(_pairs_across(members.join(several, "hub"), sketches, percent).distinct(), "pairs")
    more = verified(across, docs, classes, tables)
    return component_labels(tested.where(linked).unionByName(more.where(linked)), "ka", "kb", tables)


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    with Tables(documents.sparkSession, "bottom-k") as tables:
        docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
        summaries = tables.put(summaries_of(docs), "summaries")
        labels = links(docs, summaries, percent, tables)
        rows = summaries.select("doc_id", F.col("n").alias("n_shingles"), "sid")
        some, none = rows.where("sid IS NOT NULL"), rows.where("sid IS NULL")
        classes = some.groupBy("sid").agg(F.min("doc_id").alias("min_id"))
        classes = classes.join(labels.select(F.col("v").alias("sid"), "label"), "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"), "min_id")
        classes = tables.put(classes, "classes")
        smallest = tables.put(classes.groupBy("label").agg(F.min("min_id").alias("component_id")), "smallest")
        classes = tables.put(classes.join(smallest, "label").select("sid", "component_id"), "classes")
        found = some.join(classes, "sid").select("doc_id", "n_shingles", "component_id")
        found = found.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        return stored(found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-duplicates")


def deduplicated(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they were, less those whose component has a
    smaller doc_id (rows without a doc_id stay)."""
    gone = near_duplicates(documents, percent).where("doc_id > component_id").select("doc_id").distinct()
    return drop_rows(documents, F.col("doc_id"), gone)


def op11_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(dealt_table(spark, sf_dir, "documents"))


ORACLE = f"""SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept
FROM ({JACCARD_SQL.replace("80 * ((SELECT", "85 * ((SELECT")})"""

QUERIES = {"op11_bottom_k": op11_bottom_k}
ORACLES = {"op11_bottom_k": ORACLE}
