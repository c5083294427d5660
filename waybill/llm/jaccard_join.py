"""N-gram Jaccard join with set-relation skipping.

A document's set are its distinct 5-word shingles (a shorter one: its words as
one shingle), as 64-bit hashes.  Two documents link when their sets' Jaccard
similarity is at least ``PERCENT``; documents that links connect form a
component.  The search is exact up to hash collisions.

1. Equal sets become one (a 128-bit digest of the set stands for it); a set's
   copies share its answers.
2. Prefix index: under one global order, linked sets share one of their first
   ``n - ceil(n * PERCENT / 100) + 1`` shingles.  The order is rare first, by a
   count sketch over the shingles of all documents (a bounded number of counters,
   so it can be sent to all tasks; any order gives the same results, this one
   keeps index lists short).  Each list entry has the set's size and the
   shingle's position in it.  Lists that the sketch counts as long are dealt over
   several groups, so no shingle's entries have to meet in one task.
3. Lists are cut into blocks by size and component; size and position bounds let
   a pair of blocks, or of entries, be skipped unread.
4. Answers are derived from those of a highly similar set: in the first round
   the sets of a list meet only one of them, a hub (the set that has the fewest
   rarer shingles, as an original beside its edited copies), and those verified
   join its component and its answers.  In the second, only pairs across components
   are looked at, and a pair (x, z) is skipped if the overlap already known of x's
   neighbour r with z, enlarged by what x has beyond r, cannot reach the
   threshold.  So large groups of near copies never meet all against all.

Pairs are verified by the sizes of their sets' intersections.  Sets are made
again from the texts of the documents in question instead of being kept, and go
to the hubs that they are compared with, a few hundred to a task's group.

Defined results: null, empty and white-space texts have no shingles and are
alone; a component's id is its smallest doc_id; every input row gives one row,
repeated doc_ids too; rows with a null doc_id count as members but cannot name
a component (an all-null component has a null id); an empty table gives no
rows; other columns are ignored, and kept by :func:`representatives`, where of
each component the document with the smallest doc_id stays.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import Tables, dealt_table, drop_rows, listed_rows, small_batches, stored
from waybill.llm.components import component_labels
from waybill.llm.words import hashed_words, window_hashes

SHINGLE = 5
PERCENT = 80
#: The order sketch has about one counter to ``SHINGLES_PER_COUNTER`` shingles,
#: within these bounds (at most 16 MB are sent to a task).
SHINGLES_PER_COUNTER, LEAST_BITS, MOST_BITS = 8, 16, 24
SLICE_BITS = 14
#: A list is long if the sketch counts 4,096 sets or more (as a rank: eight a doubling).
LONG_RANK = 8 * 12
#: Sets that are compared with one hub in one group.
SETS_PER_GROUP = 128
CHARS_PER_WORD = 6
BATCH_BYTES = 1 << 19


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = hashed_words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]) if texts else (None, [])
    sets, at = [], 0
    for n in [int(c) for c in counts]:
        h = hashes[at : at + n]
        at += n
        sets.append(np.unique(window_hashes(h, min(n, SHINGLE))) if n else h)
    return sets


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketch_bits(documents: DataFrame) -> int:
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    counters = chars / CHARS_PER_WORD / SHINGLES_PER_COUNTER
    return min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(counters + 1)))))


def _bucket(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def summaries_of(documents: DataFrame, bits: int) -> DataFrame:
    """A row for each document (doc_id, n, sid) and each task's shingle counts
    by slice of the sketch (up to 65,535 each: they only rank)."""
    names = ["doc_id", "n", "sid", "slice", "counts"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for b in small_batches(rows, "text", BATCH_BYTES):
            sets = shingle_sets(b.column(1).to_pylist())
            at, n = np.unique(_bucket(np.concatenate([np.zeros(0, np.uint64), *sets]), bits), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 65_535)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for i, c in enumerate(counts.reshape(-1, 1 << SLICE_BITS)):
            if c.any():
                none = pa.nulls(1)
                yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([i], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary())], names=names)

    return documents.mapInArrow(batches, "doc_id long, n long, sid binary, slice int, counts binary")


def _slice_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.float32)
            sums[i] = sums[i] + part if i in sums else part
    rank = [(i, np.floor(8 * np.log2(1 + v)).astype(np.uint8).tobytes()) for i, v in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rank], pa.int32()), pa.array([r[1] for r in rank], pa.binary())], names=["slice", "rank"])


def order_sketch(summaries: DataFrame, bits: int, tables: Tables) -> np.ndarray:
    """Rank (eight per doubling of the count) by bucket: 2**bits bytes."""
    parts = summaries.where("slice IS NOT NULL").select("slice", "counts").repartition(64, "slice")
    rank = np.zeros((1 << (bits - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in tables.put(parts.mapInArrow(_slice_sums, "slice int, rank binary"), "ranks").toLocalIterator():
        rank[r["slice"]] = np.frombuffer(r["rank"], np.uint8)
    return rank.ravel()


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def short(key: bytes) -> int:
    """First 64 bits of a set's key: lists carry these; links are between whole keys."""
    return int.from_bytes(key[:8], "big", signed=True)


#: An index entry's numbers in one long, from high to low: the set's size, in how
#: many groups (4 to that power) the shingle's list is dealt, and the set's shingles
#: from this one on.
_TAIL, _GROUPS = 29, 3


def _size(at: Column) -> Column:
    return F.shiftright(at, _TAIL + _GROUPS).cast("int")


def _tail(at: Column) -> Column:
    return at.bitwiseAND(F.lit((1 << _TAIL) - 1)).cast("int")


def _group(s: Column, at: Column) -> Column:
    """0, or the group that a set's entry in a long list is dealt to (in the exchange
    it is folded into the shingle, so that it takes no room there)."""
    power = F.shiftright(at, _TAIL).bitwiseAND(F.lit((1 << _GROUPS) - 1))
    return F.when(power == 0, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(s), F.pow(F.lit(4), power).cast("long"))).cast("int")


def prefix_entries(documents: DataFrame, rank: np.ndarray, percent: int) -> DataFrame:
    """(tok, s, at): the prefix index, ``at`` as told above.  Copies are left out
    where a task sees them."""
    bits = len(rank).bit_length() - 1

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in small_batches(rows, "text", BATCH_BYTES):
            toks, keys, places = [], [], []
            for s in shingle_sets(b.column(0).to_pylist()):
                key = set_key(s)
                if key is None or key in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(key)
                p, n = prefix_length(len(s), percent), len(s)
                ranks = rank[_bucket(s, bits)]
                order = np.lexsort((s, ranks))[:p]
                ranks = ranks[order].astype(np.int64)
                groups = np.clip(-(-(ranks - LONG_RANK + 1) // 16), 0, (1 << _GROUPS) - 1)  # sixteen ranks are a factor of four
                toks.append(s[order])
                places.append((n << _GROUPS | groups) << _TAIL | n - np.arange(p))
                keys.append(np.full(p, short(key)))
            if toks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], names=["tok", "s", "at"])

    return documents.select("text").mapInArrow(batches, "tok long, s long, at long")


def sets_of(documents: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, sid, shingles) of the wanted sets, each from one document at least."""
    ids = wanted.join(classes, "s").select(F.col("min_id").alias("doc_id")).distinct()
    rows, near = listed_rows(documents.select("doc_id", "text"), ids, "doc_id")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            some = whole.filter(pa.array(near(whole.column(0).to_numpy()))) if near else whole
            for b in small_batches([some] if some.num_rows else [], "text", BATCH_BYTES):
                found = [(short(k), k, x.view(np.int64)) for x in shingle_sets(b.column(2).to_pylist()) if (k := set_key(x))]
                s, k, x = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(k, pa.binary()), pa.array(x, pa.list_(pa.int64()))], names=["s", "sid", "shingles"])

    return rows.mapInArrow(batches, "s long, sid binary, shingles array<long>")


def verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame:
    """(a, b, ka, kb, na, nb, overlap): the pairs with whole keys, sizes and overlap.

    Each set b goes to the groups of its hubs a, and a hub to all of its own, so
    sets are dealt once, by group."""
    groups = pairs.groupBy("a").agg((F.floor(F.count("*") / SETS_PER_GROUP) + 1).alias("groups"))
    dealt = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), "groups").alias("g"), "b")
    routes = dealt.select(F.col("b").alias("s"), "a", "g", F.lit(False).alias("hub")).union(dealt.select(F.col("a"), "a", "g", F.lit(True)).distinct())
    routes = tables.put(routes, "routes")
    sets = sets_of(documents, classes, routes.select("s").distinct())
    met = sets.join(routes, "s").repartition("a", "g").dropDuplicates(["a", "g", "hub", "s", "sid"])
    group = Window.partitionBy("a", "g")
    hubs = F.collect_list(F.when(F.col("hub"), F.struct("sid", "shingles"))).over(group)  # one, but for equal 64-bit keys
    met = met.withColumn("hubs", hubs).where(~F.col("hub")).select("a", F.col("s").alias("b"), F.col("sid").alias("kb"), "shingles", F.explode("hubs").alias("h"))
    overlap = F.size(F.array_intersect("h.shingles", "shingles"))
    return tables.put(met.select("a", "b", F.col("h.sid").alias("ka"), "kb", F.size("h.shingles").alias("na"), F.size("shingles").alias("nb"), overlap.alias("overlap")), "tested")


def needed(na: Column, nb: Column, percent: int) -> Column:
    """Least overlap of linked sets with these sizes."""
    return F.ceil(percent * (na + nb) / (100 + percent))


def possible(na: Column, nb: Column, ta: Column, tb: Column, percent: int) -> Column:
    """Size and position bounds; ``t`` counts the shingles from the shared one on."""
    need = needed(na, nb, percent)
    return (F.least(na, nb) >= need) & (F.least(ta, tb) >= need)


def prefix_lists(docs: DataFrame, summaries: DataFrame, bits: int, percent: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(sid, min_id, s) of all sets, and (tok, s, n, tail, hub) of the lists that
    hold more than one; ``hub`` is the list's hub where it and s can be linked."""
    classes = summaries.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("min_id"))
    classes = tables.put(classes.withColumn("s", F.conv(F.hex(F.substring("sid", 1, 8)), 16, -10).cast("long")), "classes")
    entries = prefix_entries(docs, order_sketch(summaries, bits, tables), percent)
    dealt = _group(F.col("s"), F.col("at"))
    folded = lambda: F.when(dealt == 0, F.col("tok")).otherwise(F.col("tok").bitwiseXOR(F.xxhash64(dealt)))
    group = Window.partitionBy("tok")
    place = (_size(F.col("at")) - _tail(F.col("at"))).alias("place")
    # dealt before the window, or what the window computes of a row would be shuffled with it
    entries = entries.withColumn("tok", folded()).repartition("tok").withColumns({"lo": F.min("s").over(group), "hi": F.max("s").over(group), "head": F.min(F.struct(place, "s", "at")).over(group)})
    at, head = F.col("at"), F.col("head.at")
    near = (F.col("head.s") != F.col("s")) & possible(_size(at), _size(head), _tail(at), _tail(head), percent)
    kept = entries.where((dealt > 0) | (F.col("lo") != F.col("hi"))).select("tok", "s", "at", F.when(near, F.col("head.s")).alias("hub")).distinct()
    return classes, tables.put(kept.select(folded().alias("tok"), "s", _size(at).alias("n"), _tail(at).alias("tail"), "hub"), "lists")


def links(docs: DataFrame, summaries: DataFrame, bits: int, percent: int, tables: Tables) -> DataFrame:
    """(v, label): the component labels of all sets that have links, by whole key."""
    classes, lists = prefix_lists(docs, summaries, bits, percent, tables)

    # first round: each set of a list against its hub
    pairs = tables.put(lists.where("hub IS NOT NULL").select(F.col("hub").alias("a"), F.col("s").alias("b")).distinct(), "pairs")
    tested = verified(pairs, docs, classes, tables)
    linked = F.col("overlap") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    labels = component_labels(tested.where(linked), "ka", "kb", tables)

    # second round: pairs across components (64 bits of a component's label name it)
    comps = tables.put(classes.join(labels.select(F.col("v").alias("sid"), "label"), "sid").select("s", F.xxhash64("label").alias("comp")), "comps")
    placed = tables.put(lists.drop("hub").join(comps, "s", "left").withColumn("comp", F.coalesce("comp", "s")), "lists")
    tables.drop(lists)
    met = _met_in_blocks(placed, percent).distinct()
    known = tested.select("a", "b").union(tested.select("b", "a"))
    met = tables.put(met.join(known, ["a", "b"], "left_anti"), "met")
    met = tables.put(_not_ruled_out(met, tested, linked, percent), "pairs")
    more = verified(met.select("a", "b"), docs, classes, tables)
    return component_labels(tested.where(linked).unionByName(more.where(linked)), "ka", "kb", tables)


def _met_in_blocks(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) with a < b: pairs across components.

    A pair's smaller set meets sets of its own size class and of the next; its
    shingle must be early enough for one of its own size.  Blocks (a list's sets of
    one size class and component) are paired first, by their bounds."""
    lists = lists.withColumn("k", _size_class(F.col("n"), percent))
    early = F.col("tail") >= needed(F.col("n"), F.col("n"), percent)
    smaller = lists.where(early).withColumn("k", F.explode(F.array(F.col("k"), F.col("k") + 1)))
    block = lambda df: df.groupBy("tok", "k", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("tail").alias("tail"))
    x, y = block(smaller).alias("x"), block(lists).alias("y")
    low = F.greatest("x.least", F.ceil(F.col("y.least") * percent / 100))
    block_pairs = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.comp") != F.col("y.comp"))).where(
        (F.least("x.tail", "y.tail") >= needed(low, F.greatest(low, "y.least"), percent)) & (F.col("x.least") <= F.col("y.most")) & (F.col("y.least") * percent <= F.col("x.most") * 100)
    ).select(F.col("x.tok").alias("tok"), F.col("x.k").alias("k"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb"))
    side = lambda df, c, s: df.select("tok", "k", F.col("comp").alias(c), F.col("s").alias(s), F.col("n").alias(f"n{s}"), F.col("tail").alias(f"t{s}"))
    met = block_pairs.join(side(smaller, "ca", "a"), ["tok", "k", "ca"]).join(side(lists, "cb", "b"), ["tok", "k", "cb"])
    met = met.where(((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))) & possible(F.col("na"), F.col("nb"), F.col("ta"), F.col("tb"), percent))
    swap = F.col("a") > F.col("b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))


def _size_class(n: Column, percent: int) -> Column:
    """Sets of linked sizes are in the same class or in neighbouring ones."""
    return n if percent >= 100 else F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def _not_ruled_out(met: DataFrame, tested: DataFrame, linked: Column, percent: int) -> DataFrame:
    """Pairs without those that a similar set's answers rule out."""
    near = tested.where(linked).groupBy("b").agg(F.max_by(F.struct("a", (F.col("nb") - F.col("overlap")).alias("beyond")), "overlap").alias("r"))
    known = tested.select("a", "b", "overlap").union(tested.select(F.col("b"), F.col("a"), F.col("overlap")))
    out = met
    for x, z in (("a", "b"), ("b", "a")):
        r = near.select(F.col("b").alias(x), F.col("r.a").alias("r"), F.col("r.beyond").alias("beyond"))
        k = known.select(F.col("a").alias("r"), F.col("b").alias(z), F.col("overlap").alias("had"))
        bound = F.col("had") + F.col("beyond")
        out = out.join(r, x, "left").join(k, ["r", z], "left").where(F.col("had").isNull() | (bound >= needed(F.col("na"), F.col("nb"), percent))).select("a", "b", "na", "nb")
    return out


def _surveyed(documents: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame, int]:
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    bits = sketch_bits(docs)
    return docs, tables.put(summaries_of(docs, bits), "summaries"), bits


def components(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    with Tables(documents.sparkSession, "jaccard") as tables:
        docs, summaries, bits = _surveyed(documents, tables)
        labels = links(docs, summaries, bits, percent, tables)
        rows = summaries.where("slice IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "sid")
        some, none = rows.where("sid IS NOT NULL"), rows.where("sid IS NULL")
        classes = some.groupBy("sid").agg(F.min("doc_id").alias("min_id"))
        classes = classes.join(labels.select(F.col("v").alias("sid"), "label"), "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"), "min_id")
        classes = tables.put(classes, "classes")
        smallest = tables.put(classes.groupBy("label").agg(F.min("min_id").alias("component_id")), "smallest")
        classes = tables.put(classes.join(smallest, "label").select("sid", "component_id"), "classes")
        found = some.join(classes, "sid").select("doc_id", "n_shingles", "component_id")
        return stored(found.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "components")


def _all_links(docs: DataFrame, summaries: DataFrame, bits: int, percent: int, tables: Tables) -> DataFrame:
    classes, lists = prefix_lists(docs, summaries, bits, percent, tables)
    side = lambda x: lists.select("tok", F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("tail").alias(f"t{x}"))
    met = side("a").join(side("b"), "tok").where("a < b").where(possible(F.col("na"), F.col("nb"), F.col("ta"), F.col("tb"), percent))
    tested = verified(tables.put(met.select("a", "b").distinct(), "pairs"), docs, classes, tables)
    linked = F.col("overlap") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    return tested.where(linked).select(F.col("ka").alias("sid_a"), F.col("kb").alias("sid_b"), F.col("na").alias("n_a"), F.col("nb").alias("n_b"), "overlap")


def _copies(summaries: DataFrame, side: str) -> DataFrame:
    return summaries.where("sid IS NOT NULL").groupBy(F.col("sid").alias(f"sid_{side}")).agg(F.count("*").alias(f"copies_{side}"))


def linked_sets(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """sid_a, sid_b, n_a, n_b, overlap, copies_a, copies_b: every link between two
    different sets, once, with the number of rows that have each set.

    There are as many rows as links: the square of a group of different near copies."""
    with Tables(documents.sparkSession, "jaccard") as tables:
        docs, summaries, bits = _surveyed(documents, tables)
        found = _all_links(docs, summaries, bits, percent, tables)
        return stored(found.join(_copies(summaries, "a"), "sid_a").join(_copies(summaries, "b"), "sid_b"), "links")


def link_counts(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_links of every row: how many other rows it links with, copies included."""
    with Tables(documents.sparkSession, "jaccard") as tables:
        docs, summaries, bits = _surveyed(documents, tables)
        found = tables.put(_all_links(docs, summaries, bits, percent, tables).select("sid_a", "sid_b"), "links")
        both = found.union(found.select("sid_b", "sid_a")).join(_copies(summaries, "b"), "sid_b")
        others = both.groupBy("sid_a").agg(F.sum("copies_b").alias("others"))
        counts = _copies(summaries, "a").join(others, "sid_a", "left").select(F.col("sid_a").alias("sid"), (F.col("copies_a") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        return stored(summaries.where("slice IS NULL").join(counts, "sid", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "counts")


def representatives(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they were, less those whose component has
    a smaller doc_id.  Rows of one doc_id are one document and stay or go together."""
    found = components(documents, percent)
    gone = stored(found.where("doc_id > component_id").select("doc_id").distinct(), "copies")
    return drop_rows(documents, F.col("doc_id"), gone)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(dealt_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS x
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), reach(v, u) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.v, e.b FROM reach r JOIN e ON r.u = e.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(u) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.v = d.doc_id
GROUP BY d.doc_id, n.n
"""

QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLES = {"op2_jaccard_join": ORACLE}
