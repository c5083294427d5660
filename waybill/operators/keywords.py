"""Texts and a table of keywords: which keyword, first by order, a text contains.

A containment join without comparing all with all.  A keyword of up to ``GRAM`` bytes is
found by all of it: tasks list, for a batch of texts at a time, which texts contain it, and
these lists meet the keyword by its bytes, so that what is dealt and compared are
occurrences, however many keywords have the same parts.  A longer keyword is found by one
of its runs of ``GRAM`` bytes, the one that the fewest texts have: a first pass over the
texts counts those of its grams, a second passes on the places of the chosen ones, each
with the bytes around it; those meet the keywords with that gram, and the whole keyword is
looked for there.

Tasks know the grams from a table of bits (16 MB at most; too full, it only lets more
through); keywords themselves stay a distributed table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.session import Tables, prepared, stored

GRAM, HEAD, MOST_BITS = 8, 4, 27
#: Bytes of text looked at together.
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return (x ^ (x >> np.uint64(32))) * _MIX


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, zeros past the end, as one number."""
    padded, n = data + bytes(16), len(data) // 8 + 1
    out = np.empty(8 * n, np.uint64)
    for i in range(8):
        out[i::8] = np.frombuffer(padded, ">u8", n, i)
    return out[: len(data)]


def _hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One number for the first n bytes of each word; of equal n, different bytes have different ones."""
    return _mixed(words if n == 8 else (words >> np.uint64(64 - 8 * n)) | np.uint64(n << 8 * n))


def gram_hashes(data: bytes, n: int) -> np.ndarray:
    """One hash for each run of n bytes (up to eight)."""
    return _hashes(_words(data)[: max(0, len(data) - n + 1)], n)


def _grams_of(keywords: DataFrame) -> DataFrame:
    """keyword, size (of its grams), gram: all grams of each keyword."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            words, grams = [], []
            for w in b.column(0).to_pylist():
                found = np.unique(gram_hashes(w.encode(), GRAM)).view(np.int64).tolist()
                words += [w] * len(found)
                grams += found
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([GRAM] * len(grams), pa.int32()), pa.array(grams, pa.int64())], names=["keyword", "size", "gram"])

    return keywords.mapInArrow(batches, "keyword string, size int, gram long")


def _whole(keywords: DataFrame) -> DataFrame:
    """Keywords of up to ``GRAM`` bytes with size, gram (of all of it) and head (of its beginning)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            data = [w.encode() for w in b.column(0).to_pylist()]
            size = np.array([len(w) for w in data], np.int32)
            words = np.frombuffer(b"".join(w.ljust(8, b"\0") for w in data), ">u8").astype(np.uint64)
            grams = np.zeros(len(data), np.uint64)
            for n in np.unique(size).tolist():
                grams[size == n] = _hashes(words[size == n], n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), pa.array(grams.view(np.int64)), pa.array(_hashes(words, HEAD).view(np.int64))], names=[*b.schema.names, "size", "gram", "head"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keywords.schema)
    return keywords.mapInArrow(batches, f"{kinds}, size int, gram long, head long")


def _filter_of(grams: DataFrame) -> tuple[Callable[[np.ndarray], np.ndarray], list[int]]:
    """(near, sizes): whether hashes may be among the grams; the grams' sizes."""
    n = grams.count()
    bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(8 * n + 1)))))
    table = np.zeros(1 << (bits - 6), np.uint64)
    place = F.shiftrightunsigned("gram", 64 - bits)
    words = grams.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    table[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # GRAM at most

    def near(hashes: np.ndarray) -> np.ndarray:
        p = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        return (table[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    return near, sizes


def _found(data: bytes, near: Callable[[np.ndarray], np.ndarray], sizes: list[int], begins: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, grams) of what may be a gram, a piece of the text after the other;
    grams longer than ``HEAD`` are looked for where one may begin."""
    for lo in range(0, len(data), PIECE) if sizes else ():
        words = _words(data[lo : lo + PIECE + max(sizes) - 1])
        head = np.flatnonzero(begins(_hashes(words[:PIECE], HEAD))) if begins and max(sizes) > HEAD else None
        for n in sizes:
            most = min(PIECE, len(words) - n + 1)
            if head is not None and n > HEAD:
                at = head[head < most]
                hashes = _hashes(words[at], n)
                kept = near(hashes)
                yield n, at[kept] + lo, hashes[kept].view(np.int64)
            else:
                hashes = _hashes(words[: max(0, most)], n)
                at = np.flatnonzero(near(hashes))
                yield n, at + lo, hashes[at].view(np.int64)


def _places(data: bytes, near: Callable[[np.ndarray], np.ndarray], sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, grams) of what may be a gram."""
    for _, at, grams in _found(data, near, sizes):
        yield at, grams


def _met_whole(rows: DataFrame, kind: str, whole: DataFrame) -> DataFrame:
    """__key, ord, keyword, label: the keywords of :func:`_whole` in each of (__key, data)."""
    near, sizes = _filter_of(whole.select("size", "gram"))
    begins, _ = _filter_of(whole.where(F.col("size") > HEAD).select("size", F.col("head").alias("gram")).distinct())

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of_size = {n: ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]) for n in sizes}
            for i, x in enumerate(b.column(1).to_pylist()):
                for n, _, grams in _found(x, near, sizes, begins) if x else ():
                    if len(grams):
                        grams = np.unique(grams)
                        of_size[n][0].append(grams)
                        of_size[n][1].append(np.full(len(grams), i))
            for n, (grams, texts) in of_size.items():
                gram, text = np.concatenate(grams), np.concatenate(texts)
                order = np.argsort(gram, kind="stable")
                each, begin = np.unique(gram[order], return_index=True)
                keys = pa.ListArray.from_arrays(pa.array(np.append(begin, len(gram)), pa.int32()), b.column(0).take(pa.array(text[order])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), n, np.int32)), pa.array(each), keys], names=["size", "gram", "keys"])

    listed = rows.mapInArrow(lists, f"size int, gram long, keys array<{kind}>")
    return listed.join(whole, ["size", "gram"]).select(F.explode("keys").alias("__key"), "ord", "keyword", "label")


def _met_longer(tables: Tables, rows: DataFrame, kind: str, longer: DataFrame) -> DataFrame:
    """The same for keywords of more than ``GRAM`` bytes."""
    grams = tables.put(_grams_of(longer.select("keyword")), "grams")
    near, sizes = _filter_of(grams.select("size", "gram").distinct())

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(np.concatenate([np.zeros(0, np.int64), *(g for _, g in _places(x, near, sizes))])) for x in b.column(0).to_pylist() if x]
            each, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n)], names=["gram", "n"])

    in_texts = rows.select("data").mapInArrow(counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = grams.join(in_texts, "gram", "left").groupBy("keyword", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    chosen = tables.put(rarest.where("g.n > 0").select("keyword", "size", F.col("g.gram").alias("gram")).join(longer, "keyword"), "chosen")
    around = chosen.agg(F.max(F.octet_length("keyword"))).first()[0] or 0
    close, lengths = _filter_of(chosen.select("size", "gram").distinct())

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column(1).to_pylist()):
                for at, gram in _places(x, close, lengths) if x else ():
                    for lo in range(0, len(at), 1024):
                        some = at[lo : lo + 1024].tolist()
                        near_by = [x[max(0, p - around) : p + around] for p in some]
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0).slice(i, 1)] * len(some)), pa.array(gram[lo : lo + 1024]), pa.array(near_by, pa.binary())], names=["__key", "gram", "around"])

    met = rows.mapInArrow(hits, f"__key {kind}, gram long, around binary").join(chosen, "gram")
    return met.where(F.contains("around", F.col("keyword").cast("binary"))).select("__key", "ord", "keyword", "label")


def first_keywords(texts: DataFrame, keywords: DataFrame, key: str, column: str) -> DataFrame:
    """``key``, keyword, ord, label of each row of ``texts`` whose ``column`` contains a
    keyword of (keyword, ord, label): of those, the one with the smallest ``ord`` (then
    keyword and label).  ``key`` is the texts' own, distinct and not null.

    Null and empty keywords are in no text, nor is anything in a null text; a text
    without a keyword has no row; equal keywords count by the first."""
    spark = prepared(texts.sparkSession)
    with Tables(spark, "keywords") as tables:
        kept = keywords.where("keyword <> ''").groupBy("keyword").agg(F.min(F.struct("ord", "label")).alias("first"))
        kept = tables.put(kept.select("keyword", "first.*"), "keywords")
        short = F.octet_length("keyword") <= GRAM
        rows = texts.select(F.col(key).alias("__key"), F.col(column).cast("binary").alias("data"))
        kind = texts.schema[key].dataType.simpleString()
        met, longer = _met_whole(rows, kind, tables.put(_whole(kept.where(short)), "whole")), kept.where(~short)
        if not longer.isEmpty():
            met = met.unionByName(_met_longer(tables, rows, kind, longer))
        return stored(met.groupBy("__key").agg(F.min(F.struct("ord", "keyword", "label")).alias("first")).select(F.col("__key").alias(key), "first.*"), "first-keywords")
