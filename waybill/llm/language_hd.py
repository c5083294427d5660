"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A letter trigram's
vector is the product (binding) of its letters' vectors, each rolled
(permuted) by its place; a text is the sum (bundle) of its trigrams' vectors,
and so is a language over all its training texts.  A text gets the language
whose prototype has the largest cosine with it.

Training sums are integers, so they do not depend on how rows are dealt.  One
task keeps one vector per language; what reaches the driver and each task is one
vector per language (``DIMENSIONS`` longs, 8 KB), whatever the number of documents.
The number of languages is a property of the labels; texts meet prototypes in
blocks of ``BLOCK``.

Defined results: a null text or one without a letter is ``und`` with score 0,
as is every text when nothing could be learnt; labels that are null are not
learnt from, nor is a row with a null doc_id (its ``held_out`` is false);
cosines below 0 score 0; ties go to the label first in order; repeated rows
stay repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import dealt_table, small_batches, unused

DIMENSIONS = 1024
SEED = 20240229
SYMBOLS = 1024
BLOCK = 1024
UNDETERMINED = "und"
#: A text this near to orthogonal to every prototype is in no learnt language: the
#: cosine of unrelated vectors has a standard deviation of 1 over 32.
MIN_SCORE = 0.05
BATCH_BYTES = 1 << 19


@lru_cache(maxsize=1)
def letter_symbols() -> np.ndarray:
    """Code point to symbol, 0 for what is no letter.  Letters up to U+03FF have
    a symbol each; the others share symbols by a multiplicative hash."""
    table = np.zeros(0x110000, np.uint16)
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()], np.int64)
    table[letters] = np.where(letters < SYMBOLS, letters, 1 + letters * 2654435761 % 4294967296 % (SYMBOLS - 1))
    return table


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))


def trigram_codes(text: str) -> np.ndarray:
    """Codes of all letter trigrams; a run of other characters counts as one
    space, as do both ends.  Empty if the text has no letter."""
    s = letter_symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([np.zeros(1, s.dtype), s, np.zeros(1, s.dtype)])
    keep = s != 0
    if not keep.any():
        return np.zeros(0, np.int64)
    keep[0] = True
    keep[1:] |= s[:-1] != 0
    s = s[keep].astype(np.int64)
    return s[:-2] << 20 | s[1:-1] << 10 | s[2:]


#: Characters of a text that are looked at together.
PIECE = 1 << 18
_BREAK = re.compile(r"\s")


def code_pieces(text: str) -> Iterator[np.ndarray]:
    """The codes of :func:`trigram_codes`, a piece of a long text after the other."""
    if len(text) <= PIECE:
        yield trigram_codes(text)
        return
    held, before, lo = np.zeros(1, np.int64), 0, 0  # symbols kept so far (the last two), and the symbol before
    while lo < len(text):
        # small letters can depend on their neighbours: cut at white space if there is some nearby
        cut = _BREAK.search(text, lo + PIECE, lo + PIECE + 1000)
        hi = cut.start() if cut else min(len(text), lo + PIECE)
        s = letter_symbols()[np.frombuffer(text[lo:hi].lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        kept = s[(s != 0) | (np.concatenate([[before], s[:-1]]) != 0)]
        held = np.concatenate([held, kept])
        yield held[:-2] << 20 | held[1:-1] << 10 | held[2:]
        held, before, lo = held[-2:], int(s[-1]) if len(s) else before, hi
    if before and len(held) == 2:
        yield held[:1] << 20 | held[1:] << 10


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    letters = letter_vectors()
    return np.roll(letters, 2, axis=1)[codes >> 20] * np.roll(letters, 1, axis=1)[codes >> 10 & 1023] * letters[codes & 1023]


def bundle(counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Integer sum of the trigrams' vectors, in pieces of bounded memory."""
    total = np.zeros(DIMENSIONS, np.int64)
    for i in range(0, len(codes), 1024):
        total += (counts[i : i + 1024].astype(np.float64) @ trigram_vectors(codes[i : i + 1024]).astype(np.float64)).astype(np.int64)
    return total


class _Counts:
    """Trigram counts of one language; bundled and forgotten when they are many."""

    def __init__(self):
        self.codes, self.counts, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(DIMENSIONS, np.int64)

    def add(self, found: list[np.ndarray]) -> None:
        codes, counts = np.unique(np.concatenate(found), return_counts=True)
        merged, place = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
        self.counts = np.bincount(place, weights=np.concatenate([self.counts, counts]), minlength=len(merged)).astype(np.int64)
        self.codes = merged
        if len(merged) > 100_000:
            self.flush()

    def flush(self) -> np.ndarray:
        self.total += bundle(self.counts, self.codes)
        self.codes, self.counts = self.codes[:0], self.counts[:0]
        return self.total


def _training_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, _Counts] = {}
    for b in small_batches(batches, "text", BATCH_BYTES):
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for codes in code_pieces(text):
                by_lang.setdefault(lang, []).append(codes)
                if len(text) > PIECE:
                    sums.setdefault(lang, _Counts()).add(by_lang.pop(lang))
        for lang, found in by_lang.items():
            sums.setdefault(lang, _Counts()).add(found)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.flush().tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "vector"])


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each language from all rows of (lang, text)."""
    parts = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_training_sums, "lang string, vector array<bigint>")
    sums = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("v")).collect()
    return {r["lang"]: np.array(r["v"], np.int64) for r in sorted(rows, key=lambda r: r["lang"])}


def _bundled(text: str) -> np.ndarray | None:
    """A long text's bundle of length 1; None if it has no letter."""
    counts, any_ = _Counts(), False
    for codes in code_pieces(text):
        if len(codes):
            any_ = True
            counts.add([codes])
    total = counts.flush().astype(np.float64)
    return (total / max(np.linalg.norm(total), 1e-9)).astype(np.float32) if any_ else None


def predict_texts(texts: list[str | None], names: list[str], unit: np.ndarray) -> tuple[list[str], list[float]]:
    """unit: [dimension, language] prototypes of length 1."""
    long = {i: _bundled(t) for i, t in enumerate(texts) if t and len(t) > PIECE}
    codes = [trigram_codes(t) if t and i not in long else np.zeros(0, np.int64) for i, t in enumerate(texts)]
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    some = [i for i, c in enumerate(codes) if len(c)]
    if not some and not long or not names:
        return langs, scores
    vocabulary, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(codes[i] for i in some)]), return_inverse=True)
    doc = np.repeat(np.arange(len(some)), np.array([len(codes[i]) for i in some], np.int64))
    bundles = np.zeros((len(some), DIMENSIONS), np.float32)
    for lo in range(0, len(vocabulary), 2048):
        n = min(2048, len(vocabulary) - lo)
        inside = (place >= lo) & (place < lo + n)
        counts = np.bincount(doc[inside] * n + place[inside] - lo, minlength=len(some) * n).reshape(len(some), n)
        bundles += counts.astype(np.float32) @ trigram_vectors(vocabulary[lo : lo + n]).astype(np.float32)
    lettered = [i for i, v in long.items() if v is not None]
    some += lettered
    bundles = np.concatenate([bundles, *(long[i][None] for i in lettered)])
    if not some:
        return langs, scores
    norm = np.linalg.norm(bundles, axis=1)
    bundles /= np.maximum(norm, 1e-9)[:, None]
    best, score = np.zeros(len(some), np.int64), np.full(len(some), -np.inf, np.float32)
    for lo in range(0, len(names), BLOCK):
        cosine = bundles @ unit[:, lo : lo + BLOCK].astype(np.float32)
        k = cosine.argmax(axis=1)
        found = cosine[np.arange(len(some)), k]
        best, score = np.where(found > score, lo + k, best), np.maximum(score, found)
    for i, k, x in zip(some, best.tolist(), score.tolist(), strict=True):
        langs[i], scores[i] = names[k], min(1.0, max(0.0, x))
    return langs, scores


def with_language(documents: DataFrame, learnt: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns and the two ``results``; ``learnt`` comes from :func:`prototypes`."""
    names = [n for n, v in learnt.items() if np.linalg.norm(v)]
    unit = np.stack([learnt[n] / np.linalg.norm(learnt[n]) for n in names], axis=1) if names else np.zeros((DIMENSIONS, 0))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(rows, 0, BATCH_BYTES):
            langs, scores = predict_texts(b.column(0).to_pylist(), names, unit)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[1:], *results])

    (name,) = unused(documents, "text_")
    given = documents.select(F.col("text").cast("string").alias(name), *[F.col(c) for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    return given.mapInArrow(batches, f"{schema}, {results[0]} string, {results[1]} double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame) -> dict[str, np.ndarray]:
    return prototypes(documents.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("lang").cast("string"), F.col("text").cast("string")))


def identified(documents: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, all columns as they were, that are in one of the learnt
    languages: those without a letter go, and those whose best cosine is under
    ``min_score``."""
    lang, score = unused(documents, "lang_found", "score_found")
    found = with_language(documents, learn(documents), tuple(documents.columns), (lang, score))
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).select(*documents.columns)


def op4_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = dealt_table(spark, sf_dir, "documents")
    return with_language(documents, learn(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_hd": op4_language_hd}
ORACLES: dict[str, str] = {}
