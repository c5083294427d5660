"""SentencePiece encoding by forward-filtering backward-sampling, and decoding.

A text's pieces form a lattice.  Forward filtering sums, for each position, the
weights of all segmentations up to it; backward sampling then draws pieces
from the end, each with its exact share.  A segmentation comes out with
probability proportional to the product of its pieces' weights, and the draws
come from a hash of (seed, row key, place), so that the same row always gets
the same segmentation, whichever task computes it and however rows are dealt.

Texts are cut into units at the borders of words, numbers, marks, space runs and
line breaks, except where some piece holds the two characters beside a border
(so no piece crosses a cut, and every piece of the model takes part): the lattice
falls apart there, filtering is done once for each distinct
unit (a bounded store per task) and sampling for all units of a
batch together with numpy.  Nothing is shuffled.

The vocabulary's merge ranks stand in for probabilities: the piece of rank r
weighs (r + RANK_OFFSET) ** -alpha; alpha -> infinity gives the best
segmentation.  Characters outside the vocabulary become byte pieces.  Lone
spaces and space runs have one rank, the last.

Decoding joins the pieces' bytes; ``decode(encode(x)) == x`` for every string,
leading, trailing and repeated spaces, NUL and the piece marker included.

Defined results: an empty text has no pieces; a null text has null pieces and
decodes to null; repeated rows get equal pieces if their keys are equal; a null
key is a key like any other; an empty table gives no rows; other columns are
kept by :func:`encoded` unless they have the names of its results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import dealt_table, small_batches, unused

ALPHA = 0.5
SEED = 17
RANK_OFFSET = 20
#: Units whose filtered lattices a task keeps (some 300 bytes each).
STORE_UNITS = 100_000
#: The same where a task does nothing else and its executor holds no other stage's tables.
WIDE_STORE_UNITS = 250_000
#: Positions of a unit that are filtered together with those of other units;
#: the few longer units go on one position at a time.
TOGETHER = 48
BATCH_BYTES = 1 << 19
#: Tokens that units are made of; each border is told by the two characters beside it.
_TOKEN = r"(?: *+(?:[^\W\d_]++|(?:[^ \n\t\r\w]|_)++|\d++)| ++|[\n\t\r])"
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def units_of(pieces: Iterable[str]) -> re.Pattern:
    """Units of a text: tokens, joined at the borders that a piece crosses."""
    token, crossed = re.compile(_TOKEN), {}
    for x in pieces:
        for m in token.finditer(x):
            if m.end() < len(x):
                crossed.setdefault(x[m.end()], set()).add(x[m.end() - 1])
    if not crossed:
        return token
    listed = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
    alike: dict[str, set[str]] = {}  # characters by those that a piece has before them
    for after, before in crossed.items():
        alike.setdefault(listed(before), set()).add(after)
    glue = "|".join(f"(?={listed(after)})(?<={before})" for before, after in alike.items())
    return re.compile(f"{_TOKEN}(?:(?:{glue}){_TOKEN})*+")


class Vocabulary:
    """Pieces of a SentencePiece model as plain data (a fixed size, a few MB):
    bytes by id, and the pieces as a trie in arrays.

    Trie edges are keys ``node << 21 | code point`` in an open hash table; node 0
    is the root."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        self.pieces: dict[str, tuple[int, float]] = {}
        size = sp.get_piece_size()
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            plain = piece.replace("▁", " ")
            self.bytes.append(b"" if sp.is_control(i) or sp.is_unknown(i) else plain.encode())
            if self.bytes[-1]:
                self.pieces[plain] = (i, -float(np.log(RANK_OFFSET - sp.get_score(i))))
        self.units = units_of(self.pieces)
        self.byte_weight = -float(np.log(RANK_OFFSET + size))
        edges: dict[int, int] = {}
        piece_at, weight_at = [-1], [0.0]
        for text, (i, weight) in self.pieces.items():
            node = 0
            for c in text:
                key = node << 21 | ord(c)
                if key not in edges:
                    edges[key] = len(piece_at)
                    piece_at.append(-1)
                    weight_at.append(0.0)
                node = edges[key]
            piece_at[node], weight_at[node] = i, weight
        self.piece_at, self.weight_at = np.array(piece_at, np.int32), np.array(weight_at)
        self._hash(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        firsts = sorted(k for k in edges if k < 1 << 21)
        self.root = np.full(firsts[-1] + 2, -1, np.int64)  # the first step; its last place is for what is beyond
        self.root[firsts] = [edges[k] for k in firsts]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _hash(self, keys: np.ndarray, to: np.ndarray) -> None:
        self.bits = int(len(keys)).bit_length() + 2
        self.keys, self.to = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, -1, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):  # each round the first key of every free place takes it, the others move on
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.to[at[first]] = keys[left[first]], to[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], at[rest] + 1
            if len(at) and at.max() >= len(self.keys):
                raise ValueError("hash table too small")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _GOLDEN >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Trie node after each char, -1 where there is none."""
        key = node << 21 | char
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.to[at], -1).astype(np.int64)
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            at[on] += 1
            found = self.keys[at[on]]
            hit = found == key[on]
            out[on[hit]] = self.to[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out


class _Units(dict):
    """A number for each unit; new ones are listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        n = self[unit] = len(self)
        return n


class Lattices:
    """Filtered lattices of units, stored flat: node n's edges begin at
    ``first[n]``; ``share`` cumulates their probabilities and ends at 1."""

    def __init__(self, vocabulary: Vocabulary, alpha: float, store: int = STORE_UNITS):
        self.v, self.alpha, self.store = vocabulary, alpha, store
        self.clear()

    def clear(self) -> None:
        self.units = _Units()
        self.end_of = np.zeros(0, np.int64)  # end node of each unit
        self.nodes = 0
        self.first, self.piece, self.previous = (np.zeros(0, np.int32) for _ in range(3))
        self.share = np.zeros(0, np.float32)

    def add(self, units: list[str]) -> None:
        """Filter the lattices of new units together, one position after the other.

        Node ``self.nodes + p`` stands after flat position p; -1 is the start."""
        v = self.v
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        stops = np.cumsum(sizes)
        char = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        total = len(char)
        first = np.repeat(stops - sizes, sizes)
        stop = np.repeat(stops, sizes)

        start, node, length = np.arange(total), np.zeros(total, np.int64), 0
        starts, ends, pieces, weights = [], [], [], []
        known = np.zeros(total, bool)
        while len(start):
            inside = start + length < stop[start]
            start, node = start[inside], node[inside]
            node = v.step(node, char[start + length]) if length else v.root[np.minimum(char, len(v.root) - 1)]
            start, node = start[node >= 0], node[node >= 0]
            full = v.piece_at[node] >= 0
            starts.append(start[full])
            ends.append(start[full] + length)
            pieces.append(v.piece_at[node[full]])
            weights.append(v.weight_at[node[full]])
            if not length:
                known[start[full]] = True
            length += 1
        # characters that the vocabulary lacks: chains of byte pieces
        raws = [chr(c).encode("utf-8", "surrogatepass") for c in char[~known].tolist()]
        lone = np.flatnonzero(~known)
        tails = np.array([len(r) - 1 for r in raws], np.int64)
        starts.append(lone)
        ends.append(lone)
        pieces.append(v.byte_ids[[r[-1] for r in raws]] if raws else np.zeros(0, np.int32))
        weights.append((tails + 1) * v.byte_weight)

        start, end = np.concatenate(starts), np.concatenate(ends)
        piece, weight = np.concatenate(pieces), np.concatenate(weights) * self.alpha
        before = np.where(start > first[start], start - 1, -1)  # flat position, or -1
        previous = np.where(before >= 0, before + self.nodes, -1)
        chained = np.arange(len(start) - len(lone), len(start))[tails > 0]
        chain_first = previous[chained]
        chain_at = self.nodes + total + np.cumsum(tails)[tails > 0] - 1
        previous[chained] = chain_at

        order = np.lexsort((end, end - first[end]))
        start, end, piece, weight, before, previous = (x[order] for x in (start, end, piece, weight, before, previous))
        level = end - first[end]
        together = int(np.searchsorted(level, TOGETHER))
        cuts = np.append(np.flatnonzero(np.diff(level[:together], prepend=-1)), together)
        filtered = np.zeros(total + 1)  # at -1 (the last) the start's weight, 0
        chance = np.empty(len(start))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = end[a:b]
            term = filtered[before[a:b]] + weight[a:b]
            group = np.flatnonzero(np.diff(e, prepend=-1))
            which = np.repeat(np.arange(len(group)), np.diff(np.append(group, b - a)))
            top = np.maximum.reduceat(term, group)
            part = np.exp(term - top[which])
            mass = np.add.reduceat(part, group)
            filtered[e[group]] = top + np.log(mass)
            chance[a:b] = part / mass[which]
        if together < len(start):
            chance[together:] = _one_by_one(filtered, end[together:].tolist(), before[together:].tolist(), weight[together:].tolist())

        order = np.argsort(end, kind="stable")
        end, piece, previous, chance = end[order], piece[order], previous[order], chance[order]
        run = np.cumsum(chance)
        group = np.flatnonzero(np.diff(end, prepend=-1))
        run -= np.repeat((run - chance)[group], np.diff(np.append(group, len(end))))
        run[np.append(group[1:], len(end)) - 1] = 1.0

        # the byte chains' own nodes follow: one edge each
        chain_piece = v.byte_ids[[b for r in raws for b in r[:-1]]] if len(chained) else np.zeros(0, np.int32)
        chain_previous = np.arange(len(chain_piece)) - 1 + self.nodes + total
        heads = (np.cumsum(tails) - tails)[tails > 0]
        chain_previous[heads] = chain_first
        edges = len(self.share)
        self.first = np.concatenate([self.first, (edges + group).astype(np.int32), np.arange(edges + len(end), edges + len(end) + len(chain_piece), dtype=np.int32)])
        self.share = np.concatenate([self.share, run.astype(np.float32), np.ones(len(chain_piece), np.float32)])
        self.piece = np.concatenate([self.piece, piece, chain_piece])
        self.previous = np.concatenate([self.previous, previous.astype(np.int32), chain_previous.astype(np.int32)])
        self.end_of = np.concatenate([self.end_of, self.nodes + stops - 1])
        self.nodes += total + len(chain_piece)

    def ends(self, units: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        new, self.units.new = self.units.new, []
        for i in range(0, len(new), 20_000):
            self.add(new[i : i + 20_000])
        return self.end_of[at]

    def sample(self, ends: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all units in order, and how many each has."""
        at, who, step = ends, np.arange(len(ends)), 0
        drawn, counts = [], np.zeros(len(ends), np.int64)
        while len(who):
            x = seeds[who] + np.uint64(step * int(_GOLDEN) & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * _M1
            x = (x ^ (x >> np.uint64(27))) * _M2
            u = ((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            edge = self.first[at]
            over = np.flatnonzero(u >= self.share[edge])
            while len(over):
                edge[over] += 1
                over = over[u[over] >= self.share[edge[over]]]
            drawn.append((who, self.piece[edge]))
            counts[who] += 1
            at = self.previous[edge]
            on = at >= 0
            at, who = at[on], who[on]
            step += 1
        stop = np.cumsum(counts)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        for t, (w, p) in enumerate(drawn):
            out[stop[w] - 1 - t] = p
        return out, counts


def _one_by_one(filtered: np.ndarray, end: list[int], before: list[int], weight: list[float]) -> list[float]:
    """Chances of edges in order of their ends, where few units are left."""
    known: dict[int, float] = {}
    chance, i = [], 0
    while i < len(end):
        j = i
        terms = []
        while j < len(end) and end[j] == end[i]:
            at = before[j]
            terms.append((known[at] if at in known else float(filtered[at])) + weight[j])
            j += 1
        top = max(terms)
        parts = [math.exp(t - top) for t in terms]
        mass = sum(parts)
        known[end[i]] = top + math.log(mass)
        chance += [p / mass for p in parts]
        i = j
    return chance


def row_seed(key: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(key, seed)


def encode_batch(texts: list[str | None], keys: list[str], lattices: Lattices, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sampled piece ids of all texts, where each text's begin and end)."""
    units = [lattices.v.units.findall(" " + t) if t else [] for t in texts]
    sizes = np.array([len(u) for u in units], np.int64)
    if len(lattices.units) > lattices.store:
        lattices.clear()
    ends = lattices.ends([x for u in units for x in u])
    place = np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.array([row_seed(k, seed) for k in keys], np.uint64), sizes)
    seeds = (row ^ (place.astype(np.uint64) + np.uint64(1)) * _M2) * _M1
    pieces, counts = lattices.sample(ends, seeds)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    return pieces, total[np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])]


def encode_texts(texts: list[str | None], keys: list[str], lattices: Lattices, seed: int) -> list[np.ndarray | None]:
    """Sampled piece ids of each text."""
    pieces, at = encode_batch(texts, keys, lattices, seed)
    return [None if t is None else pieces[a:b] for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]


def decode_ids(ids: list[int] | None, pieces: list[bytes]) -> str | None:
    if ids is None:
        return None
    return b"".join([pieces[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def decode_batch(ids: np.ndarray, at: np.ndarray, valid: np.ndarray, v: Vocabulary) -> pa.Array:
    """The texts of all rows; row r has the ids from ``at[r]`` to ``at[r + 1]``.

    The bytes of a row's pieces are gathered, less the space that every text
    begins with, in parts of a bounded number of pieces."""
    sizes = v.sizes[ids]
    first = at[:-1][at[1:] > at[:-1]]  # the piece that a row begins with
    skip = np.zeros(len(ids), np.int64)
    skip[first] = np.minimum(sizes[first], 1)
    sizes -= skip
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    data = np.empty(int(ends[-1]), np.uint8)
    for i in range(0, len(ids), 1 << 17):
        j = min(len(ids), i + (1 << 17))
        shift = np.repeat(v.begins[ids[i:j]] + skip[i:j] - ends[i:j], sizes[i:j])
        data[ends[i] : ends[j]] = v.joined[shift + np.arange(ends[i], ends[j])]
    bitmap = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(valid), [bitmap, pa.py_buffer(ends[at].astype(np.int32).tobytes()), pa.py_buffer(data)]).cast(pa.string())


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _sampled(rows: Iterator[pa.RecordBatch], v: Vocabulary, alpha: float, seed: int, store: int = STORE_UNITS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Small batches of (text, key, ...) with their ids, where each row's begin, and which texts are not null."""
    lattices = Lattices(v, alpha, store)
    for b in small_batches(rows, 0, BATCH_BYTES):
        texts = b.column(0).to_pylist()
        ids, at = encode_batch(texts, [x or "\0null" for x in b.column(1).to_pylist()], lattices, seed)
        yield b, ids, at, np.array([t is not None for t in texts])


def _given(documents: DataFrame, key: str, kept: list[str]) -> DataFrame:
    text, name = unused(documents, "text_", "key_")
    return documents.select(F.col("text").cast("string").alias(text), F.col(key).cast("string").alias(name), *[F.col(c) for c in kept])


def encoded(documents: DataFrame, key: str = "doc_id", alpha: float = ALPHA, seed: int = SEED, model_file: str | None = None) -> DataFrame:
    """The columns of ``documents`` and ``pieces`` (array of ids), ``n_pieces``."""
    vocabulary = Vocabulary(model_file or default_model())
    kept = [c for c in documents.columns if c not in ("pieces", "n_pieces")]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, at, valid in _sampled(rows, vocabulary, alpha, seed):
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(~valid))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], lists, pa.array(np.diff(at))], names=[*b.schema.names[2:], "pieces", "n_pieces"])

    return _given(documents, key, kept).mapInArrow(batches, f"{_schema(documents.select(*kept))}, pieces array<int>, n_pieces long")


def decoded(pieces: DataFrame, model_file: str | None = None) -> DataFrame:
    """The columns of ``pieces`` and ``decoded``, the text of its ids."""
    vocabulary = Vocabulary(model_file or default_model())
    kept = [c for c in pieces.columns if c != "decoded"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lists = part.column(0)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                texts = decode_batch(ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), ~lists.is_null().to_numpy(zero_copy_only=False), vocabulary)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], texts], names=[*b.schema.names[1:], "decoded"])

    (name,) = unused(pieces, "pieces_")
    given = pieces.select(F.col("pieces").alias(name), *[F.col(c) for c in kept])
    return given.mapInArrow(batches, f"{_schema(pieces.select(*kept))}, decoded string")


def round_trips(documents: DataFrame, key: str = "doc_id", alpha: float = ALPHA, seed: int = SEED, model_file: str | None = None, store: int = STORE_UNITS) -> DataFrame:
    """``key``, n_pieces, lossless, pieces_sha256 (of the ids as little-endian
    int32, null for a null text): each row encoded and decoded again where it is,
    for checks that do not need the pieces themselves.  ``store`` units are kept in a
    task; it changes time and memory, not results."""
    vocabulary = Vocabulary(model_file or default_model())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, at, valid in _sampled(rows, vocabulary, alpha, seed, store):
            back = decode_batch(ids, at, valid, vocabulary)
            same = pc.fill_null(pc.equal(back, b.column(0)), pa.scalar(False))
            same = pc.or_(same, pc.and_(pc.is_null(back), pc.is_null(b.column(0))))
            little = ids.astype("<i4", copy=False)
            sums = [hashlib.sha256(little[i:j]).hexdigest() if ok else None for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(np.diff(at)), same, pa.array(sums, pa.string())], names=[key, "n_pieces", "lossless", "pieces_sha256"])

    return _given(documents, key, [key]).mapInArrow(batches, f"{_schema(documents.select(key))}, n_pieces long, lossless boolean, pieces_sha256 string")


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(dealt_table(spark, sf_dir, "documents"), store=WIDE_STORE_UNITS)


QUERIES = {"op6_piece_sampling": op6_piece_sampling}
ORACLES: dict[str, str] = {}
