"""Words, 64-bit word hashes and window hashes of whole texts, with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(27))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each window of ``n`` consecutive word hashes (none if there
    are fewer), by doubling: about log2(n) passes."""
    if len(h) < n:
        return h[:0]
    have, span, out, done = h, 1, None, 0
    while True:
        if n & span:
            part = have[done:]
            out = part if out is None else mixed(out[: len(part)] * ODD + part)
            done += span
        if span * 2 > n:
            return out
        have = mixed(have[:-span] * ODD + have[span:])
        span *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    have, span = x, 1
    while span * 2 <= w:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    return np.minimum(have[: len(x) - w + 1], have[w - span : w - span + len(x) - w + 1])


def _table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


#: Bytes that separate words: ASCII white space, or all ASCII but digits and small letters.
SPACES = _table(b"\t\n\x0b\x0c\r ")
MARKS = _table(bytes(c for c in range(128) if not (chr(c).isdigit() or chr(c).islower())))

_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time; what a step holds is some forty times this.
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def hashed_words(texts: list[bytes], separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes other than separators) of all
    texts in order, and how many each text has.

    The hash of a word is a polynomial of its bytes, from a running sum, then
    mixed.  Bytes are taken in pieces of ``PIECE``, whatever the texts' lengths;
    a word at a piece's border is carried over."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts, out = np.zeros(len(texts) + 1, np.int64), []
    power, inverse = _powers()
    carried, length = 0, 0  # the word that the piece before ended in: its sum and length so far
    for lo in range(0, len(data), PIECE):
        piece = data[lo : lo + PIECE]
        inside = ~separators[piece]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[piece] * power[: len(piece)])])
        value = (sums[end] - sums[start]) * inverse[start]
        goes_on = length > 0 and len(start) > 0 and start[0] == 0
        if goes_on:
            value[0] = (carried + int(value[0]) * pow(_BASE, length, 1 << 64)) & (1 << 64) - 1
        elif length:
            out.append(np.array([carried], np.uint64))
        is_open = len(end) > 0 and end[-1] == len(piece) and lo + PIECE < len(data)
        begun = start[1:] if goes_on else start
        counts += np.bincount(np.searchsorted(ends, begun + lo, side="right"), minlength=len(counts))[: len(counts)]
        if is_open:
            carried = int(value[-1])
            length = int(end[-1] - start[-1]) + (length if goes_on and len(start) == 1 else 0)
            value = value[:-1]
        else:
            carried, length = 0, 0
        out.append(value)
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return mixed(mixed(hashes)), counts[: len(texts)]
