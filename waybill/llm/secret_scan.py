"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns, checksums.

One pass of an Aho-Corasick automaton over a text finds where any keyword
begins; the patterns are then matched at those places only.  Runs of lower-case
hexadecimal digits have no keyword and are found by their length.  Formats
that embed a check are accepted only if it holds: service tokens whose last
six characters are the base-62 CRC-32 of the rest, web tokens whose header
decodes to a JSON object with an algorithm, and private keys whose base-64
body begins a DER sequence of the length it says.

Base spans are ``assign``, ``access`` and ``hex`` (leftmost and not
overlapping within a kind); the checked formats are added to them.  Positions
are code points, ends exclusive.

Everything is local to a row: nothing is shuffled, and a lost task is simply
run again.  Texts are whole; all patterns run in linear time.

Defined results: null and empty texts have no spans; every input row gives one
row, repeated ones too; an empty table gives no rows; other columns are
ignored by :func:`secrets` and kept by :func:`redacted`, where a null text
stays null.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import dealt_table, small_batches, unused

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "service", "web", "key")
BATCH_BYTES = 4 << 20

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
SERVICE = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
WEB = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
KEY = re.compile(rb"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )?PRIVATE KEY-----")
HEX_LEAST, ACCESS_LEAST, ASSIGN_LEAST = 24, 20, 6

#: What each keyword starts; all in lower case, as the text is for the search.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "service", "gho_": "service", "ghu_": "service", "ghs_": "service", "ghr_": "service",
    "npm_": "service", "eyj": "web", "-----begin ": "key",
}
_WEB_RUN = re.compile(rb"[A-Za-z0-9_-]+")
_HEX_MAP = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))
_HEX_RUN = b"1" * HEX_LEAST
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def base62(n: int, width: int) -> str:
    digits = ""
    while n:
        n, d = divmod(n, 62)
        digits = _BASE62[d] + digits
    return digits.rjust(width, "0")


def _service(m: re.Match) -> bool:
    return base62(zlib.crc32(m[1]), 6).encode() == m[2]


def _web(m: re.Match) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def _key(m: re.Match) -> bool:
    try:
        der = base64.b64decode(b"".join(m[2].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(der) < 2 or der[0] != 0x30:
        return False
    n, at = der[1], 2
    if n & 0x80:
        size = n & 0x7F
        n, at = int.from_bytes(der[2 : 2 + size], "big"), 2 + size
    return at + n == len(der)


_PATTERN = {"assign": ASSIGN, "access": ACCESS, "service": SERVICE, "web": WEB, "key": KEY}
_HOLDS = {
    "assign": lambda m: m.end(2) - m.start(2) >= ASSIGN_LEAST,
    "access": lambda m: m.end() - m.start() >= ACCESS_LEAST,
    "service": _service, "web": _web, "key": _key,
}


def byte_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of the UTF-8 text."""
    spans, done = [], dict.fromkeys(_PATTERN, 0)
    near = [(end + 1 - n, kind) for end, (n, kind) in automaton().iter(raw.lower().decode("latin-1"))]
    for at, kind in sorted(set(near)):
        if at < done[kind]:
            continue
        m = _PATTERN[kind].match(raw, at)
        if m:
            done[kind] = m.end()
            if _HOLDS[kind](m):
                spans.append((kind, at, m.end()))
        elif kind == "web":
            # what follows a run decides, so other beginnings in the same run fail as well
            done[kind] = _WEB_RUN.match(raw, at).end()
    run = raw.translate(_HEX_MAP)
    at = run.find(_HEX_RUN)
    while at >= 0:
        end = run.find(b"0", at)
        end = len(run) if end < 0 else end
        spans.append(("hex", at, end))
        at = run.find(_HEX_RUN, end)
    return spans


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    spans = byte_spans(raw)
    if spans and len(raw) != len(text):
        before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        spans = [(k, int(before[a]), int(before[b])) for k, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text", BATCH_BYTES):
        found = [spans_of(t) for t in b.column(1).to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in BASE_KINDS]
        base = [joined([s for s in spans if s[0] in BASE_KINDS]) for spans in found]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([joined(s) for s in found], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secrets(documents: DataFrame) -> DataFrame:
    """Secrets of each document: counts and hash of the base spans, all spans."""
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None) -> str | None:
    """The text with each secret replaced by its kind; overlapping ones by the first's."""
    out, at = [], 0
    for kind, start, end in spans_of(text):
        if start >= at:
            out += (text[at:start], f"[{kind}]")
        at = max(at, end)
    return "".join((*out, text[at:])) if out else text


def redacted(documents: DataFrame) -> DataFrame:
    """The documents, all columns, with secrets cut out of ``text`` and n_chars
    counted anew where it changed."""
    names = documents.columns
    text, changed_ = unused(documents, "text_", "changed")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(rows, 0, BATCH_BYTES):
            before = b.column(0).to_pylist()
            after = [redact(t) for t in before]
            changed = pa.array([x is not y for x, y in zip(before, after, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(after, pa.string()), changed, *b.columns[1:]], names=[text, changed_, *b.schema.names[1:]])

    others = [c for c in names if c != "text"]
    given = documents.select(F.col("text").cast("string").alias(text), *[F.col(c) for c in others])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    out = given.mapInArrow(batches, f"{text} string, {changed_} boolean{', ' + schema if schema else ''}")
    n_chars = F.when(F.col(changed_), F.length(text).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in names else None
    return out.select(*[F.col(text).alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(c) for c in names])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(dealt_table(spark, sf_dir, "documents"))


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}
