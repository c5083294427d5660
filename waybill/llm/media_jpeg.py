"""Media columns: baseline JPEG written and read with numpy.

A payload becomes a greyscale baseline JPEG whose 8x8 blocks are flat: each
payload byte is the sample value of one block, so the DC coefficients carry
the payload without loss (DC quantiser 8, no AC energy).  Reading parses the
markers, Huffman-decodes the scans and rebuilds the DC-only luminance
thumbnail, which for such files is the payload again.  The reader is general:
any baseline file (several components, subsampling, restart intervals, AC
coefficients, several scans) gives its luminance thumbnail.

The stored form is the ``media`` column of :func:`with_media`; whoever keeps it
writes that table.  The query hands the column from the one Python step to the
other through Spark and does not write it, as it holds every text once more.

Restart intervals are byte-aligned and independent, so the reader advances
all intervals of many images in step, one block at a time, with numpy.  A long
text is many images: both ways take a few of them at a time.

Defined results: a null or empty text is the payload of 64 zero bytes; equal
texts give equal values; rows are neither dropped nor merged (repeated
doc_ids stay repeated rows); an empty table gives an empty table; columns
other than the ones named are ignored; a media value that is null or not a
baseline JPEG gives null features from ``thumbnail_features``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import dealt_table, small_batches

UNIT = 64
ROWS_PER_IMAGE = 8191  # 8 * 8191 lines is the most that a JPEG frame header can say
CHUNK_BYTES = 1 << 20

# The luminance DC code of the JPEG standard (code counts by
# length 1..16, then the size categories in order).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
# An AC code of one symbol, end-of-block, one bit long.
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def code_table(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Canonical (symbol, length, code) triples."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], length, code))
            code += 1
            at += 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def peek_table(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, length, code in code_table(counts, symbols):
        lo = code << (16 - length)
        table[lo : lo + (1 << (16 - length))] = length << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(block_rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
        _segment(0xDB, b"\0" + b"\x08" + b"\x01" * 63),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * block_rows, 8 * UNIT, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", UNIT)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


_SIZE = np.array([int(abs(d)).bit_length() for d in range(-255, 256)])  # category by diff + 255
_DC = {s: (n, c) for s, n, c in code_table(DC_COUNTS, DC_SYMBOLS)}
_BITS = np.array([_DC[s][0] + s + 1 for s in _SIZE])
_WORD = np.array([((_DC[s][1] << s | (d if d > 0 else d + (1 << s) - 1)) << 1) for s, d in zip(_SIZE.tolist(), range(-255, 256), strict=True)])


def pad(payload: bytes) -> bytes:
    return payload + b"\0" * (-len(payload) % UNIT or (0 if payload else UNIT))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Padded payloads to JPEG bytes; a payload beyond one frame becomes
    several images, one after the other."""
    rows_of = [len(p) // UNIT for p in payloads]
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT).astype(np.int64) - 128
    diff = np.diff(rows, axis=1, prepend=0) + 255
    nbits, word = _BITS[diff], _WORD[diff]
    ends = np.cumsum(nbits, axis=1)
    row_bits = ends[:, -1]
    row_bytes = (row_bits + 7) >> 3
    row_at = np.cumsum(row_bytes) - row_bytes
    at = (row_at[:, None] * 8 + ends - nbits).ravel()
    shifted = (word.ravel() << (24 - (at & 7) - nbits.ravel()))
    byte = at >> 3
    total = int(row_bytes.sum())
    data = np.zeros(total + 2, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        data += np.bincount(byte + k, weights=(shifted >> shift) & 255, minlength=total + 2)[: total + 2].astype(np.int64)
    data = data[:total]
    last = row_at + row_bytes - 1
    data[last] |= (1 << (row_bytes * 8 - row_bits)) - 1

    # which rows end an image, and the restart number of the others
    number = np.concatenate([np.arange(n) for n in rows_of]) if rows_of else np.zeros(0, int)
    in_image = number % ROWS_PER_IMAGE
    doc_end = np.zeros(len(rows), bool)
    doc_end[np.cumsum(rows_of) - 1] = True
    image_end = doc_end | (in_image == ROWS_PER_IMAGE - 1)
    stuffed = data == 255
    width = 1 + stuffed
    width[last] += 2 * ~image_end
    to = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[to] = data
    mark = last[~image_end]
    where = to[mark] + 1 + stuffed[mark]
    out[where] = 255
    out[where + 1] = 0xD0 + (in_image[~image_end] & 7)

    stops = (to + width)[last]
    media, row, begin = [], 0, 0
    for n in rows_of:
        parts, left = [], n
        while left:
            take = min(left, ROWS_PER_IMAGE)
            row, left = row + take, left - take
            stop = int(stops[row - 1])
            parts += (_header(take), out[begin:stop].tobytes(), b"\xff\xd9")
            begin = stop
        media.append(b"".join(parts))
    return media


@dataclass
class Scan:
    """One entropy-coded scan: restart intervals and what they mean."""

    tables: tuple  # ((dc counts, dc symbols), (ac counts, ac symbols)) by component of the scan
    layout: tuple[int, ...]  # component (index in the scan) of each block of an MCU
    mcus: int
    interval: int
    data: bytes
    picture: "Picture | None" = None
    components: tuple[int, ...] = ()


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    sampling: list = field(default_factory=list)  # (id, h, v, quantiser id)
    quantisers: dict = field(default_factory=dict)
    dc: dict = field(default_factory=dict)  # component -> DC coefficients in scan order


class NotBaseline(ValueError):
    pass


def parse(media: bytes) -> Iterator[tuple[Picture, list[Scan]]]:
    """Markers of one or more concatenated baseline images, one after the other."""
    scans, at, end = [], 0, len(media)
    picture, huffman, interval = None, {}, 0
    while at < end:
        if media[at] != 0xFF or at + 1 >= end:
            raise NotBaseline("marker expected")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        at += 2
        if marker == 0xD8:
            if picture is not None:
                yield picture, scans
            picture, scans, huffman, interval = Picture(), [], {}, 0
            continue
        if marker == 0xD9:
            continue
        if picture is None or at + 2 > end:
            raise NotBaseline("no image start")
        size = int.from_bytes(media[at : at + 2], "big")
        body = media[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                first = int.from_bytes(body[1 : 3 if wide else 2], "big")
                picture.quantisers[which] = first
                body = body[1 + (128 if wide else 64) :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                n = sum(counts)
                huffman[body[0]] = (counts, tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, picture.height, picture.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not picture.width or not picture.height:
                raise NotBaseline("8-bit samples and known dimensions only")
            picture.sampling = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise NotBaseline("not a baseline frame")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            n = body[0]
            ids = {s[0]: i for i, s in enumerate(picture.sampling)}
            members = tuple(ids[body[1 + 2 * i]] for i in range(n))
            tables = tuple((huffman[body[2 + 2 * i] >> 4], huffman[16 | body[2 + 2 * i] & 15]) for i in range(n))
            hmax = max(s[1] for s in picture.sampling)
            vmax = max(s[2] for s in picture.sampling)
            if n == 1:  # blocks of the component alone, without padding to MCUs
                _, h, v, _ = picture.sampling[members[0]]
                across, down = -(-(-(-picture.width * h // hmax)) // 8), -(-(-(-picture.height * v // vmax)) // 8)
                layout = (0,)
            else:
                across, down = -(-picture.width // (8 * hmax)), -(-picture.height // (8 * vmax))
                layout = tuple(i for i, m in enumerate(members) for _ in range(picture.sampling[m][1] * picture.sampling[m][2]))
            stop = at
            while True:
                stop = media.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= end:
                    stop = end
                    break
                if media[stop + 1] in (0, 0xFF) or 0xD0 <= media[stop + 1] <= 0xD7:
                    stop = _next_marker(media, stop)
                break
            scans.append(Scan(tables, layout, across * down, interval or across * down, media[at:stop], picture, members))
            at = stop
    if picture is None:
        raise NotBaseline("empty")
    yield picture, scans


def _next_marker(media: bytes, at: int) -> int:
    """First marker from ``at`` on that is neither stuffing nor a restart."""
    while at + 1 < len(media):
        data = np.frombuffer(media, np.uint8, count=min(len(media) - at, CHUNK_BYTES), offset=at)
        ff = np.flatnonzero(data[:-1] == 255)
        after = data[ff + 1]
        stop = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
        if len(stop):
            return at + int(stop[0])
        at += len(data) - 1
    return len(media)


def _intervals(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and restart markers, and where intervals start."""
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[restart] = keep[restart + 1] = False
    keep[ff[after == 255]] = False
    before = np.cumsum(keep)
    return raw[keep], np.concatenate([[0], before[restart]])


def decode_scans(scans: list[Scan]) -> None:
    """Fill ``picture.dc``; scans that share tables and layout go in step."""
    groups: dict = {}
    for scan in scans:
        groups.setdefault((scan.tables, scan.layout), []).append(scan)
    for (tables, layout), members in groups.items():
        bufs, starts, blocks, at = [], [], [], 0
        for scan in members:
            data, begin = _intervals(scan.data)
            need = -(-scan.mcus // scan.interval)
            if len(begin) < need:
                raise NotBaseline("scan ends early")
            begin = begin[:need]
            n = np.full(need, scan.interval * len(layout))
            n[-1] = (scan.mcus - (need - 1) * scan.interval) * len(layout)
            starts.append(begin + at)
            blocks.append(n)
            bufs.append(data)
            at += len(data)
        dc = _decode_lanes(np.concatenate(bufs), np.concatenate(starts), np.concatenate(blocks), tables, layout)
        lane = 0
        for scan, n in zip(members, blocks, strict=True):
            values = dc[lane : lane + len(n)]
            values = values.ravel() if (n == values.shape[1]).all() else np.concatenate([v[:k] for v, k in zip(values, n.tolist(), strict=True)])
            lane += len(n)
            by_block = values.reshape(-1, len(layout))
            for i, component in enumerate(scan.components):
                scan.picture.dc[component] = by_block[:, [j for j, c in enumerate(layout) if c == i]]


def _decode_lanes(buf: np.ndarray, starts: np.ndarray, blocks: np.ndarray, tables: tuple, layout: tuple[int, ...]) -> np.ndarray:
    """DC coefficients [interval, block]; all intervals take each block together."""
    b = np.concatenate([buf, np.full(8, 255, np.uint8)])
    window = np.zeros(len(buf) + 1, np.int64)  # 40 bits from each byte on
    for k in range(5):
        window = window << 8 | b[k : k + len(buf) + 1]
    limit = len(buf)
    order = np.argsort(-blocks, kind="stable")
    pos = (starts[order] * 8).astype(np.int64)
    left = blocks[order]
    most = int(left[0]) if len(left) else 0
    active_at = np.searchsorted(-left, -np.arange(1, most + 1), side="right")
    pred = np.zeros((len(tables), len(pos)), np.int64)
    out = np.zeros((most, len(pos)), np.int16)
    dcs = [peek_table(*t[0]) for t in tables]
    acs = [peek_table(*t[1]) for t in tables]

    def symbol(table: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w, used = window[np.minimum(p >> 3, limit)], p & 7
        hit = table[(w >> (24 - used)) & 0xFFFF]
        return w, used, hit >> 8, hit & 255

    for block in range(most):
        n = int(active_at[block])
        c = layout[block % len(layout)]
        p = pos[:n]
        w, used, length, size = symbol(dcs[c], p)
        if not length.all():
            raise NotBaseline("bad DC code")
        value = (w >> (40 - used - length - size)) & ((1 << size) - 1)
        value -= np.where(value < (1 << size) >> 1, (1 << size) - 1, 0)
        pred[c, :n] += value
        out[block, :n] = pred[c, :n]
        p = p + length + size
        w, used, length, sym = symbol(acs[c], p)
        p += length
        if sym.any() or not length.all():
            p -= length
            p = _skip_ac(p, lambda q, t=acs[c]: symbol(t, q))
        pos[:n] = p
    back = np.empty_like(out)
    back[:, order] = out
    return back.T


def _skip_ac(p: np.ndarray, symbol) -> np.ndarray:
    """Bit positions after the AC coefficients of one block in each lane."""
    p, k, lanes = p.copy(), np.ones(len(p), np.int64), np.arange(len(p))
    while len(lanes):
        _, _, length, sym = symbol(p[lanes])
        if not length.all():
            raise NotBaseline("bad AC code")
        run, size = sym >> 4, sym & 15
        p[lanes] += length + size
        k[lanes] += run + 1
        lanes = lanes[~((size == 0) & (run != 15)) & (k[lanes] < 64)]
    return p


def thumbnail(picture: Picture) -> np.ndarray:
    """DC-only luminance at an eighth of the size, as 8-bit samples."""
    _, h, v, q = picture.sampling[0]
    hmax, vmax = max(s[1] for s in picture.sampling), max(s[2] for s in picture.sampling)
    wide = -(-(-(-picture.width * h // hmax)) // 8)
    tall = -(-(-(-picture.height * v // vmax)) // 8)
    dc = picture.dc[0].astype(np.int64)
    if dc.shape[1] == 1:
        grid = dc.reshape(-1, wide)
    else:
        across = -(-picture.width // (8 * hmax))
        grid = dc.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
    samples = np.floor_divide(grid * picture.quantisers[q] + 4, 8) + 128
    return np.clip(samples, 0, 255).astype(np.uint8)[:tall, :wide]


def _long_thumbnails(media: bytes) -> list[tuple[int, int, np.ndarray]] | None:
    """The same for a long value: a few images at a time, so what is held besides the
    value and its thumbnails does not grow with it."""
    out: list[tuple[int, int, np.ndarray]] = []
    some, held = [], 0

    def read() -> None:
        decode_scans([s for _, scans in some for s in scans])
        out.extend((p.width, p.height, thumbnail(p)) for p, _ in some)

    try:
        for picture, scans in parse(media):
            size = sum(len(s.data) for s in scans)
            if some and held + size > CHUNK_BYTES:
                read()
                some, held = [], 0
            some.append((picture, scans))
            held += size
        read()
    except (NotBaseline, KeyError, ValueError, IndexError, struct.error):
        return None
    return out


def thumbnails(media: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """(width, height, thumbnail) of each image in each value; None if unreadable."""
    parsed = []
    for m in media:
        try:
            parsed.append(list(parse(m)) if m and len(m) <= CHUNK_BYTES else None)
        except (NotBaseline, KeyError, IndexError, struct.error):
            parsed.append(None)
    scans_of = lambda x: [s for _, scans in x for s in scans]
    try:
        decode_scans([s for x in parsed if x for s in scans_of(x)])
    except (NotBaseline, IndexError):  # find the bad one: each by itself
        for i, x in enumerate(parsed):
            try:
                if x:
                    decode_scans(scans_of(x))
            except (NotBaseline, IndexError):
                parsed[i] = None
    out = []
    for m, x in zip(media, parsed, strict=True):
        try:
            out.append([(p.width, p.height, thumbnail(p)) for p, _ in x] if x else _long_thumbnails(m) if m and len(m) > CHUNK_BYTES else None)
        except (KeyError, ValueError, IndexError):
            out.append(None)
    return out


def thumbnail_hashes(thumb: np.ndarray) -> tuple[str, str]:
    """(average hash, difference hash) of an 8x8 and a 8x9 reduction, as hex."""
    def reduce(rows: int, cols: int) -> np.ndarray:
        r = np.arange(rows) * thumb.shape[0] // rows
        c = np.arange(cols) * thumb.shape[1] // cols
        bands = zip(r.tolist(), np.append(r[1:], thumb.shape[0]).tolist(), strict=True)
        cell = np.add.reduceat(np.stack([thumb[a : max(b, a + 1)].sum(axis=0, dtype=np.int64) for a, b in bands]), c, axis=1)
        span = lambda x, end: np.maximum(np.diff(np.append(x, end)), 1)
        return cell * 1024 // (span(r, thumb.shape[0])[:, None] * span(c, thumb.shape[1])[None, :])

    a, d = reduce(8, 8), reduce(8, 9)
    return np.packbits(a > a.mean()).tobytes().hex(), np.packbits(d[:, 1:] > d[:, :-1]).tobytes().hex()


def encoded(payloads: list[bytes]) -> list[bytes]:
    """As :func:`encode_payloads`; long ones an image after the other, so what a step
    holds does not grow with them."""
    size = UNIT * ROWS_PER_IMAGE
    if all(len(p) <= CHUNK_BYTES for p in payloads):
        return encode_payloads(payloads)
    return [b"".join(encode_payloads([p[i : i + size]])[0] for i in range(0, len(p), size)) for p in payloads]


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text", CHUNK_BYTES):
        raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(encoded([pad(x) for x in raw]), pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )


def with_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored as a JPEG column."""
    return documents.select("doc_id", "text").mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, average_hash string, difference_hash string"


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in FEATURES.split(", ")]
    for b in small_batches(batches, "media", CHUNK_BYTES):
        media = b.column(2).to_pylist()
        rows = []
        for m, images in zip(media, thumbnails(media), strict=True):
            if images is None:
                rows.append((None,) * 4 + (len(m) if m is not None else None, hashlib.sha256(m).hexdigest() if m is not None else None) + (None,) * 5)
                continue
            width, height = images[0][0], sum(h for _, h, _ in images)
            thumb = images[0][2] if len(images) == 1 else np.concatenate([t for _, _, t in images])
            payload = memoryview(np.ascontiguousarray(thumb)).cast("B")
            ah, dh = thumbnail_hashes(thumb)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), f"{width}x{height}:{ah}:{dh}", len(m), hashlib.sha256(m).hexdigest(), width, height, ah, dh, None))
        order = (0, 1, 2, 4, 5, 3, 6, 7, 8, 9)
        cols = [pa.array([r[k] for r in rows], t) for k, t in zip(order, types[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=names)


def thumbnail_features(media: DataFrame) -> DataFrame:
    """Read the stored JPEGs: dimensions, thumbnail hashes and read-back digests."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_feature_batches, FEATURES)


def op1_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = dealt_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string"))
    return thumbnail_features(with_media(documents))


QUERIES = {"op1_media_jpeg": op1_media_jpeg}
ORACLES: dict[str, str] = {}
