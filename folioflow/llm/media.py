"""Media columns: ISO base media containers written and read as boxes.

A payload of bytes is kept as unsigned 8-bit samples in one audio track.  Reading walks
the nested boxes and decodes the sample tables only: codec, duration and the byte ranges
of key frames come out without touching the payload.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_columns

#: Bytes of one packet, packets of one chunk, packets from one key frame to the next.
PACKET = 192
CHUNK = 32
SYNC = 16
RATE = 8000
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_container(payload: bytes) -> bytes:
    """One audio track of 8-bit samples over ``payload``, a multiple of PACKET bytes."""
    packets = len(payload) // PACKET
    if packets * PACKET != len(payload):
        raise ValueError("the payload is not a multiple of the packet size")
    chunks, tail = -(-packets // CHUNK), packets % CHUNK
    runs = [(1, CHUNK, 1)] if packets >= CHUNK else []
    if tail:
        runs.append((chunks, tail, 1))
    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    sync = np.arange(1, packets + 1, SYNC, dtype=">u4")

    def movie(first: int, wide: bool) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * (CHUNK * PACKET)
        places = full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes())
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, packets, PACKET)),
            full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", PACKET, packets)),
            places,
        )
        info = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables)
        length = packets * PACKET
        media = box(
            b"mdia",
            full(b"mdhd", bytes(8), struct.pack(">IIHH", RATE, length & 0xFFFFFFFF, 0x55C4, 0)),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            info,
        )
        track = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, length & 0xFFFFFFFF), bytes(8), struct.pack(">hhhh", 0, 0, 256, 0), _MATRIX, bytes(8), flags=7)
        head = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, length & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, box(b"trak", track, media))

    wide = len(payload) > (1 << 32) - (1 << 20)
    front = len(brand) + len(movie(0, wide)) + (16 if wide else 8)
    return brand + movie(front, wide) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, stop: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, start and end of the body) of every box, containers before what they hold; stops at a broken size."""
    stop = len(data) if stop is None else stop
    while start + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= stop:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            return
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, here)
        start += size


def _table(data: bytes, span: tuple[int, int] | None, kind: str, skip: int = 4) -> np.ndarray:
    """Entries of a full box: after version and flags a count (at ``skip``), then the entries, as many as the box holds."""
    width = np.dtype(kind)
    if span is None or span[1] - span[0] < skip + 4:
        return np.zeros(0, width)
    at, end = span
    n = struct.unpack_from(">I", data, at + skip)[0]
    return np.frombuffer(data, width, min(n, (end - at - skip - 4) // width.itemsize), at + skip + 4)


def tracks(data: bytes) -> list[dict]:
    """For each track its codec, timescale, duration, and start and end of every sample, key frames marked.

    Boxes that are too short for what they should hold count as missing; samples that would
    lie outside the data end the list of samples.
    """
    out: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            out.append({})
        elif kind == b"mdhd" and out and end > at:
            wide = data[at] == 1
            if end - at >= (32 if wide else 20):
                out[-1]["timescale"], out[-1]["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"stsd" and out and end - at >= 16:
            out[-1]["codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif path[-2:-1] == (b"stbl",) and out:
            out[-1][kind] = (at, end)
    return [_samples(data, t) for t in out]


def _sizes(data: bytes, span: tuple[int, int] | None) -> np.ndarray:
    if span is None or span[1] - span[0] < 12:
        return np.zeros(0, np.int64)
    uniform, n = struct.unpack_from(">II", data, span[0] + 4)
    if uniform:
        return np.full(min(n, len(data) // uniform), uniform, np.int64)  # more samples than the data holds can't be
    return _table(data, span, ">u4", 8).astype(np.int64)


def _samples(data: bytes, t: dict) -> dict:
    sizes = _sizes(data, t.get(b"stsz"))
    places = (_table(data, t[b"co64"], ">u8") if b"co64" in t else _table(data, t.get(b"stco"), ">u4")).astype(np.int64)
    runs = _table(data, t.get(b"stsc"), ">u4,>u4,>u4")
    first, each = runs["f0"].astype(np.int64), runs["f1"].astype(np.int64)
    lasts = np.append(first[1:], len(places) + 1)
    ok = len(first) and first[0] == 1 and (lasts >= first).all() and lasts.max() <= len(places) + 1
    per = np.repeat(each, lasts - first) if ok else np.zeros(0, np.int64)
    per = np.clip(len(sizes) - (np.cumsum(per) - per), 0, per)
    chunk = np.repeat(np.arange(len(per)), per)
    sizes = sizes[: len(chunk)]
    ahead = np.cumsum(sizes) - sizes
    lead = (np.cumsum(per) - per)[chunk]
    starts = places[chunk] + ahead - ahead[lead] if len(sizes) else np.zeros(0, np.int64)
    outside = np.flatnonzero((starts < 0) | (starts + sizes > len(data)))
    whole = int(outside[0]) if len(outside) else len(sizes)
    starts, sizes = starts[:whole], sizes[:whole]
    sync = _table(data, t[b"stss"], ">u4").astype(np.int64) - 1 if b"stss" in t else np.arange(len(sizes))
    return {
        "codec": t.get("codec", ""),
        "timescale": t.get("timescale", 0),
        "duration": min(t.get("duration", 0), (1 << 63) - 1),
        "starts": starts,
        "ends": starts + sizes,
        "sync": sync[(sync >= 0) & (sync < len(sizes))],
    }


def read_samples(data: bytes, track: dict) -> bytes:
    """All samples of a track, neighbouring ranges read at once."""
    starts, ends = track["starts"], track["ends"]
    if not len(starts):
        return b""
    gap = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    lo, hi = starts[np.append(0, gap)], ends[np.append(gap - 1, len(ends) - 1)]
    return b"".join(data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True))


def _contained(text: bytes | None) -> tuple[int, bytes]:
    raw = text or b""
    return len(raw), write_container(raw + b" " * (max(PACKET, -(-len(raw) // PACKET) * PACKET) - len(raw)))


STORED = [T.StructField("n_bytes", T.LongType(), False), T.StructField("media", T.BinaryType(), False)]


def store(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by ``n_bytes`` and ``media``, a container with its UTF-8 bytes padded by spaces.

    Null is an empty text; empty texts are one packet of padding.  Equal texts give equal
    bytes.  An input column with the name of an output column is replaced.  A text is one container,
    however long; repeated rows stay; an empty table stays empty.
    """

    def make(batch: pa.RecordBatch) -> list:
        return list(zip(*map(_contained, batch.column(text_col).cast(pa.binary()).to_pylist()), strict=True))

    return append_columns(df, make, STORED, text_col, (text_col,))


RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


PROBED = [
    T.StructField("codec", T.StringType(), False),
    T.StructField("timescale", T.LongType(), False),
    T.StructField("duration", T.LongType(), False),
    T.StructField("keyframes", RANGES, False),
    T.StructField("payload", T.BinaryType(), False),
]


def _probed(data: bytes | None, with_payload: bool) -> tuple:
    data = data or b""
    t = next(iter(tracks(data)), None)
    if t is None:
        return ("", 0, 0, [], b"")[: 4 + with_payload]
    keys = zip(t["starts"][t["sync"]].tolist(), t["ends"][t["sync"]].tolist(), strict=True)
    row = (t["codec"], t["timescale"], t["duration"], [{"start": a, "end": b} for a, b in keys])
    return (*row, read_samples(data, t)) if with_payload else row


def probe(df: DataFrame, media_col: str = "media", with_payload: bool = False) -> DataFrame:
    """Add codec, timescale, duration and keyframes (byte ranges) of the first track, and its samples on request.

    Null containers and such without a track have an empty codec, zero durations and no key
    frames; of broken tracks what their boxes still hold is told (see ``tracks``).  An input
    column with the name of an output column is replaced.
    """

    def make(batch: pa.RecordBatch) -> list:
        return list(zip(*(_probed(data, with_payload) for data in batch.column(media_col).to_pylist()), strict=True))

    return append_columns(df, make, PROBED if with_payload else PROBED[:4], media_col)


def store_and_probe(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``store``, and ``probe`` with the payload on what was stored, in one pass of the same worker; the same cases hold."""

    def make(batch: pa.RecordBatch) -> list:
        stored = list(map(_contained, batch.column(text_col).cast(pa.binary()).to_pylist()))
        return list(zip(*((*s, *_probed(s[1], True)) for s in stored), strict=True))

    return append_columns(df, make, STORED + PROBED, text_col, (text_col,))


def media_report(df: DataFrame) -> DataFrame:
    """Per row the digests of the stored form and of the payload read back from it, and its features.

    Null texts count as empty; long texts are stored whole; repeated rows stay and get equal values;
    other columns are not read; an empty table gives no rows.
    """
    read = store_and_probe(df.select("doc_id", "text"))
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string"))), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", "codec", F.col("timescale").cast("string"), F.col("duration").cast("string"), F.size("keyframes").cast("string"), ranges).alias("feature"),
    )
