"""Media columns from ISO media containers.

A container is a tree of boxes. `describe` walks it, decodes the sample tables of
its first track and returns codec, duration and the byte range of every keyframe;
the payload itself is neither decoded nor copied. `store` writes such containers:
uncompressed grey frames of 24 x 24 samples of 8 bits, one track.

Every row is worked on alone, so tasks hold one slice of a batch at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import returning_memory
from .tables import load

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
FRAMES_PER_CHUNK = 64
GROUP_BYTES = 8 << 20
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}


class MediaError(ValueError):
    """The bytes are not a container that can be described."""


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def feature(self) -> str:
        seconds = self.duration / self.timescale if self.timescale else 0.0
        return f"{self.codec.strip()} {self.width}x{self.height} {seconds:.2f}s frames={len(self.sizes)} keyframes={len(self.keyframes)}"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(text: bytes) -> bytes:
    """The text and bytes 255 up to whole frames, at least one."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def write(payload: bytes) -> bytes:
    """A container with the payload as its frames; its length must be whole frames."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_PER_CHUNK)
    runs = [(1, min(frames, FRAMES_PER_CHUNK), 1)]
    if chunks > 1 and frames % FRAMES_PER_CHUNK:
        runs.append((chunks, frames % FRAMES_PER_CHUNK, 1))
    wide = len(payload) > 0xF0000000

    def moov(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (FRAMES_PER_CHUNK * FRAME)
        entry = _box(
            b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHII", SIDE, SIDE, 0x480000, 0x480000),
            bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1),
        )
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">i8" if wide else ">u4").tobytes()),
        )
        info = _box(
            b"minf",
            _full(b"vmhd", bytes(8), flags=1),
            _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))),
            table,
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            info,
        )
        head = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(8), bytes(8), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", head, media))

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    opening = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(kind) + len(moov(0)) + len(opening)
    return b"".join((kind, moov(first), opening, payload))


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of the body of every box, outer ones first."""
    while start < end:
        if end - start < 8:
            raise MediaError("box header cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise MediaError("box header cut short")
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if size < head or size > end - start:
            raise MediaError(f"box {kind!r} does not fit")
        yield (*path, kind), start + head, start + size
        if kind in _NESTED:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _table(data: memoryview, start: int, end: int, dtype: str, width: int = 1, at: int = 4) -> np.ndarray:
    """The counted entries of a full box."""
    if end - start < at + 4:
        raise MediaError("table cut short")
    (count,) = struct.unpack_from(">I", data, start + at)
    item = np.dtype(dtype)
    if count * width * item.itemsize > end - start - at - 4:
        raise MediaError("table cut short")
    return np.frombuffer(data, item, count * width, start + at + 4).astype(np.int64).reshape(-1, width)


def read(content: bytes) -> Track:
    """Describe the first track of a container."""
    data = memoryview(content)
    found: dict[bytes, tuple[int, int]] = {}
    tracks = 0
    for path, start, end in walk(data, 0, len(data)):
        tracks += path == (b"moov", b"trak")
        if tracks == 1 and b"trak" in path:
            found.setdefault(path[-1], (start, end))
    if not tracks:
        raise MediaError("no track")
    missing = [k for k in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc") if k not in found]
    if missing or not ({b"stsz", b"stz2"} & found.keys()) or not ({b"stco", b"co64"} & found.keys()):
        raise MediaError("no sample tables")
    out = Track()
    try:
        start, _ = found[b"mdhd"]
        out.timescale, out.duration = struct.unpack_from(">IQ", data, start + 20) if data[start] == 1 else struct.unpack_from(">II", data, start + 12)
        start, _ = found[b"hdlr"]
        out.handler = bytes(data[start + 8 : start + 12]).decode("latin-1")
        start, end = found[b"stsd"]
        out.codec = bytes(data[start + 12 : start + 16]).decode("latin-1")
        if out.handler == "vide":
            out.width, out.height = struct.unpack_from(">HH", data, start + 8 + 32)
    except struct.error as error:
        raise MediaError("box cut short") from error
    if b"stsz" in found:
        start, end = found[b"stsz"]
        if end - start < 12:
            raise MediaError("table cut short")
        uniform, count = struct.unpack_from(">II", data, start + 4)
        if uniform and count * uniform > len(data):
            raise MediaError("samples beyond the file")
        out.sizes = np.full(count, uniform, np.int64) if uniform else _table(data, start, end, ">u4", at=8)[:, 0]
    else:
        start, end = found[b"stz2"]
        if end - start < 12 or data[start + 7] not in (8, 16):
            raise MediaError("sample sizes of this width are not read")
        out.sizes = _table(data, start, end, ">u1" if data[start + 7] == 8 else ">u2", at=8)[:, 0]
    chunks = _table(data, *found[b"co64"], ">u8")[:, 0] if b"co64" in found else _table(data, *found[b"stco"], ">u4")[:, 0]
    out.offsets = _sample_offsets(out.sizes, chunks, _table(data, *found[b"stsc"], ">u4", 3))
    if len(out.offsets) and (out.offsets.min() < 0 or int((out.offsets + out.sizes).max()) > len(data)):
        raise MediaError("samples beyond the file")
    out.keyframes = _table(data, *found[b"stss"], ">u4")[:, 0] - 1 if b"stss" in found else np.arange(len(out.sizes))
    if len(out.keyframes) and (out.keyframes.min() < 0 or out.keyframes.max() >= len(out.sizes)):
        raise MediaError("keyframe beyond the samples")
    return out


def _sample_offsets(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Samples lie one behind another in their chunk; runs give how many a chunk has."""
    if not len(sizes):
        return np.empty(0, np.int64)
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise MediaError("chunk runs out of order")
    per_chunk = np.repeat(runs[:, 1], np.maximum(0, np.diff(np.append(np.minimum(runs[:, 0], len(chunks) + 1), len(chunks) + 1))))
    ends = np.minimum(np.cumsum(np.minimum(per_chunk, len(sizes))), len(sizes))
    if not len(ends) or ends[-1] < len(sizes):
        raise MediaError("fewer places than samples")
    first = np.concatenate([[0], ends[:-1]])
    chunk = np.repeat(np.arange(len(ends)), ends - first)
    first = np.minimum(first, len(sizes) - 1)
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return chunks[chunk] + before - before[first[chunk]]


def samples(content: bytes, track: Track) -> bytes:
    """The stored bytes of all samples in order."""
    edges = np.flatnonzero(np.diff(track.offsets) != track.sizes[:-1]) + 1
    view = memoryview(content)
    firsts, lasts = np.concatenate([[0], edges]), np.concatenate([edges, [len(track.sizes)]]) - 1
    if not len(track.sizes):
        return b""
    return b"".join(view[track.offsets[a] : track.offsets[b] + track.sizes[b]] for a, b in zip(firsts, lasts, strict=True))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Row ranges of bounded content."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > GROUP_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as a container.

    The text's UTF-8 bytes, padded with bytes 255 to whole frames, are the frames.
    Null and empty texts are one frame of padding. Rows with equal or null ids are
    separate rows. Other columns are not read.
    """

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                texts = [t or b"" for t in part.column("text").to_pylist()]
                arrays = [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_RANGE = pa.struct([("first", pa.int64()), ("bytes", pa.int64())])
_DESCRIBED = {
    "error": pa.string(), "codec": pa.string(), "handler": pa.string(), "width": pa.int32(), "height": pa.int32(),
    "duration": pa.float64(), "n_samples": pa.int64(), "keyframes": pa.list_(_RANGE), "feature": pa.string(),
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
}
_KINDS = (
    "error string, codec string, handler string, width int, height int, duration double, n_samples long, "
    "keyframes array<struct<first: long, bytes: long>>, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long"
)


def _described(content: bytes | None, tail: int) -> dict:
    try:
        track = read(content or b"")
    except MediaError as error:
        return {"error": str(error)}
    out = {
        "codec": track.codec, "handler": track.handler, "width": track.width, "height": track.height,
        "duration": track.duration / track.timescale if track.timescale else None, "n_samples": len(track.sizes),
        "keyframes": [{"first": a, "bytes": b} for a, b in zip(track.offsets[track.keyframes].tolist(), track.sizes[track.keyframes].tolist(), strict=True)],
        "feature": track.feature(),
    }
    if tail:
        stored = samples(content, track)
        out |= {"payload_bytes": len(stored), "payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": zlib.crc32(stored[-tail:])}
    return out


def describe(media: DataFrame, media_col: str = "media", tail: int = 0) -> DataFrame:
    """The columns of `media` and, after them, what its containers hold.

    error (null if described), codec, handler, width, height, duration in seconds,
    n_samples, keyframes (file offset and bytes of each), feature. Without a list
    of sync samples every sample is a keyframe. With `tail` > 0 the stored bytes are
    also read back: their number, SHA-256, and the CRC-32 of the last `tail`.

    Null, empty, malformed or truncated contents give an error text and nulls.
    Columns of `media` that have one of these names are replaced.
    """
    keep = [c for c in media.columns if c not in _DESCRIBED]
    names = [*keep, *_DESCRIBED]

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, media_col):
                rows = [_described(m, tail) for m in part.column(media_col).to_pylist()]
                arrays = [part.column(c) for c in keep] + [pa.array([r.get(c) for r in rows], t) for c, t in _DESCRIBED.items()]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kept = media.select(*keep)
    return kept.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], _KINDS]))


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    found = describe(store(load(spark, sf_dir, "documents")), tail=32)
    return found.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
