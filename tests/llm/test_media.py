import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from smilegrid.llm import media as M


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 64, 576 * 64 + 1, 576 * 200])
def test_round_trip(size):
    payload = M.padded(bytes(i * 7 % 256 for i in range(size)))
    track = M.read(M.write(payload))
    assert M.samples(M.write(payload), track) == payload
    assert (track.codec, track.width, track.height, len(track.sizes)) == ("raw ", 24, 24, len(payload) // 576)
    assert track.duration / track.timescale == len(payload) / 576 / 25


def container(boxes):
    table = b"".join(boxes)
    media = M._box(b"mdia", M._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 30, 0, 0)), M._full(b"hdlr", bytes(4), b"vide", bytes(13)), M._box(b"minf", M._box(b"stbl", table)))
    return M._box(b"free", b"x") + M._box(b"moov", M._box(b"trak", media))


def tables(sync=True):
    entry = M._box(b"avc1", bytes(24), struct.pack(">HH", 320, 200), bytes(50))
    boxes = [
        M._full(b"stsd", struct.pack(">I", 1), entry),
        M._full(b"stts", struct.pack(">III", 1, 5, 1)),
        M._full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 3, 1)),
        M._full(b"stsz", struct.pack(">II5I", 0, 5, 3, 4, 5, 6, 7)),
        M._full(b"stco", struct.pack(">I2I", 2, 10, 40)),
    ]
    return boxes + [M._full(b"stss", struct.pack(">I2I", 2, 1, 4))] * sync


def test_variable_samples_in_uneven_chunks():
    track = M.read(container(tables()))
    assert (track.codec, track.width, track.height, track.timescale) == ("avc1", 320, 200, 10)
    assert track.offsets.tolist() == [10, 13, 40, 45, 51]
    assert track.keyframes.tolist() == [0, 3]
    assert M.read(container(tables(sync=False))).keyframes.tolist() == [0, 1, 2, 3, 4]


def test_large_sizes_and_boxes_to_the_end():
    whole = M.write(M.padded(b"abc"))
    at = whole.index(b"mdat") - 4
    assert M.samples(whole[:at] + struct.pack(">I", 0) + whole[at + 4 :], M.read(whole)) == M.padded(b"abc")
    assert list(M.walk(memoryview(struct.pack(">I4sQ", 1, b"wide", 20) + b"data"), 0, 20)) == [((b"wide",), 16, 20)]


def test_damaged_containers_are_errors():
    whole = M.write(M.padded(b"abc" * 400))
    for cut in range(0, len(whole), 7):
        with pytest.raises(M.MediaError):
            M.read(whole[:cut])
    for i in range(0, whole.index(b"mdat"), 3):
        try:
            M.read(whole[:i] + b"\xff" + whole[i + 1 :])
        except M.MediaError:
            pass


def test_columns(spark):
    rows = [(1, "abc"), (1, "abc"), (2, None), (3, ""), (None, "é" * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("x")).withColumn("n_bytes", F.lit(1))
    found = M.describe(M.store(frame), tail=32).collect()
    assert len(found) == 5
    for r in found:
        text = next(t or "" for d, t in rows if d == r.doc_id).encode()
        payload = M.padded(text)
        assert (r.error, r.n_bytes, r.payload_bytes) == (None, len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert sum(k.bytes for k in r.keyframes) == len(payload) and r.duration == len(payload) / 576 / 25
        first = r.keyframes[0]
        assert bytes(r.media[first.first : first.first + first.bytes]) == payload[:576]


def test_bad_and_empty_contents(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, b"", "b"), (3, b"junk" * 5, "c")], "id int, media binary, codec string")
    assert all(r.error and r.codec is None and r.keyframes is None for r in M.describe(frame).collect())
    assert M.describe(spark.createDataFrame([], "media binary")).count() == 0
    assert M.store(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: M.padded(r.text.encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in M.op9_media_columns(spark, folder).collect():
        whole = M.write(docs[r.doc_id])
        assert r.payload_sha256 == hashlib.sha256(docs[r.doc_id]).hexdigest() and r.media_bytes == len(whole)
        assert r.media_sha256 == hashlib.sha256(whole).hexdigest() and np.isfinite(r.tail_crc32)
