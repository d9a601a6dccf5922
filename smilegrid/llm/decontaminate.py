"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of consecutive item words. Its shingles are ordered by rarity
in the corpus; a document that contains the window contains all of them, so the
one-shingle prefix, its rarest shingle, is enough to find it. Documents meet
windows only on those prefix shingles. A meeting fixes where the window would
lie, which gives the length and position bounds; then every word is compared.

Documents stay where they are: windows go to them in blocks of bounded size. A
benchmark of more windows than one block takes one pass over the documents each,
with the hits so far carried along as bitmaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALPHANUMERIC, run_hashes, text_bytes, words
from .memory import returning_memory
from .tables import cut, load

#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 3
#: Windows or shingles that are sent to the tasks at once (about 100 bytes each).
BLOCK_WINDOWS = 200_000
CHUNK_BYTES = 8 << 20
_FILTER_BITS = 22


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, bounds = text_bytes(batch.column("text"))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(window, words, items): the distinct windows, their word hashes, and the ids of their items."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            found = words(batch.column("text"), ALPHANUMERIC)
            ids = batch.column("item").to_pylist()
            for item, a, b in zip(ids, found.starts[:-1], found.starts[1:], strict=True):
                length = min(size, int(b - a))
                if length:
                    runs = np.lib.stride_tricks.sliding_window_view(found.hashes[a:b].view(np.int64), length)
                    runs = np.unique(runs, axis=0)
                    arrays = [pa.array([item] * len(runs), pa.string()), pa.array(list(runs), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["item", "words"])

    return items.mapInArrow(run, "item string, words array<long>").groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _may_hold(sorted_hashes: np.ndarray) -> np.ndarray:
    """A bit table that is true for every given hash, to skip nearly all others cheaply."""
    table = np.zeros(1 << _FILTER_BITS, dtype=bool)
    table[(sorted_hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return table


def _matches(hashes: np.ndarray, wanted: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash is wanted, and its place among the sorted wanted ones."""
    at = np.flatnonzero(table[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    place = np.searchsorted(wanted, hashes[at])
    hit = wanted[np.minimum(place, len(wanted) - 1)] == hashes[at]
    return at[hit], place[hit]


def shingle_rarity(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(k, h, df): in how many rows of (text) each shingle of k words occurs. All rows are counted."""
    spark = docs.sparkSession
    result = None
    for block in _blocks(shingles, ["h"]):
        by_size = {k: np.sort(np.fromiter((r["h"] for r in block if r["k"] == k), np.int64).view(np.uint64)) for k in {r["k"] for r in block}}
        sent = spark.sparkContext.broadcast({k: (v, _may_hold(v)) for k, v in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            totals = {k: np.zeros(len(v), np.int64) for k, (v, _) in sent.value.items()}
            for batch in _chunks(batches):
                found = words(batch.column("text"), ALPHANUMERIC)
                doc = np.repeat(np.arange(batch.num_rows), found.counts)
                for k, (wanted, table) in sent.value.items():
                    at, place = _matches(run_hashes(found.hashes, k), wanted, table)
                    inside = doc[at] == doc[at + k - 1]
                    pairs = np.unique(doc[at[inside]] * np.int64(len(wanted)) + place[inside])
                    totals[k] += np.bincount(pairs % len(wanted), minlength=len(wanted))
            for k, (wanted, _) in sent.value.items():
                some = totals[k] > 0
                arrays = [pa.array(np.full(some.sum(), k, np.int32)), pa.array(wanted[some].view(np.int64)), pa.array(totals[k][some])]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "h", "df"])

        counted = docs.select("text").mapInArrow(run, "k int, h long, df long")
        result = counted if result is None else result.unionByName(counted)
    if result is None:
        return spark.createDataFrame([], "k int, h long, df long")
    return result.groupBy("k", "h").agg(F.sum("df").alias("df"))


def _blocks(table: DataFrame, order: list[str]) -> Iterator[list]:
    """Rows of a stored table in blocks of at most BLOCK_WINDOWS, by a hash of some columns."""
    blocks = -(-table.count() // BLOCK_WINDOWS)
    for k in range(blocks):
        rows = table if blocks == 1 else table.where(F.pmod(F.xxhash64(*order), F.lit(blocks)) == k)
        yield rows.collect()


class _Index:
    """A block of windows by prefix shingle."""

    def __init__(self, rows: list):
        self.items = [r["items"] for r in rows]
        self.words = [np.array(r["words"], dtype=np.int64).view(np.uint64) for r in rows]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]] = {}
        grouped: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for no, r in enumerate(rows):
            grouped.setdefault(r["k"], {}).setdefault(r["prefix"], []).append((no, r["offset"]))
        for k, entries in grouped.items():
            keys = np.array(list(entries), dtype=np.int64).view(np.uint64)
            order = np.argsort(keys)
            values = list(entries.values())
            self.by_size[k] = (keys[order], _may_hold(keys[order]), [values[i] for i in order])

    def occurrences(self, hashes: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Words that occurring windows cover, and (row, window) of each occurrence."""
        cover = np.zeros(len(hashes) + 1, dtype=np.int64)
        pairs: list[tuple[int, int]] = []
        for k, (keys, table, entries) in self.by_size.items():
            at, place = _matches(run_hashes(hashes, k), keys, table)
            if not len(at):
                continue
            # All meetings of a position with the windows of its prefix shingle.
            counts = np.array([len(e) for e in entries])
            flat = np.array([x for e in entries for x in e], dtype=np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            which = np.repeat(np.arange(len(at)), counts[place])
            entry = np.arange(len(which)) - np.repeat(np.cumsum(counts[place]) - counts[place], counts[place]) + first[place][which]
            window, begin = flat[entry, 0], at[which] - flat[entry, 1]
            lengths = np.array([len(w) for w in self.words])[window]
            row = doc[at[which]]
            fits = (begin >= starts[row]) & (begin + lengths <= starts[row + 1])
            window, begin, lengths, row = window[fits], begin[fits], lengths[fits], row[fits]
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                there = hashes[begin[own][:, None] + np.arange(length)]
                need = np.stack([self.words[w] for w in window[own]])
                same = own[(there == need).all(axis=1)]
                np.add.at(cover, begin[same], 1)
                np.add.at(cover, begin[same] + length, -1)
                pairs += set(zip(row[same].tolist(), window[same].tolist(), strict=True))
        return np.cumsum(cover[:-1]) > 0, pairs


def _mark(docs: DataFrame, rows: list, last: bool) -> DataFrame:
    """Add a block's hits to (doc_id, text, n_words, hits, items); drops the text after the last block."""
    sent = docs.sparkSession.sparkContext.broadcast(_Index(rows))
    columns = ["doc_id", *([] if last else ["text"]), "n_words", "hits", "items"]

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in _chunks(batches):
            found = words(batch.column("text"), ALPHANUMERIC)
            starts = found.starts
            covered, pairs = index.occurrences(found.hashes, starts, np.repeat(np.arange(batch.num_rows), found.counts))
            new: dict[int, set] = {}
            for row, window in pairs:
                new.setdefault(row, set()).update(index.items[window])
            hits, names = [], []
            for row, (before, known) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                if row in new:
                    bits = covered[starts[row] : starts[row + 1]]
                    if before:
                        bits = bits | np.unpackbits(np.frombuffer(before, np.uint8), count=len(bits)).astype(bool)
                    before, known = np.packbits(bits).tobytes(), sorted(new[row].union(known or ()))
                hits.append(before)
                names.append(known or [])
            arrays = {"n_words": pa.array(found.counts, pa.int64()), "hits": pa.array(hits, pa.binary()), "items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([arrays.get(c, batch.column(c) if c in batch.schema.names else None) for c in columns], columns)

    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "text": "string", "n_words": "long", "hits": "binary", "items": "array<string>"}
    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = 10,
) -> DataFrame:
    """(doc_id, n_words, hits, items) for every row of `docs`.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z
    folded. `hits` is a bitmap over the document's words (first word in the highest
    bit; null if none) of those inside any occurrence of a window of `size`
    consecutive item words; an item of fewer words is one window. `items` are the
    sorted ids, as strings, of the items with occurring windows.

    Null and empty texts have no words and hit nothing, on either side. Rows with
    equal or null ids are separate rows; a null item id is listed as "null" and
    rows of one item id are one item. Empty tables give no hits or no rows. Other
    columns are not read.
    """
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = cut(item_windows(named, size), "windows")
    placed = cut(_shingled(windows), "shingles")
    rarity = cut(shingle_rarity(rows, cut(placed.select("k", "h").distinct(), "wanted")), "rarity")
    # A window with a shingle that no document has occurs nowhere.
    prefixes = (
        placed.join(rarity, ["k", "h"], "left")
        .groupBy("words", "k")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("rarest"))
        .where("rarest.df > 0")
    )
    chosen = cut(prefixes.join(windows, "words").select("words", "items", "k", F.col("rarest.h").alias("prefix"), F.col("rarest.offset").alias("offset")), "prefixes")
    marked = rows.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"))
    blocks = -(-chosen.count() // BLOCK_WINDOWS)
    if blocks == 0:
        return _mark(marked, [], True)
    for no, block in enumerate(_blocks(chosen, ["words"]), 1):
        marked = _mark(marked, block, no == blocks)
        if no < blocks:
            marked = cut(marked, "marked")
    return marked


def _shingled(windows: DataFrame) -> DataFrame:
    """(words, k, h, offset): the shingles of every window."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for w in batch.column("words").to_pylist():
                k = min(SHINGLE, len(w))
                out += [(w, k, h, i) for i, h in enumerate(run_hashes(np.array(w, np.int64).view(np.uint64), k).view(np.int64).tolist())]
            kinds = (pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["words", "k", "h", "offset"])

    return windows.select("words").mapInArrow(run, "words array<long>, k int, h long, offset int")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce(hit_count(F.col("hits")), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def hit_count(bitmap):
    """Ones of a bitmap."""
    digits = F.hex(bitmap)
    ones = F.lit(0)
    for digit in "123456789ABCDEF":
        ones = ones + bin(int(digit, 16)).count("1") * (F.length(digits) - F.length(F.replace(digits, F.lit(digit), F.lit(""))))
    return ones
