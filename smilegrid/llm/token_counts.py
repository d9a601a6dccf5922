"""Token counts of whole texts, huge ones included, as a tokenizer library gives them.

A huge text is cut into overlapping chunks that are encoded apart, with
offsets. Two neighbouring encodings are spliced at a boundary that is proven
stable, and a text without one in some overlap is cut anew with wider overlaps.

Why a splice is exact: a byte-level tokenizer first splits a text from left to
right by a pattern that looks at no earlier text and one character ahead, and
merges bytes only inside such pieces. In the left chunk every piece that ends
before the chunk does is therefore a piece of the whole text, unless a special
string straddles the chunk's end, so boundaries within a special string's length
of the end are not used. If the right chunk starts a piece at such a boundary
too, both continue alike from there. Tokens left of it are counted in the left
chunk, the others in the right one.

By the same argument a single space or line feed between two other characters
starts a piece, so texts that are not cut are counted word by word, and a task
encodes a frequent word only once.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections import Counter as Count
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import returning_memory
from .tables import broadcast_below, cut, load

#: Characters of a text from which on it is cut, and of one step from chunk to chunk.
STEP = 32_768
#: First overlap in characters; grows fourfold where no stable boundary lies in it.
OVERLAP = 256
#: Bytes of the words that a worker remembers, characters of the longest of them, bytes of text that
#: it counts at a time, and characters whose encodings it holds at a time.
MEMO_BYTES, MEMO_WORD = 12 << 20, 64
GROUP_BYTES = 1 << 19
ENCODED_CHARS = 30_000

_ODD_SPACE = re.compile(r"\s\s|^\s|\s$")
_GAP = re.compile(r"(?<=\S)([ \n])(?=\S)")


class Counter:
    """Token counts and piece boundaries of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        #: The proof above holds for this kind of vocabulary only; others encode whole texts.
        self.stable = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not spec.get("normalizer")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added)
        )
        self.margin = 1 + max((len(a["content"]) for a in added), default=0)
        if self.stable:  # offsets then cover the spaces that belong to a token; ids are unchanged
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        #: Counts of words with a space before them, and of words with none.
        self._spaced: dict[str, int] = {}
        self._bare: dict[str, int] = {}
        self._held = 0
        self._line_feed = len(self.tokenizer.encode("\n", add_special_tokens=False)) if self.stable else 0

    def _learn(self, known: dict[str, int], words: list[str], between: str, lead: int) -> None:
        """Remember the counts of words that follow `between`, which has `lead` tokens of its own."""
        start = 0
        while start < len(words):
            end, size = start, 0
            while end < len(words) and size < ENCODED_CHARS:
                size += len(words[end]) + 1
                end += 1
            group = words[start:end]
            found = self.tokenizer.encode(between + between.join(group), add_special_tokens=False)
            starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in group])])
            places = np.fromiter((x for x, _ in found.offsets), np.int64, len(found))
            counts = np.bincount(np.searchsorted(starts, places, "right") - 1, minlength=len(group)) - lead
            known.update(zip(group, counts.tolist(), strict=True))
            self._held += sum(map(sys.getsizeof, group)) + 100 * len(group)
            start = end

    def _lengths(self, texts: list[str]) -> Iterator[int]:
        """Numbers of tokens of the texts, with the encodings of some of them held at a time."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size < ENCODED_CHARS):
                size += len(texts[end])
                end += 1
            yield from [len(x) for x in self.tokenizer.encode_batch_fast(texts[start:end], add_special_tokens=False)]
            start = end

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Words met twice in a call are remembered; the others are encoded text by text."""
        if not self.stable:
            return list(self._lengths(texts))
        if self._held > MEMO_BYTES:
            self._spaced.clear()
            self._bare.clear()
            self._held = 0
        split = [self._words(t) for t in texts]
        total = [feeds * self._line_feed for _, _, feeds, _ in split]
        rest = [list(outer) for _, _, _, outer in split]
        for known, column, between, lead in ((self._spaced, 0, " ", 0), (self._bare, 1, "\n", self._line_feed)):
            new = Count(w for s in split for w in s[column] if len(w) <= MEMO_WORD and w not in known)
            self._learn(known, [w for w, n in new.items() if n > 1], between, lead)
            for i, s in enumerate(split):
                once = [w for w in s[column] if w not in known]
                total[i] += sum(map(known.get, s[column], repeat(0)))
                if once:
                    rest[i].append(between + between.join(once))
                    total[i] -= lead * len(once)
        sizes = self._lengths([x for r in rest for x in r])
        return [n + sum(next(sizes) for _ in r) for n, r in zip(total, rest, strict=True)]

    @staticmethod
    def _words(text: str) -> tuple[list[str], list[str], int, list[str]]:
        """Words after a space, words after a line feed or at the start, line feeds between
        words, and what is counted as it stands because white space surrounds it."""
        if not text:
            return [], [], 0, []
        if not _ODD_SPACE.search(text):
            lines = [line.split(" ") for line in text.split("\n")]
            return [w for line in lines for w in line[1:]], [line[0] for line in lines], len(lines) - 1, []
        parts = _GAP.split(text)
        spaced, bare, outer, feeds = [], [], [], 0
        for i in range(0, len(parts), 2):
            gap, word = parts[i - 1] if i else "", parts[i]
            feeds += gap == "\n"
            if not i or i == len(parts) - 1:
                outer.append(" " + word if gap == " " else word)
            else:
                (spaced if gap == " " else bare).append(word)
        return spaced, bare, feeds, outer

    def pieces(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of tokens, and for every piece its first character and first token."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in found.word_ids], dtype=np.int64)
        opens = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]) & (words >= 0)) if len(words) else words
        places = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
        return len(found), places[opens], opens


def counter(path: str) -> Counter:
    """The worker's counter of a vocabulary file, kept from task to task.

    Kernels travel by value, so this module's globals are new in each task: a counter kept
    there would travel with them and be left behind, vocabulary and words, by every task.
    The library's module is the worker's own.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_smilegrid_counters", {})
    if path not in kept:
        kept[path] = Counter(path)
    return kept[path]


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > GROUP_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _count_whole(texts: DataFrame, path: str) -> DataFrame:
    """Counts of texts that are encoded in one piece each."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for a, b in _grouped(sizes):
                counts = counter(path).counts([t or "" for t in column.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(a, b - a), pa.array(counts, pa.int64())], ["row", "n_tokens"]
                )

    return texts.mapInArrow(run, f"row {texts.schema['row'].dataType.simpleString()}, n_tokens long")


def _chunked(texts: DataFrame, step: int, overlap: int) -> DataFrame:
    """(row, seam, last, start, piece): chunk `seam` begins at the text's seam of that number."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                starts = range(0, max(1, len(text) - overlap), step)
                for k, start in enumerate(starts):
                    last = k == len(starts) - 1
                    piece = text[start:] if last else text[start : start + step + overlap]
                    rest = [pa.array([k], pa.int64()), pa.array([last]), pa.array([start], pa.int64()), pa.array([piece], pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), *rest], ["row", "seam", "last", "start", "piece"])

    kind = texts.schema["row"].dataType.simpleString()
    return texts.mapInArrow(run, f"row {kind}, seam long, last boolean, start long, piece string")


def _encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """Per chunk its number of tokens, and at its two seams each usable boundary with the
    tokens that a splice there would leave out of this chunk."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).drop_columns(["row"]).to_pylist()[0]
                use = counter(path)
                total, places, before = use.pieces(r["piece"])
                size = len(r["piece"])
                out = [(r["seam"], "all", -1, total)]
                if r["seam"] > 0:
                    at = (places > 0) & (places < overlap)
                    out += [(r["seam"], "right", r["start"] + p, n) for p, n in zip(places[at].tolist(), before[at].tolist(), strict=True)]
                if not r["last"]:
                    at = (places >= size - overlap) & (places <= size - use.margin)
                    out += [(r["seam"] + 1, "left", r["start"] + p, total - n) for p, n in zip(places[at].tolist(), before[at].tolist(), strict=True)]
                seam, side, place, tokens = zip(*out, strict=True)
                same = rows.take(pa.array([i] * len(out)))
                rest = [pa.array(seam, pa.int64()), pa.array(side, pa.string()), pa.array(place, pa.int64()), pa.array(tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays([same, *rest], ["row", "seam", "side", "place", "tokens"])

    kind = chunks.schema["row"].dataType.simpleString()
    return chunks.mapInArrow(run, f"row {kind}, seam long, side string, place long, tokens long")


def _count_huge(texts: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """Counts of huge texts: chunks are dealt out evenly, seams joined by position and summed.

    `texts` is a stored table. Each round handles the texts that still have a seam
    without a common boundary; the overlap grows until it holds the whole text.
    """
    done = None
    while True:
        chunks = _chunked(texts, step, overlap).repartition("row", "seam")
        found = cut(_encoded(chunks, path, overlap), "seams")
        splices = (
            found.where("side <> 'all'")
            .groupBy("row", "seam", "place")
            .agg(F.count(F.lit(1)).alias("sides"), F.sum("tokens").alias("tokens"))
            .where("sides = 2")
            .groupBy("row", "seam")
            .agg(F.min_by("tokens", "place").alias("tokens"))
        )
        whole = found.where("side = 'all'").select("row", "seam", "tokens", F.lit(1).alias("chunks"), F.lit(0).alias("seams"))
        summed = (
            whole.unionByName(splices.select("row", "seam", (-F.col("tokens")).alias("tokens"), F.lit(0).alias("chunks"), F.lit(1).alias("seams")))
            .groupBy("row")
            .agg(F.sum("tokens").alias("n_tokens"), (F.sum("chunks") == F.sum("seams") + 1).alias("spliced"))
        )
        summed = cut(summed, "spliced")
        ready = summed.where("spliced").select("row", "n_tokens")
        done = ready if done is None else done.unionByName(ready)
        open_rows = summed.where("not spliced").select("row")
        if open_rows.isEmpty():
            return done
        texts = texts.join(broadcast_below(open_rows), "row", "left_semi")
        overlap *= 4
        step = max(step, overlap)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", step: int = STEP, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of `docs`.

    `path` is a vocabulary file of the tokenizers library that every executor
    finds at that place. Texts of more than `step` + `overlap` characters are cut.
    Special strings inside a text are treated as the library does by default;
    none are added. Null and empty texts have 0 bytes and 0 tokens; rows with
    equal or null ids are separate rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    info = F.struct(F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    huge = F.coalesce(F.length("text") > step + overlap, F.lit(False))
    if not counter(path).stable:
        huge = F.lit(False)
    short = _count_whole(rows.where(~huge).select(info.alias("row"), "text"), path)
    stored = cut(
        rows.where(huge).select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("no")).alias("row"), "text"),
        "huge",
    )
    fields = ["row.doc_id", "row.n_bytes", "n_tokens"]
    return short.select(*fields).unionByName(_count_huge(stored, path, step, overlap).select(*fields))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(load(spark, sf_dir, "documents"), path).withColumn("over_limit", F.col("n_tokens") > 512)
