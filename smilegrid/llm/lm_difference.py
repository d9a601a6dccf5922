"""Language-model scoring by cross-entropy difference.

Two bigram models are fitted: one on the target documents, one on all documents.
They are matched: the same words, order and smoothing, with one vocabulary (every
word of the corpus) and pseudo-counts in proportion to their sizes. A document's
score is the mean per-token loss under the background model minus that under the
target model. Its own counts are left out of both, so a document does not vouch
for itself.

A loss is a sum of terms that depend on one bigram or one history word each:
-log(c(h, w) + a) + log(c(h) + a V). Documents are stored in chunks of a few megabytes.
A chunk sends each of its distinct bigrams and words once, with its own counts,
to fragments by hash; a fragment adds up what it gets and returns the counts of the whole corpus
to the chunk, in the order in which it sent them; the chunk adds up its documents' terms. So
no model is gathered anywhere, what is sent and returned is in proportion to the keys
of the chunks, and a word or bigram of every document costs one entry per chunk.

A task holds one chunk at a time, or the entries of one fragment, whatever the size of the
corpus and of the files it comes in: chunks are stored in row groups of their own, a fragment is added up
in slices of its keys, and texts are shuffled with nothing but the counts of their chunk. Which
documents are targets is known by a mark per document, kept apart from the texts.

Words are runs of non-space characters with A-Z folded, known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smilegrid.plans.lineage import passing_shuffles

from .bytewords import SPACED, mix, text_bytes, words
from .memory import returning_memory
from .tables import broadcast_below, cut, load

#: Pseudo-count of every bigram in the background model.
PSEUDO = 0.05
#: Tokens of the corpus per fragment; a fragment gets at most two entries for each.
FRAGMENT = 4_000_000
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 60_000
#: Entries of a fragment that are sorted at once, and bytes of counts that are returned at once.
SLICE, RETURNED = 1 << 20, 4 << 20
#: Documents of the corpus whose marks, a byte each, are sent to every executor; beyond, they are joined by chunk.
MARKED = 32_000_000
#: Of stored chunks: a row group each. Left alone, the writer holds a hundred before it looks at their size, and a reader all of a group.
_GROUPS = {"parquet.block.row.count.limit": 1}
_START = np.uint64(0x5BD1E9955BD1E995)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Chunk:
    """The words and bigrams of some documents, a start word before each document."""

    def __init__(self, texts: pa.Array, target: np.ndarray):
        found = words(texts, SPACED)
        self.n = found.counts
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.words = found.hashes
        self.before = np.concatenate([[_START], self.words[:-1]]) if len(self.words) else self.words
        opens = found.starts[:-1][self.n > 0]
        self.before[opens] = _START
        self.bigrams = mix(self.before * _STEP + self.words)
        self.target = target


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, bounds = text_bytes(batch.column("text"))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + CHUNK_BYTES, "right")) - 1
            end = min(max(start + 1, end), start + CHUNK_ROWS)
            yield batch.slice(start, end - start)
            start = end


def _cuts(sorted_keys: np.ndarray, fragments: int) -> np.ndarray:
    return np.searchsorted((sorted_keys >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32), np.arange(fragments + 1))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of counts, each as its width, its length and its values in the narrowest type that holds them."""
    out = []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
        out.append(np.array([kind.itemsize, len(x)], np.uint64).tobytes() + x.astype(kind).tobytes())
    return b"".join(out)


def _unpack(payload: pa.Buffer) -> list[np.ndarray]:
    out, at = [], 0
    while at < payload.size:
        width, size = (int(x) for x in np.frombuffer(payload, np.uint64, 2, at))
        out.append(np.frombuffer(payload, f"u{width}", size, at + 16))
        at += 16 + width * size
    return out


class _Keys:
    """The distinct keys of one kind in a chunk, sorted, with the chunk's own counts."""

    def __init__(self, key: np.ndarray, chunk: _Chunk, counted: np.ndarray | None = None):
        self.distinct, self.place = np.unique(key, return_inverse=True)
        counted = np.ones(len(key), bool) if counted is None else counted
        self.n = np.bincount(self.place[counted], minlength=len(self.distinct))
        self.n_target = np.bincount(self.place[counted & chunk.target[chunk.doc]], minlength=len(self.distinct))


def _kinds(chunk: _Chunk) -> tuple[_Keys, _Keys]:
    """Bigrams and words. A word counts as a history wherever another one follows it in its document."""
    follows = np.append(chunk.before[1:] != _START, False)[: len(chunk.words)]
    return _Keys(chunk.bigrams, chunk), _Keys(chunk.words, chunk, follows)


def _chunk_of(rows: pa.RecordBatch, i: int = 0) -> _Chunk:
    """Of a row with texts and marks; the texts are not copied."""
    return _Chunk(rows.column("texts").slice(i, 1).flatten(), np.frombuffer(rows.column("marks")[i].as_buffer(), np.uint8) == ord("1"))


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, ids, targets, texts, counts): stored chunks of some documents each, with their numbers of tokens."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in _chunks(batches):
            counts = pa.array(words(part.column("text"), SPACED).counts, pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), x) for x in (*[part.column(c) for c in ("doc_id", "target", "text")], counts)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["chunk", "ids", "targets", "texts", "counts"])
            number += 1

    return cut(docs.mapInArrow(run, "chunk long, ids array<long>, targets array<boolean>, texts array<string>, counts array<long>"), "chunks", **_GROUPS)


def marked(chunks: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(chunk, marks, documents, tokens, opened, in_target, opened_in_target): a 1 for every target document
    of a chunk and a 0 for every other one, in their order, and the chunk's numbers of documents, of tokens and
    of documents that have any. With `targets`, one column of distinct ids, their documents are the targets."""
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "targets", "counts"))).select("chunk", "pos", "col.*")
    of = F.coalesce("targets", F.lit(False))
    if targets is not None:
        (wanted,) = targets.columns
        each, of = each.join(targets, each["ids"] == targets[wanted], "left"), targets[wanted].isNotNull()
    each = each.select("chunk", "pos", F.col("counts").alias("n"), of.alias("target"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "target")))
    marks = F.array_join(F.transform(in_order, lambda x: F.when(x["target"], "1").otherwise("0")), "")
    sizes = {"documents": F.count("pos"), "tokens": F.sum("n"), "opened": F.count_if(F.col("n") > 0)}
    sizes |= {"in_target": F.sum(F.when(F.col("target"), F.col("n")).otherwise(0)), "opened_in_target": F.count_if((F.col("n") > 0) & F.col("target"))}
    return cut(each.groupBy("chunk").agg(marks.alias("marks"), *[x.alias(c) for c, x in sizes.items()]), "marks")


def _added(sent: list[list[np.ndarray]], kind: int) -> tuple[list[list[list[np.ndarray]]], int]:
    """Per chunk the pieces of its keys' counts and target counts over all chunks, and the number of distinct
    keys. Keys come sorted, so a slice of all keys is a piece of every chunk."""
    keys = [a[kind] for a in sent]
    some = [k for k in keys if len(k)]
    if not some:
        return [[[], []] for _ in sent], 0
    low, high = min(int(k[0]) for k in some), max(int(k[-1]) for k in some)
    slices = -(-sum(map(len, some)) // SLICE)
    inner = np.array([low + (high - low) * i // slices for i in range(1, slices)], np.uint64)
    ends = [[0, *np.searchsorted(k, inner).tolist(), len(k)] for k in keys]
    out, distinct_keys = [[[], []] for _ in sent], 0
    for at in range(slices):
        distinct, place = np.unique(np.concatenate([k[e[at] : e[at + 1]] for k, e in zip(keys, ends)]), return_inverse=True)
        distinct_keys += len(distinct)
        edges = np.cumsum([0, *(e[at + 1] - e[at] for e in ends)]).tolist()
        for j in (0, 1):
            own = np.concatenate([a[kind + 1 + j][e[at] : e[at + 1]] for a, e in zip(sent, ends)])
            sums = np.bincount(place, own, minlength=len(distinct)).astype(np.int64)
            sums = sums.astype(np.min_scalar_type(int(sums.max())) if len(sums) else np.uint8)[place]
            for i in range(len(sent)):
                out[i][j].append(sums[edges[i] : edges[i + 1]])
    return out, distinct_keys


def corpus_counts(chunks: DataFrame, fragments: int) -> DataFrame:
    """(chunk, part, payload, vocabulary): for every chunk and fragment the corpus's counts of the chunk's keys there.

    `chunks` has texts and marks. The payload packs counts and target counts of the bigrams, then of the words, in the
    order of the chunk's sorted keys. Each fragment has one row more, with a null chunk and its number of words.
    """

    @returning_memory
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pairs, words_ = _kinds(_chunk_of(batch, row))
                edges = [_cuts(k.distinct, fragments) for k in (pairs, words_)]
                parts, payloads = [], []
                for part in range(fragments):
                    of = [(k, slice(e[part], e[part + 1])) for k, e in zip((pairs, words_), edges)]
                    if any(at.stop > at.start for _, at in of):
                        parts.append(part)
                        payloads.append(_pack(*[x[at] for k, at in of for x in (k.distinct, k.n, k.n_target)]))
                numbers = pa.array([batch.column("chunk")[row].as_py()] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], ["chunk", "part", "payload"])

    def returned(chunk: list[int | None], part: int, payload: list[bytes | None], vocabulary: list[int | None]) -> pa.RecordBatch:
        columns = ((chunk, pa.int64()), ([part] * len(chunk), pa.int32()), (payload, pa.binary()), (vocabulary, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], ["chunk", "part", "payload", "vocabulary"])

    @returning_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, tuple[list[int], list[list[np.ndarray]]]] = {}
        for batch in batches:
            payloads = batch.column("payload")
            for i, (chunk, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "part")))):
                numbers, sent = groups.setdefault(part, ([], []))
                numbers.append(chunk)
                sent.append(_unpack(payloads[i].as_buffer()))
        for part in list(groups):
            numbers, sent = groups.pop(part)
            (pairs, _), (words_, vocabulary) = (_added(sent, kind) for kind in (0, 3))
            del sent
            ready, size = ([], []), 0
            for i, chunk in enumerate(numbers):
                payload = _pack(*[np.concatenate(x) if x else np.empty(0, np.uint8) for x in (*pairs[i], *words_[i])])
                ready[0].append(chunk), ready[1].append(payload)
                size += len(payload)
                if size >= RETURNED:
                    yield returned(ready[0], part, ready[1], [None] * len(ready[0]))
                    ready, size = ([], []), 0
            yield returned([*ready[0], None], part, [*ready[1], None], [*[None] * len(ready[0]), vocabulary])

    sent = chunks.select("chunk", "texts", "marks").mapInArrow(send, "chunk long, part int, payload binary")
    added = sent.repartitionById(fragments, F.col("part")).mapInArrow(count, "chunk long, part int, payload binary, vocabulary long")
    with passing_shuffles(chunks.sparkSession):
        return cut(added, "counts")


def _terms(n, all_n, all_target, own_target, pseudo: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """n times the log of the smoothed count without the document's own, in the background and the target model."""
    return n * np.log(all_n - n + pseudo[0]), n * np.log(all_target - n * own_target + pseudo[1])


def _postings(place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (place of the key, document) with the number of occurrences."""
    order = np.lexsort((doc, place))
    place, doc = place[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])) if len(place) else np.empty(0, np.int64)
    return place[first], doc[first], np.diff(np.append(first, len(place)))


def cross_entropy_difference(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "target", targets: DataFrame | None = None
) -> DataFrame:
    """(doc_id, n_tokens, loss_background, loss_target, score) for every row of `docs`.

    `target_col` is true for the documents that the target model is fitted on; null
    is false. With `targets`, one column of distinct ids, it is not read: the target
    documents are those with such an id. Losses are nats per token; `score` is their difference,
    higher for documents nearer to the target.

    Null and empty texts have no tokens, null losses and score 0. Without target
    documents both models are the background one with nothing counted in the target.
    A very long text is a chunk of its own. Rows with equal or null ids are separate rows;
    an empty table gives no rows. Other columns are not read.
    """
    target = F.col(target_col).cast("boolean") if targets is None else F.lit(None).cast("boolean")
    texts = chunked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), target.alias("target")))
    marks = marked(texts, targets)
    sizes = marks.agg(*[F.sum(c) for c in ("documents", "tokens", "opened", "in_target", "opened_in_target")]).first()
    documents, total, opened, of_target, opened_in_target = (int(x or 0) for x in sizes)
    known_by = marks.select("chunk", "marks")
    chunks = texts.join(F.broadcast(known_by) if documents <= MARKED else known_by, "chunk")
    fragments = max(16, -(-total // FRAGMENT))
    counts = corpus_counts(chunks, fragments)
    vocabulary = 1 + int(counts.where("chunk is null").agg(F.sum("vocabulary")).first()[0] or 0)
    a = (PSEUDO, PSEUDO * (of_target / total if of_target else 1.0))
    pseudo = (a, (a[0] * vocabulary, a[1] * vocabulary))  # of bigrams and of histories

    def score(group: pa.Table) -> pa.Table:
        """Of the row of a chunk and the rows of its counts, which may come in any order."""
        parts = group.column("part").to_numpy()
        (row,) = group.filter(pc.equal(group.column("part"), -1)).combine_chunks().to_batches()
        chunk = _chunk_of(row)
        pairs, words_ = _kinds(chunk)
        size = len(chunk.n)
        payloads = group.column("payload")
        parts = [_unpack(payloads[int(i)].as_buffer()) for i in np.argsort(parts)[1:]]
        known = [np.concatenate([p[j] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64) for j in range(4)]
        # The start word's counts are the numbers of documents with words; other histories are words.
        history = np.where(chunk.before == _START, len(words_.distinct), np.roll(words_.place, 1))
        known[2], known[3] = np.append(known[2], opened), np.append(known[3], opened_in_target)
        losses = np.zeros((2, size))
        for kind, places, sign in ((0, pairs.place, -1.0), (1, history, 1.0)):
            place, doc, n = _postings(places, chunk.doc)
            for model, term in enumerate(_terms(n, known[2 * kind][place], known[2 * kind + 1][place], chunk.target[doc], pseudo[kind])):
                losses[model] += sign * np.bincount(doc, term, minlength=size)
        ids = row.column("ids").flatten()
        return pa.table([ids, pa.array(chunk.n, pa.int64()), *[pa.array(x, pa.float64()) for x in losses]], ["doc_id", "n", "background", "target"])

    meeting = chunks.select("chunk", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("payload"), "ids", "texts", "marks").unionByName(
        counts.where("chunk is not null").select("chunk", "part", "payload"), allowMissingColumns=True
    )
    summed = meeting.groupBy("chunk").applyInArrow(score, "doc_id long, n long, background double, target double")
    loss = {m: F.when(F.col("n") > 0, F.col(m) / F.col("n")) for m in ("background", "target")}
    return summed.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        loss["background"].alias("loss_background"),
        loss["target"].alias("loss_target"),
        F.coalesce(loss["background"] - loss["target"], F.lit(0.0)).alias("score"),
    )


def op7_lm_difference(spark, sf_dir: str) -> DataFrame:
    """The target model is fitted on the documents labelled as good, the background model on all."""
    good = load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("_good")).distinct()
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = cross_entropy_difference(docs, targets=broadcast_below(cut(good, "good")))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_background", "loss_target", "score")])
