"""Quality scores by nearest-neighbour voting in a latent space.

Texts become count profiles: trigrams of character classes, hashed byte trigrams
and how much their words repeat. A truncated singular value decomposition of the
labelled sample's profiles gives the latent space. The sample's latent vectors,
whose number is bounded, go to every task, which multiplies them with its
documents' vectors block by block (exact cosines with every one) and weights the
nearest labels by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .bytewords import SPACED, text_bytes, words
from .memory import returning_memory
from .tables import load

#: Most labelled rows that a model is fitted on; beyond it those of the smallest id hashes are taken.
MAX_LABELLED = 5_000
DIMENSIONS = 32
NEIGHBOURS = 15
#: Similarities vote with this power.
SHARPNESS = 4
#: Trigrams of the average profile that every text is taken to hold beside its own.
SMOOTHING = 100.0
KEEP_FROM = 0.7

_CLASSES, _HASHED = 10, 256
CHUNK_BYTES, BLOCK_ROWS = 2 << 20, 256


def _character_classes() -> np.ndarray:
    kinds = np.full(256, 9, dtype=np.uint32)
    for kind, characters in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,", b"!?", b"#$%&*|")):
        kinds[list(characters)] = kind
    kinds[128:] = 8
    return kinds


_KINDS = _character_classes()
WIDTH = _CLASSES**3 + _HASHED + 3


def profiles(column: pa.Array) -> np.ndarray:
    """Counts per text: class trigrams, hashed byte trigrams, words, repeated neighbours, distinct words."""
    n = len(column)
    data, bounds = text_bytes(column)
    doc = np.repeat(np.arange(n, dtype=np.uint32), np.diff(bounds))
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if len(data) >= 3:
        whole = doc[:-2] == doc[2:]
        owner = doc[:-2][whole]
        kinds = _KINDS[data]
        code = (kinds[:-2] * np.uint32(_CLASSES**2) + kinds[1:-1] * np.uint32(_CLASSES) + kinds[2:])[whole]
        out[:, : _CLASSES**3] = np.bincount(owner * np.uint32(_CLASSES**3) + code, minlength=n * _CLASSES**3).reshape(n, -1)
        wide = data.astype(np.uint32)
        code = ((wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))) * np.uint32(2654435761) >> np.uint32(24))[whole]
        out[:, _CLASSES**3 : -3] = np.bincount(owner * np.uint32(_HASHED) + code, minlength=n * _HASHED).reshape(n, -1)
    found = words(column, SPACED)
    owner = np.repeat(np.arange(n, dtype=np.uint64), found.counts)
    again = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.unique(owner << np.uint64(44) | found.hashes >> np.uint64(20)) >> np.uint64(44)
    out[:, -3] = found.counts
    out[:, -2] = np.bincount(owner[1:][again].astype(np.int64), minlength=n)
    out[:, -1] = np.bincount(distinct.astype(np.int64), minlength=n)
    return out


@dataclass
class Model:
    """A fitted latent space, the labelled vectors in it and their labels."""

    average: np.ndarray
    centre: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def features(self, counts: np.ndarray) -> np.ndarray:
        out = np.empty(counts.shape, np.float32)
        for part, weight in ((slice(0, _CLASSES**3), 1.0), (slice(_CLASSES**3, WIDTH - 3), 0.5)):
            own = np.add(counts[:, part], np.float32(SMOOTHING) * self.average[part], out=out[:, part])
            own /= counts[:, part].sum(axis=1, keepdims=True) + np.float32(SMOOTHING)
            np.sqrt(own, out=own)
            own *= np.float32(weight)
        n, again, distinct = counts[:, -3], counts[:, -2], counts[:, -1]
        out[:, -3:] = np.stack([np.sqrt((again + 0.1) / (n + 10)), np.sqrt((distinct + 5) / (n + 5)), np.log1p(n) / 20], axis=1)
        return out

    def project(self, counts: np.ndarray) -> np.ndarray:
        latent = (self.features(counts) - self.centre) @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors; the overall share where none is near."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(counts), BLOCK_ROWS):
            near = self.project(counts[start : start + BLOCK_ROWS]) @ self.vectors.T
            best = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS
            votes = (weight * self.labels[best]).sum(axis=1)
            out[start : start + BLOCK_ROWS] = (votes + 1e-3 * self.prior) / (weight.sum(axis=1) + 1e-3)
        return np.round(np.clip(out, 0.0, 1.0), 6)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, bounds = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + CHUNK_BYTES, "right")) - 1)
            end = min(end, start + 4 * BLOCK_ROWS)
            yield batch.slice(start, end - start)
            start = end


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED
) -> Model:
    """Fit on at most `most` labelled texts outside the held-out ones, chosen by a hash of their id.

    Rows with a null id, a null label or no text row are not learned from; a null or
    empty text is learned from as an empty one.
    """
    learned = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
    learned = learned.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(learned), "doc_id").select("text", "label")

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, "text"):
            counts = profiles(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in counts], pa.binary()), part.column("label")], ["counts", "label"])

    # Rows of one id may repeat, so the bound holds for what arrives here too.
    counts, known = np.empty((most, WIDTH), np.float32), []
    for row in sample.mapInArrow(run, "counts binary, label double").limit(most).toLocalIterator():
        counts[len(known)] = np.frombuffer(row["counts"], np.float32)
        known.append(row["label"])
    order = np.lexsort(counts[: len(known)].T[-3:]) if known else np.empty(0, np.int64)
    return fit_counts(counts[order], np.array(known, dtype=float)[order])


def fit_counts(counts: np.ndarray, labels: np.ndarray) -> Model:
    def share(part: np.ndarray) -> np.ndarray:
        return (part.sum(axis=0, dtype=np.float64) / max(1.0, float(part.sum(dtype=np.float64)))).astype(np.float32)

    split = _CLASSES**3
    average = np.concatenate([share(counts[:, :split]), share(counts[:, split:-3]), np.zeros(3, np.float32)])
    model = Model(average, np.zeros(WIDTH, np.float32), np.zeros((WIDTH, DIMENSIONS), np.float32), np.empty((0, DIMENSIONS), np.float32), np.empty(0))
    if not len(labels):
        return model
    features = model.features(counts)
    model.centre = features.mean(axis=0)
    features -= model.centre
    _, vectors = np.linalg.eigh((features.T @ features).astype(np.float64))
    model.basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    model.vectors = model.project(counts)
    model.labels = labels
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of `docs` with `score` (0 to 1, higher: label 1 likelier) after them.

    Every whole text is scored, null and empty ones as texts without any trigram;
    without labelled rows every score is 0.5. Equal texts have equal scores. A
    column named score is replaced.
    """
    kept = docs.drop("score")
    schema = StructType([*kept.schema.fields]).add("score", DoubleType())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, text_col):
            scores = sent.value.score(profiles(part.column(text_col)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, "score"])

    return kept.mapInArrow(run, schema)


def op5_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
