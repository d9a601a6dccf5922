import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from smilegrid.llm import quality_knn as Q


def test_profiles_match_plain_counts():
    texts = ["Ab, c\nAb Ab", "", None, "xy", "é!é", "a" * 5000 + " b"]
    found = Q.profiles(pa.array(texts))
    for text, row in zip(texts, found, strict=True):
        data = (text or "").encode()
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        assert row[:1000].sum() == row[1000:-3].sum() == max(0, len(data) - 2)
        assert row[-3:].tolist() == [len(w), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(set(w))]


def test_scores_are_exact_cosine_votes():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (300, Q.WIDTH)).astype(np.float32)
    labels = rng.integers(0, 2, 300).astype(float)
    model = Q.fit_counts(counts, labels)
    rows = rng.integers(0, 5, (20, Q.WIDTH)).astype(np.float32)
    for row, got in zip(rows, model.score(rows), strict=True):
        near = (model.vectors @ model.project(row[None])[0]).astype(np.float64)
        best = np.argsort(near)[-Q.NEIGHBOURS :]
        weight = np.maximum(near[best], 0) ** Q.SHARPNESS
        want = ((weight * labels[best]).sum() + 1e-3 * labels.mean()) / (weight.sum() + 1e-3)
        assert abs(got - want) < 1e-4


def test_held_out_accuracy_and_unseen_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in Q.op5_quality_knn(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(found) == 1000 and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items())
    test = [(found[d].predicted, q) for d, q in labels.items() if found[d].held_out]
    assert np.mean([p == q for p, q in test]) > 0.97 and np.mean([p for p, q in test if q == 1]) > 0.98
    flipped = spark.read.parquet(f"{folder}/labels.parquet").withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    again = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, flipped)).collect()}
    assert all(abs(again[d] - r.score) < 1e-5 for d, r in found.items())


def test_edge_rows(spark):
    schema = "doc_id long, text string, score string"
    rows = [(1, "good text here", "x"), (1, "good text here", "y"), (2, None, "z"), (3, "", "z"), (None, "BAD!! BAD!!", "q"), (5, "w " * 500_000, "q"), (6, "BAD!! TEXT!!", "q")]
    docs = spark.createDataFrame(rows, schema).withColumn("label", F.lit(1)).withColumn("counts", F.lit("c"))
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 1), (None, 0), (3, None), (1, 1)], "doc_id long, quality int")
    found = Q.score(docs, Q.fit(docs, labels)).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    assert found[0].score == found[1].score and found[2].score == found[3].score
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, Q.fit(docs, none)).collect()} == {0.5}
    assert Q.score(spark.createDataFrame([], schema), Q.fit(docs, labels)).count() == 0
