import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smilegrid.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def grid(rows):
    return np.floor(64 * np.array(rows, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000


@pytest.mark.parametrize("entries", [64, W.BLOCK_ENTRIES])
def test_against_numpy(spark, monkeypatch, entries):
    monkeypatch.setattr(W, "BLOCK_ENTRIES", entries)
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(300, 8)) * [1, 2, 3, 4, 5, 6, 7, 8]).astype(np.float32)
    rows[100:200] = rows[7]  # repeated rows
    frame = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    found = W.whiten(frame, "embedding", ["vec_id"], 6)
    got = {r.vec_id: r for r in found.rows.collect()}
    x = grid(rows)
    away = len(x) * x - x.sum(axis=0)
    cov = (away / len(x)).T @ (away / len(x)) / len(x)
    values, vectors = np.linalg.eigh(cov)
    want = (away / len(x)) @ vectors[:, ::-1][:, :6] / np.sqrt(values[::-1][:6])
    made = np.array([got[i].whitened for i in range(300)])
    assert np.allclose(made * np.sign((made * want).sum(axis=0)), want, atol=1e-9)
    assert [got[i].deviation for i in range(300)] == [int(d @ d) for d in away]
    assert {r.n for r in got.values()} == {300} and found.identity_error < 1e-9
    assert np.allclose(found.values, values[::-1]) and math.isclose(found.trace, np.trace(cov))


def test_unusable_rows_and_extra_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [3.0]), (None, [2.0, -1.0]), (1, [0.5, 0.25])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("x"), "index": F.lit(1), "whitened": F.lit(None), "x": F.lit(0), "away": F.lit(2)})
    found = W.whiten(frame, "embedding", ["vec_id"])
    got = sorted((r.vec_id or 0, r.n, r.deviation) for r in found.rows.collect())
    away = 3 * grid([[1, 2], [2, -1], [0.5, 0.25]]) - grid([[1, 2], [2, -1], [0.5, 0.25]]).sum(axis=0)
    assert got == sorted((i, 3, int(d @ d)) for i, d in zip((1, 0, 1), away)) and found.identity_error < 1e-9


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], SCHEMA)
    found = W.whiten(same, "embedding", ["vec_id"])
    assert [(r.deviation, r.whitened) for r in found.rows.collect()] == [(0, [0.0, 0.0, 0.0])] * 5 and found.identity_error == 0
    part = spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0]) for i in range(5)], SCHEMA)
    found = W.whiten(part, "embedding", ["vec_id"])
    assert all(r.whitened[1:] == [0.0, 0.0] for r in found.rows.collect()) and found.identity_error < 1e-9
    assert W.whiten(spark.createDataFrame([(1, None)], SCHEMA), "embedding", ["vec_id"]) is None
    huge = W.whiten(spark.createDataFrame([(1, [3e38]), (2, [-3e38]), (3, [0.0])], SCHEMA), "embedding", ["vec_id"])
    assert [r.deviation for r in huge.rows.orderBy("vec_id").collect()][2] is not None and huge.identity_error < 1e-9


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    empty = W.op12_whitening(spark, str(tmp_path))
    full = W.op12_whitening(spark, "/root/testdata/sf0.001")
    assert empty.count() == 0 and [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in full.schema]
    assert {r.component for r in full.collect()} == set(range(1, 33))
