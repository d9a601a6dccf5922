import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from smilegrid.llm import source_mix as M

SCHEMA = "doc_id long, text string, source string"


def water_fill(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


def rows_of(seed, n=600):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", "hot", None]
    return [(d, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), "hot" if rng.random() < 0.4 else rng.choice(sources)) for d in range(n)]


@pytest.mark.parametrize("range_rows", [50_000, 20])
def test_targets_and_taken(spark, monkeypatch, range_rows):
    monkeypatch.setattr(M, "RANGE_ROWS", range_rows)
    rows = rows_of(4)
    found = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    aims = water_fill(sizes)
    taken = defaultdict(int)
    for r in found:
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.source_size == sizes[r.source] and abs(r.target - aims[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert all(abs(taken[s] - aims[s]) <= 120 for s in aims)


def test_ranges_do_not_change_the_result(spark, monkeypatch):
    frame = spark.createDataFrame(rows_of(5), SCHEMA)
    coarse = sorted(map(tuple, M.mix(frame).collect()), key=str)
    monkeypatch.setattr(M, "RANGE_ROWS", 10)
    assert sorted(map(tuple, M.mix(frame.repartition(7)).collect()), key=str) == coarse


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "some words", "b"), (4, "x " * 200_000, "c"), (5, "same", "b"), (5, "same", "b")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("s")).withColumn("key", F.lit(1)).withColumn("target", F.lit(1))
    found = M.mix(frame).collect()
    assert sorted((r.doc_id or 0, r.size) for r in found) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 200_000), (5, 1), (5, 1)]
    assert all(r.taken <= 2 * r.size for r in found)


@pytest.mark.parametrize("rows", [[], [(1, "", "a"), (2, None, None)]])
def test_nothing_to_take(spark, rows):
    assert [r.taken for r in M.mix(spark.createDataFrame(rows, SCHEMA)).collect()] == [0] * len(rows)


def test_word_count_rule(spark):
    texts = ["a b", "a b", "\x1fa", " a\x0bb\x0cc ", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in frame.select(M.word_count(F.col("t"))).collect()]
    assert found == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
