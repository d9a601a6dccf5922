import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from smilegrid.llm import lm_difference as M
from smilegrid.llm.tables import cut

SCHEMA = "doc_id long, text string, target boolean"


def expected(rows):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, _ in rows]
    pairs = [Counter(zip([None, *w[:-1]], w, strict=True)) if w else Counter() for w in texts]
    pasts = [Counter([None, *w[:-1]]) if w else Counter() for w in texts]
    v = 1 + len({w for t in texts for w in t})
    total, of_target = sum(map(len, texts)), sum(len(t) for t, r in zip(texts, rows, strict=True) if r[2])
    a = (M.PSEUDO, M.PSEUDO * (of_target / total if of_target else 1.0))
    sums = [(sum((c for c, r in zip(x, rows, strict=True) if m == 0 or r[2]), Counter())) for m in (0, 1) for x in (pairs, pasts)]
    out = []
    for (d, _, t), w, pair, past in zip(rows, texts, pairs, pasts, strict=True):
        losses = []
        for m in (0, 1):
            own = 1 if m == 0 or t else 0
            loss = 0.0
            for (h, x), n in pair.items():
                top = sums[2 * m][h, x] - own * n + a[m]
                loss -= n * math.log(top / (sums[2 * m + 1][h] - own * past[h] + a[m] * v))
            losses.append(loss / len(w) if w else None)
        out.append((d, len(w), *losses, losses[0] - losses[1] if w else 0.0))
    return sorted(out, key=str)


def check(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[0]), str(r[1]), str(r[2])))
    want = sorted(expected(rows), key=lambda r: (str(r[0]), str(r[1]), str(r[2])))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want, strict=True):
        assert [x if x is None else round(x, 8) for x in g[2:]] == pytest.approx([x if x is None else round(x, 8) for x in w[2:]], abs=1e-7)


def sample(seed, n=60):
    rng = random.Random(seed)
    return [(d, " ".join(rng.choice("the The a of x y z w v rare".split() + [f"r{rng.randrange(80)}"]) for _ in range(rng.randrange(0, 40))), rng.random() < 0.4) for d in range(n)]


@pytest.mark.parametrize("seed,fragment,chunk", [(1_000, 4_000_000, 60_000), (30, 20, 7), (1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, seed, fragment, chunk):
    monkeypatch.setattr(M, "FRAGMENT", fragment), monkeypatch.setattr(M, "CHUNK_ROWS", chunk)
    rows = sample(seed)
    check(M.cross_entropy_difference(spark.createDataFrame(rows, SCHEMA).repartition(5)), rows)


def test_edge_rows(spark):
    rows = [(1, None, True), (2, "", False), (3, " \n", None), (4, "same words", True), (4, "same words", True), (None, "same words twice", False),
            (6, "long text " * 100_000, True), (7, "É é", None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "part", "payload", "n", "key")})
    check(M.cross_entropy_difference(frame), [(d, t, bool(x)) for d, t, x in rows])


def test_stored_chunks_are_read_one_at_a_time(spark, monkeypatch):
    """However many a task has made of its input: row groups are written and read whole."""
    monkeypatch.setattr(M, "CHUNK_ROWS", 2)
    rows = [(d, "the same words again", d % 2 == 0) for d in range(40)]
    files = M.chunked(spark.createDataFrame(rows, SCHEMA).coalesce(1)).inputFiles()
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert sum(m.num_rows for m in found) == 20
    assert all(m.row_group(i).num_rows == 1 for m in found for i in range(m.num_row_groups))


def test_shuffles_of_stored_counts_are_deleted(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = lambda: {f.name for f in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data")}
    chunks = M.chunked(spark.createDataFrame(sample(5), SCHEMA))
    ready = cut(chunks.join(M.marked(chunks).select("chunk", "marks"), "chunk"))
    before = kept()
    counts = M.corpus_counts(ready, 4)
    assert kept() <= before
    assert counts.where("chunk is null").count() == 4
    assert spark.conf.get(name, None) is None


@pytest.mark.parametrize("rows", [[], [(1, "no target here", False), (2, "no target", False)]])
def test_empty_and_without_target(spark, rows):
    check(M.cross_entropy_difference(spark.createDataFrame(rows, SCHEMA)), rows)


def test_target_ids(spark):
    """Equal ids are targets together, null ids never, and ids without a document do nothing."""
    rows = [(1, "a b c a b", True), (1, "c b", True), (2, "a b", False), (None, "b c a", False), (3, None, True), (4, "b b b", True)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    check(M.cross_entropy_difference(docs, targets=spark.createDataFrame([(1,), (3,), (4,), (9,), (None,)], "good long")), rows)


@pytest.mark.parametrize("slice_", [1, 3, 1_000])
def test_fragments_added_up_in_slices(monkeypatch, slice_):
    monkeypatch.setattr(M, "SLICE", slice_)
    rng = random.Random(slice_)
    chunks = [{rng.randrange(1 << 64): (rng.randrange(1, 9), rng.randrange(3)) for _ in range(20)} | {7: (300, 1), (1 << 64) - 1: (1, 0)} for _ in range(4)] + [{}]
    sums = {k: [sum(c[k][j] for c in chunks if k in c) for j in (0, 1)] for c in chunks for k in c}
    sent = [[np.array(sorted(c), np.uint64), *(np.array([c[k][j] for k in sorted(c)], np.uint16) for j in (0, 1))] for c in chunks]
    pieces, distinct = M._added(sent, 0)
    assert distinct == len(sums)
    for c, of in zip(chunks, pieces, strict=True):
        for j in (0, 1):
            assert [int(x) for p in of[j] for x in p] == [sums[k][j] for k in sorted(c)]


def test_good_documents_score_higher(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = {r.doc_id: r.score for r in M.op7_lm_difference(spark, folder).collect()}
    assert len(found) == 1000
    mean = lambda q: sum(found[d] for d, x in labels.items() if x == q) / sum(x == q for x in labels.values())
    assert mean(1) > mean(0)
