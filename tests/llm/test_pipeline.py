import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402
from test_decontaminate import expected as windows  # noqa: E402
from test_line_dedup import expected as dedup  # noqa: E402
from test_ngram_join import expected as groups  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_every_stage_against_brute_force(spark, tmp_path):
    import hashlib

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        stages.append((before, docs))
        assert docs.columns == columns or k == 4

    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {d for d, _ in texts_of(after)}
    assert all((d in kept) == (labels[d] == 1) for d in labels if d in dict(texts_of(before)))

    before, after = stages[1]
    want = {d: (lines, dropped, digest) for d, lines, dropped, digest in dedup(texts_of(before))}
    got = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts_of(after)}
    assert got == {d: w[2] for d, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = stages[2]
    assert {d for d, _ in texts_of(after)} == {d for d, _, c in groups(texts_of(before)) if c == d}

    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {d for d, _ in texts_of(after)} == {d for d, _, hit, _ in windows(texts_of(before), items) if not hit}

    before, after = stages[4]
    total = sum(len((t or "").split()) for _, t in texts_of(before))
    rows = after.collect()
    assert 0 < sum(r.taken for r in rows) <= 1.5 * total and all(0 < r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, P.run(spark, FOLDER).select("doc_id", "taken").collect())) == sorted(map(str, after.select("doc_id", "taken").collect()))


def test_edge_rows_pass_every_stage(spark, tmp_path):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "some plain words of a text", "en", "a", 3), (2, "", "en", None, 0), (3, "x y z " * 50_000, "de", "b", 1),
            (3, "x y z " * 50_000, "de", "b", 1), (4, "tiny", "en", "a", 4)]
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema).withColumns({c: F.lit("x") for c in ("score", "line", "kept_text", "size", "taken", "hits", "pos", "cls")})
        for n, (_, stage) in enumerate(P.STAGES):
            stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}-{n}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{n}")
        assert docs.count() == 0 or docs.where("taken > 2 * size").count() == 0


def test_rows_that_share_an_id(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    long = " ".join(f"w{i}" for i in range(100))
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    texts = {"A": long, "copy": long + " end", "B": "a text of its own that nothing else repeats"}
    rows = [(3, texts["A"]), (5, texts["copy"]), (5, texts["B"]), (None, texts["copy"]), (None, "alone " * 9), (7, ""), (7, ""), (8, None), (3, "")]
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], schema).withColumns({"_row": F.lit("r"), "_at": F.lit(1), "group": F.lit(2)})
    kept = P.near_copies(spark, docs, FOLDER)
    assert sorted(kept.columns) == sorted(docs.columns) and {r._row for r in kept.collect()} == {"r"}
    assert sorted(texts_of(kept), key=str) == sorted([(3, texts["A"]), (5, texts["B"]), (None, "alone " * 9), (7, ""), (8, None), (3, "")], key=str)
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in ((1, item), (1, "clean"), (None, item), (None, "clean"))], schema)
    assert sorted(texts_of(P.benchmarks(spark, docs, FOLDER)), key=str) == [(1, "clean"), (None, "clean")]


def fair(sizes):
    """{source: (size, target)} by resharing the excess over twice a source's size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixture_against_plain_shares(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = P.mixture(spark, docs, FOLDER).collect()
    size, taken = {}, {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len([w for w in re.split("[\\x20\\x09-\\x0D]+", r.text or "") if w])
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 < r.taken <= 2 * r.size and r.source_size == size[r.source]
    want, longest = fair(size), max(r.size for r in rows)
    assert all(abs(r.target - want[r.source]) < 1e-6 * want[r.source] for r in rows)
    assert all(abs(taken[s] - want[s]) <= 2 * longest for s in want)


def test_stages_that_only_led_to_a_result_are_deleted(spark):
    from smilegrid.plans import lineage

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folders = lambda: list(lineage._folders.get(spark.sparkContext.applicationId, []))
    for stage, result in ((P.near_copies, "copies"), (P.benchmarks, "contaminated")):
        before = set(folders())
        kept = stage(spark, docs, FOLDER)
        names = sorted(f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in folders() if f not in before)
        assert names == sorted([result, "ranges"])
        assert 0 < kept.count() <= docs.count() and kept.columns == docs.columns


def test_mixture_takes_what_the_mix_takes_and_shuffles_no_text(spark, monkeypatch):
    import random

    from smilegrid.llm import source_mix

    rng = random.Random(7)
    rows = [(rng.choice([None, *range(300)]), "w " * rng.randrange(0, 40), rng.choice(["a", "b", "é", None, "hot", "hot"])) for _ in range(900)]
    docs = spark.createDataFrame([(d, t, "en", s, 0, "own") for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, last string")
    want = {}
    for r in source_mix.mix(docs).collect():
        key = (r.doc_id, r.source, r.size)
        want[key] = max(want.get(key, (0,)), (r.taken, r.source_size, r.target))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(source_mix, "RANGE_ROWS", 50)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        found = P.mixture(spark, docs, FOLDER)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert " Exchange " not in plan and "SortMergeJoin" not in plan
    assert found.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    got = sorted(((r.doc_id, r.text, r.source, r.last, r.taken, r.source_size, r.target) for r in found.collect()), key=str)
    sized = [(d, t, s, "own", *want[d, s, len(t.split())]) for d, t, s in rows]
    assert got == sorted([r for r in sized if r[4] > 0], key=str) and len(got) < len(rows)
