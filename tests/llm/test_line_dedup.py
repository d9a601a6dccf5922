import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from smilegrid.llm import line_dedup as L

SCHEMA = "doc_id long, text string"
WHITE = " \t\n\x0b\f\r"


def expected(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(WHITE))
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < 3 or d == max(held[key(x)], key=lambda i: (i is not None, i))]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def actual(spark, rows, extra=False):
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:
        frame = frame.withColumn("pos", F.lit(1)).withColumn("key", F.lit("x")).withColumn("_keep", F.lit(1)).drop("_keep")
    kept = L.apply_keep(frame, L.keep_bitmaps(frame))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in kept.collect()), key=str)


@pytest.mark.parametrize("hot", [5_000, 4])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT_LINES", hot)
    rng = random.Random(hot)
    shared = [f"A shared Line number {i} of them" for i in range(12)] + ["short", "", "  "]
    rows = []
    for d in range(60):
        lines = [rng.choice([rng.choice(shared), f"own line of document {d} {rng.random()}", "\t" + rng.choice(shared).upper() + " "]) for _ in range(rng.randrange(0, 12))]
        rows.append((d * 31 % 101, "\n".join(lines)))
    assert actual(spark, rows) == expected(rows)


def test_edge_rows(spark):
    line = "this line is long enough to count"
    long = "\n".join([line, *[f"line {i} of a very long text" for i in range(30_000)], line])
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line), (4, line), (4, f"x\n{line}"), (5, f"{line}\n{line}\nown"), (None, line), (6, long), (7, "é" * 20), (8, "é" * 20), (9, "É" * 19)]
    assert actual(spark, rows, extra=True) == expected(rows)


def test_two_documents_keep_their_lines(spark):
    line = "this line is long enough to count"
    rows = [(1, line), (1, line), (2, line)]
    assert actual(spark, rows) == expected(rows)
    assert [r[2] for r in actual(spark, rows)] == [0, 0, 0]


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert L.apply_keep(frame, L.keep_bitmaps(frame)).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a")], SCHEMA)
    plan = L.apply_keep(frame, L.keep_bitmaps(frame))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
