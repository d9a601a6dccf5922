import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from smilegrid.llm import decontaminate as D

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"


def tokens(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(rows, items):
    out = []
    for d, t in rows:
        have, hit, names = tokens(t), set(), set()
        for item, text in items:
            w = tokens(text)
            for i in range(max(0, len(w) - 9) or bool(w)):
                window = w[i : i + 10]
                for p in range(len(have) - len(window) + 1):
                    if have[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        names.add("null" if item is None else str(item))
        out.append((d, len(have), len(hit), sorted(names)))
    return sorted(out, key=str)


def actual(df):
    found = df.select("doc_id", "n_words", F.coalesce(D.hit_count(F.col("hits")), F.lit(0)).alias("hit"), "items").collect()
    return sorted(((r.doc_id, r.n_words, r.hit, list(r["items"])) for r in found), key=str)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "the", "ä", "x1", "word", "other", "rare"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 10, 14, 30])))) for i in range(14)]
    rows = []
    for d in range(50):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 20)))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1].split()
            cut = rng.randrange(0, max(1, len(w) - 8))
            parts += [", ".join(w[cut:]).upper() if rng.random() < 0.5 else "\n".join(w[cut:]), rng.choice(vocabulary)]
        rows.append((d, " ".join(parts)))
    return rows, items


@pytest.mark.parametrize("block", [200_000, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    rows, items = planted(block)
    assert actual(D.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS))) == expected(rows, items)


def test_edge_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    long = "filler " * 200_000 + passage + " filler" * 10
    rows = [(1, None), (2, ""), (3, "?!"), (4, passage), (4, passage), (None, "x " + passage.upper()), (5, long), (6, "tiny-item"), (7, "tinyitem")]
    items = [(1, passage), (1, passage + " twelve"), (2, None), (3, ""), (4, "Tiny item"), (None, passage)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("items", F.lit(1)).withColumn("hits", F.lit("h")).withColumn("words", F.lit(2))
    bench = spark.createDataFrame(items, ITEMS).withColumn("item", F.lit("i"))
    short = [r for r in rows if r[0] != 5]
    found = actual(D.contamination(docs, bench))
    assert [r for r in found if r[0] != 5] == expected(short, items)
    assert [r for r in found if r[0] == 5] == [(5, 200_021, 11, ["1", "null"])]


def test_empty_tables(spark):
    rows, items = [(1, "a b")], [(1, "a b")]
    assert D.contamination(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, ITEMS)).count() == 0
    assert actual(D.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], ITEMS))) == [(1, 2, 0, [])]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.op8_decontaminate(spark, folder).collect()}
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in expected(docs, items)}
    assert found == want and any(w[4] for w in want.values())
