import random
import re

import numpy as np
import pytest

from smilegrid.llm import ngram_join

SCHEMA = "doc_id long, text string"


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    small = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(sets[i]), small[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def actual(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def varied(seed, groups=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 90, 200]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text = text[: int(len(text) * rng.uniform(0.75, 1)) or 1]
            rows.append((n * 7 % 1009, rng.choice([" ", "\n", "  ", "\t"]).join(text)))
            n += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_all_pairs(spark, seed):
    rows = varied(seed)
    assert actual(ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_edge_rows(spark):
    long = " ".join(f"a{i}" for i in range(300_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "ä Ä"), (8, "ä ä"),
        (9, long), (10, long + " tail"), (10, "other text of six words here"), (None, "one two"), (4, "One two"), (None, "x y z"),
    ]
    frame = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA + ", cls string, n int")
    result = actual(ngram_join.near_duplicates(frame))
    small = [r for r in rows if r[0] not in (9, 10)]
    assert [r for r in result if r[0] not in (9, 10)] == expected(small)
    assert {r for r in result if r[0] in (9, 10)} == {(9, 299_996, 9), (10, 299_997, 9), (10, 2, 10)}


def test_empty_table(spark):
    assert actual(ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_a_large_group_builds_no_pairs_within(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for d in range(400):
        text = list(base)
        text[rng.randrange(120)] = f"x{d}"
        rows.append((d, " ".join(text)))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r.component_id for r in ngram_join.near_duplicates(frame).collect()} == {0}


def test_fragments_get_few_bytes_a_shingle():
    """With many fragments a class is named to nearly each of them, so names must be as short as shingles."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(200)]
    shingles = sum(len(s) for s in sets)
    assert sum(len(payload) for _, payload in ngram_join._entries(sets, 2400)) < 18 * shingles


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_of_one_name_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "NAME", 7)
    rows = varied(seed)
    assert actual(ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))) == expected(rows)
