import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from smilegrid.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def query(spark, tmp_path, rows, **extra):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in extra.items()}).repartition(4)
    path = f"{tmp_path}/t{random.random()}"
    frame.write.parquet(f"{path}/conversations.parquet")
    found = T.op11_prefix_trie(spark, path)
    got = {(r.conv_id, r.depth): tuple(r) for r in found.collect()}
    assert len(got) == found.count()
    return got


def plain(rows):
    """The trie by dictionaries of whole sequences."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    below = lambda node: [m for m in members if m[: len(node)] == node]
    parents = {m[:-1] for m in members if m}
    out = {}
    for node, ids in members.items():
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below(node) if m)
        leaves = sum(m not in parents for m in below(node))
        children = sum(len(m) == len(node) + 1 for m in below(node))
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out[min(ids), len(node)] = (min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children, leaves, saved, digest)
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([None, *range(-12, 60)])
        for turn in range(rng.choice([1, 2, 5, 9, 12])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "b" * 40])))
    return rows + rows[:9]


@pytest.mark.parametrize("seed,last,block,piece", [(1, 1 << 16, 4096, 256), (2, 3, 2, 2)])
def test_against_plain_python(spark, tmp_path, monkeypatch, seed, last, block, piece):
    monkeypatch.setattr(T, "LAST", last), monkeypatch.setattr(T, "BLOCK", block), monkeypatch.setattr(T, "PIECE", piece)
    rows = corpus(seed)
    assert query(spark, tmp_path, rows, d=1, i="x", n_convs=None, part=0) == plain(rows)


def test_common_and_long_conversations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 400, 5) for t in range(3)]  # equal conversations
    rows += [(1005, t, "user", "x" * (t % 3)) for t in range(700)] + [(2005, 0, None, "text " * 20_000)]
    assert query(spark, tmp_path, rows) == plain(rows)


def test_turnless_and_empty(spark, tmp_path):
    # Conversation 7 has fewer turns than it gives up and no base: it is a member of the root only.
    lone = next(c for c in range(6, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "gone")]
    assert query(spark, tmp_path, rows) == plain(rows) and len(plain(rows)) == 1
    assert query(spark, tmp_path, []) == {} and query(spark, tmp_path, [(None, 1, "user", "a")]) == {}


def test_list_ranks(spark, monkeypatch):
    monkeypatch.setattr(T, "LAST", 1)
    order = list(range(50))
    random.Random(5).shuffle(order)
    rows = [(a, b, a) for a, b in zip(order, [*order[1:], None])]
    got = {r.id: r.w for r in T.list_ranks(spark.createDataFrame(rows, "id long, next long, w long"), ["w"]).collect()}
    assert got == {a: sum(order[:k]) for k, a in enumerate(order)}
