import random

from pyspark.sql import functions as F

from smilegrid.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "&amp;", "&lt;", "&#91;", "&", "<", "[", "a", "é", "\n", "🙂", "\\", "$1"]


def sample(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "<s>", "a[b", ""]), "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))))
    rng.shuffle(rows)
    return rows


def test_round_trip_and_mask(spark):
    rows = sample(1)
    rendered = C.render(spark.createDataFrame(rows, SCHEMA))
    parsed = {r.conv_id: [tuple(t) for t in r.turns] for r in rendered.select("conv_id", C.parse(F.col("formatted")).alias("turns")).collect()}
    whole = {r.conv_id: r.formatted for r in rendered.collect()}
    found = {(r.conv_id, r.example): (r.prompt, r.reply, r.plain) for r in C.examples(rendered).withColumn("plain", C.unescape(F.col("reply"))).collect()}
    for c in whole:
        turns = sorted(((t, r, x) for cc, t, r, x in rows if cc == c))
        assert parsed[c] == [(r, x) for _, r, x in turns]
        replies = [(k, x) for k, (_, r, x) in enumerate(turns) if r == "assistant"]
        assert sorted(e for cc, e in found if cc == c) == list(range(len(replies)))
        for e, (k, x) in enumerate(replies):
            prompt, reply, plain = found[c, e]
            assert plain == x and whole[c].startswith(prompt + reply + C.CLOSE)
            assert prompt.count(C.OPEN) == k + 1 and prompt.endswith(C.OPEN + "assistant" + C.BODY)


def test_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 5, "assistant", "n"), (None, None, "user", "first"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"),
            (3, 0, "user", "only"), (4, 0, "assistant", "long " * 200_000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)).withColumn("spans", F.lit(1)).withColumn("turns", F.lit(1))
    rendered = C.render(frame)
    parsed = {r.conv_id: [tuple(t) for t in r.turns] for r in rendered.select("conv_id", C.parse(F.col("formatted")).alias("turns")).collect()}
    assert parsed[1] == [("user", ""), ("", "x")] and parsed[None] == [("user", "first"), ("assistant", "n")]
    assert parsed[2] == [("assistant", "a")] * 2 and parsed[4][0][1] == "long " * 200_000
    counts = {r.conv_id: r["count"] for r in C.examples(rendered).groupBy("conv_id").count().collect()}
    assert counts == {None: 1, 2: 2, 4: 1}
    assert C.render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = C.op10_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
