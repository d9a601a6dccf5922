import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from smilegrid.llm import url_filter as U

SCHEMA = "page_id long, url string"


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.com/en/12", "a.example.com", "/en/12", "com/en/", "block"),
        ("http://a.example.com/en/712?x", "a.example.com", "/en/712", "example.com/en/7", "allow"),
        ("http://notexample.com/en/712", "notexample.com", "/en/712", "com/en/", "block"),
        ("x://example.net/de/8#t", "example.net", "/de/8", "example.net/de/8", "block"),
        ("x://net/de/", "net", "/de/", "net/de/", "allow"),
        ("x://org/ES/1", "org", "/ES/1", None, "allow"),
        ("x://a.com/en", "a.com", "/en", None, "allow"),
        ("x://a.com?u=y://b.org/es/1", "a.com", "", None, "allow"),
        ("a.com/en/1", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://É.com/\nen/", "É.com", "/\nen/", None, "allow"),
    ],
)
def test_splitting_and_rules(spark, url, host, path, rule, verdict):
    r = U.judge(spark.createDataFrame([(1, url)], SCHEMA), U.OP4_RULES).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def tree(pages, labels, rules):
    """{page_id: (template, verdict)} by plain dictionaries, branch by branch."""

    def split(url):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return ("", "") if not m else (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2])

    def rule(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text)).blocked if fits else None

    known = defaultdict(lambda: [0, 0, 0])
    for _, url in pages:
        blocked = rule(*split(url))
        k = known[split(url)]
        k[0], k[1], k[2] = k[0] + 1, k[1] + (blocked is not None), k[2] + (blocked is True)
    for url, blocked in labels:
        k = known[split(url)]
        k[1], k[2] = k[1] + 1, k[2] + blocked
    paths = {key: (key[1].split("/")[1:], *k) for key, k in known.items()}
    literal = lambda s: s.replace("{", "%7B").replace("|", "%7C")
    digits = lambda s: re.search("[0-9]", s) is not None
    shape = lambda s: re.sub("[0-9]+", "{n}", literal(s))
    names = {key: [] for key in paths}
    depth = 0
    while live := [key for key in paths if len(paths[key][0]) > depth]:
        branches = defaultdict(list)
        for key in live:
            branches[key[0], tuple(names[key])].append(key)
        for keys in branches.values():
            total, by_segment, by_shape = sum(paths[k][1] for k in keys), Counter(), Counter()
            for k in keys:
                by_segment[paths[k][0][depth]] += paths[k][1]
            frequent = lambda n: n >= U.SUPPORT and n >= total * U.SHARE
            for s, n in by_segment.items():
                if digits(s) and not frequent(n):
                    by_shape[shape(s)] += n
            name = {}
            for s, n in by_segment.items():
                if s == "" or frequent(n):
                    name[s] = literal(s)
                else:
                    name[s] = shape(s) if digits(s) and frequent(by_shape[shape(s)]) else "{x}" if digits(s) else "{w}"
            nodes = defaultdict(lambda: [0, 0])
            for k in keys:
                node = nodes[name[paths[k][0][depth]]]
                node[0], node[1] = node[0] + paths[k][2], node[1] + paths[k][3]
            groups, last = [], None
            for share, node in sorted((b / n, m) for m, (n, b) in nodes.items() if n):
                n, b = nodes[node]
                if last is not None:
                    n_, b_ = nodes[last]
                    p = (b + b_) / (n + n_)
                    if share - b_ / n_ <= math.sqrt(p * (1 - p) * (1 / n + 1 / n_)) * U.ALIKE:
                        groups[-1].append(node)
                        last = node
                        continue
                groups.append([node])
                last = node
            called = {m: "{" + "|".join(sorted(g)) + "}" for g in groups if len(g) > 1 for m in g} if total >= U.SUPPORT else {}
            for k in keys:
                own = name[paths[k][0][depth]]
                names[k].append(called.get(own, own))
        depth += 1
    found = defaultdict(list)
    for key, made in names.items():
        found[key[0], tuple(made)].append(key)
    bad = set()
    for template, keys in found.items():
        n, b = sum(paths[k][2] for k in keys), sum(paths[k][3] for k in keys)
        purity, cover = (b + 1) / (n + 2), 1.0
        for i, made in enumerate(template[1]):
            by_segment = defaultdict(list)
            for k in keys:
                if literal(paths[k][0][i]) != made:
                    by_segment[paths[k][0][i]].append(paths[k])
            if by_segment:
                votes = [sum(p[3] for p in ps) / sum(p[2] for p in ps) for ps in by_segment.values() if sum(p[2] for p in ps)]
                urls = [(max(p[1], p[2]), p[2] > 0) for ps in by_segment.values() for p in ps]
                cover = min(cover, sum(u for u, seen in urls if seen) / sum(u for u, _ in urls), len(votes) / len(by_segment))
                unseen = len(votes) < len(by_segment)
                purity = min(purity, (sum(votes) + unseen) / (len(votes) + 2 * unseen))
        if n and purity >= U.REJECT_FROM and cover >= U.COVER:
            bad.add(template)
    out = {}
    for page, url in pages:
        key = split(url)
        blocked = rule(*key)
        template = (key[0], tuple(names[key]))
        out[page] = ("".join("/" + m for m in template[1]), "block" if (template in bad if blocked is None else blocked) else "allow")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_whole_verdict_against_plain_python(spark, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice(["es", "fr", "de", "news", "item%d" % rng.randrange(40), str(rng.randrange(900)), "w" * rng.randrange(30), "a{b|c", ""])
    bad = lambda path: path.startswith("/es") or "/news" in path or rng.random() < 0.05
    paths = ["/".join(["", *(pick() for _ in range(rng.choice([0, 1, 1, 2, 3, 5])))]) for _ in range(500)] + ["/deep" * 40 + f"/{i}" for i in range(9)]
    urls = [f"x://{rng.choice(['a.org', 'a.org', 'b.com', 'C.net'])}{p}" for p in paths] + [None, "", "x:/y", "x://a.org"]
    pages = list(enumerate(urls + rng.choices(urls, k=100)))
    labels = [(u, bad(u[9:])) for u in urls if u and "://" in u and rng.random() < 0.6]
    frame, labelled = spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(labels, "url string, blocked boolean")
    got = {r.page_id: (r.template, r.verdict) for r in U.judge(frame, U.OP4_RULES, labels=labelled).collect()}
    want = tree(pages, labels, U.OP4_RULES)
    assert got == want
    assert any("|" in t for t, _ in want.values()) and {v for _, v in want.values()} == {"allow", "block"}


def test_templates(spark):
    urls = [f"/shop/item{i}/view" for i in range(30)] + [f"/shop/word{'abc'[i % 3]}{'x' * i}/" for i in range(30)] + ["/a/b/c/d/e", "", "/", "/{w}/1"]
    urls += ["/long" * 3000 + f"/{'y' * 3000}{i}" for i in range(6)]
    paths = spark.createDataFrame([("h", p, 1, 0, 0) for p in urls], "host string, path string, n long, labels long, blocked long")
    found = {r.path: r.names for r in U.templates(paths).collect()}
    assert found["/shop/item7/view"] == ["shop", "item{n}", "view"]
    assert found["/shop/wordb" + "x" * 4 + "/"] == ["shop", "{w}", ""]
    assert found["/a/b/c/d/e"] == ["{w}"] * 5 and found["/{w}/1"] == ["{w}", "{x}"]
    assert found[""] == [] and found["/"] == [""]
    assert found[urls[-1]] == ["long"] * 3000 + ["y" * 3000 + "{n}"]


def test_similar_branches_are_merged(spark):
    urls = [(f"x://h.org/{s}/{t}/{i}", s != "ok") for s in ("spam", "scam", "ok") for t in ("u", "v") for i in range(10)]
    labels = [u for u in urls if u[0].endswith(("1", "3", "5"))]
    found = U.judge(spark.createDataFrame(list(enumerate(u for u, _ in urls)), SCHEMA), [], labels=spark.createDataFrame(labels, "url string, blocked boolean"))
    assert {(r.template, r.verdict) for r in found.collect()} == {("/{scam|spam}/{u|v}/{n}", "block"), ("/ok/{u|v}/{n}", "allow")}


def test_rejection_by_purity(spark):
    pages = [(i, f"x://h.org/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)] + [(900 + i, f"x://h.org/new/{i}") for i in range(20)]
    labels = [(f"x://h.org/bad/{i}", True) for i in range(1, 60, 2)] + [(f"x://h.org/good/{i}", i > 50) for i in range(0, 60, 2)]
    labels += [(None, True), ("x://h.org/new/1", None)]
    frame = spark.createDataFrame(pages, SCHEMA)
    found = U.judge(frame, [], labels=spark.createDataFrame(labels, "url string, blocked boolean")).collect()
    assert {(r.path.split("/")[1], r.verdict) for r in found} == {("bad", "block"), ("good", "allow"), ("new", "allow")}


@pytest.mark.parametrize("ruled", [1, 3])
def test_ruled_sections_do_not_block_clean_ones(spark, ruled):
    sections = [chr(97 + i // 10) + chr(97 + i % 10) for i in range(100)]
    pages = [(100 * i + k, f"x://h.org/{s}/{100 * i + k}") for i, s in enumerate(sections) for k in range(4)]
    rules = [U.Rule(True, "org", f"/{s}/") for s in sections[:ruled]]
    found = U.judge(spark.createDataFrame(pages, SCHEMA), rules).collect()
    assert {r.template for r in found} == {"/{w}/{n}"}
    assert all((r.verdict == "block") == (r.rule is not None) for r in found)


def test_one_ruled_section_of_a_small_host(spark):
    pages = [(i, f"x://h.org/es/{i}.html") for i in range(4)] + [(9, "x://h.org/fr/7855.html")]
    found = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(pages, SCHEMA), U.OP4_RULES).collect()}
    assert found == {0: "block", 1: "block", 2: "block", 3: "block", 9: "allow"}


def test_deep_sections(spark):
    pages = [(i, f"x://h.org/a/b/c/bad/{i}") for i in range(8)] + [(9, "x://h.org/a/b/c/good/1")]
    found = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(pages, SCHEMA), [U.Rule(True, "org", "/a/b/c/bad/")]).collect()}
    assert found == {**dict.fromkeys(range(8), "block"), 9: "allow"}


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "x://a.com/en/1"), (1, "x://a.com/en/1"), (None, None)], SCHEMA)
    frame = frame.withColumns({"n": F.lit(1), "labels": F.lit(2), "verdict": F.lit("old"), "template": F.lit("t"), "total": F.lit(0)})
    found = U.judge(frame, U.OP4_RULES)
    assert sorted(found.columns) == sorted(["page_id", "url", "n", "labels", "total", "host", "path", "rule", "template", "verdict"])
    assert sorted(r.verdict for r in found.collect()) == ["allow", "block", "block"]
    assert U.judge(spark.createDataFrame([], SCHEMA), U.OP4_RULES).count() == 0


def test_no_python_in_the_plan(spark):
    plan = U.op4_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
