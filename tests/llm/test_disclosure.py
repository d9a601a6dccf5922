import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from smilegrid.llm import disclosure as D

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(n) <= 19 and luhn(n)):
                continue
            if kind == "phone" and not 9 <= len(n) <= 15:
                continue
            out.append((kind, m.start(), m.end(), kind + ":" + (n if kind in ("card", "phone") else m[0].translate(FOLD))))
    return out


def plain(texts):
    """All spans of every text, by plain counting."""
    texts = [t or "" for t in texts]
    fold = [t.translate(FOLD) for t in texts]
    holds, near, places = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, t in enumerate(texts):
        by_kind = defaultdict(list)
        for kind, pattern in D.PATTERNS.items():
            by_kind[kind] = [(m.start(), m.end()) for m in re.finditer(BASE[kind], t) if kind != "card" or len(re.sub("[^0-9]", "", m[0])) > 12]
        for kind, a, b, e in base(t):
            holds[e].add(d)
            k = by_kind[kind].index((a, b))
            low = by_kind[kind][k - 1][1] if k else 0
            high = by_kind[kind][k + 1][0] if k + 1 < len(by_kind[kind]) else len(t)
            left, right = fold[d][max(low, a - D.REACH) : a], fold[d][b : min(high, b + D.REACH)]
            l, r = WORD.findall(left), WORD.findall(right)
            l = (l[1:] if len(left) >= D.REACH else l)[::-1][: D.NEAR]
            r = (r[:-1] if len(right) >= D.REACH else r)[: D.NEAR]
            for term in {*l, *r}:
                if len(term) >= D.SHORTEST:
                    near[e, term].add(d)
                    places[e, term].add((tuple(l), tuple(r)))
    in_docs = Counter(w for t in fold for w in set(WORD.findall(t)))
    bad = set()
    for (e, term), docs in near.items():
        if len(places[e, term]) >= D.SUPPORT and len(holds[e]) < len(texts):
            if 1 - math.log(len(docs) / in_docs[term]) / math.log(len(holds[e]) / len(texts)) >= D.THRESHOLD:
                bad.add(term)
    out = []
    for t, f in zip(texts, fold):
        spans = [s[:3] for s in base(t)]
        spans += [("term", m.start(), m.end()) for m in WORD.finditer(f) if m[0] in bad and not any(a <= m.start() < b for _, a, b in spans)]
        out.append(sorted(spans, key=lambda s: (D.KINDS.index(s[0]), s[1])))
    return out, bad


def corpus(seed):
    rng = random.Random(seed)
    bits = ["a.b+c@x-y.org", "A@b.c_d@e.f", "a@b", "@", "1.2.3.4", "1.2.3.4.5.6.7.256", "001.02.3.255", "4111 1111-1111 1111", "4111111111111112", "+1 (663) 555-6869", "+49 30 12", "+", "12 34", "378282246310005", "5.", "é", "Zürich", "…"]
    filler = ["der", "haus", "wort", "lange", "sätze", "über", "nichts", "viele", "42", "x"]
    texts = [None, "", "word"]
    for i in range(120):
        body = [rng.choice(filler + bits * (i % 3 == 0)) for _ in range(rng.randrange(60))]
        texts.append(rng.choice([" ", "  ", "\n", ", "]).join(body))
    for i in range(6):  # a name that stands near one address only
        lead = " ".join(rng.choices(filler, k=rng.choice([3, 40])))
        texts.append(f"{lead} {rng.choice(['Kestrelwick', 'KESTRELWICK'])} {rng.choice(filler)} kw@mail.org {' '.join(rng.choices(filler, k=30))}")
    return texts + [texts[-1]] * 20 + ["kestrelwick", texts[20]]


def test_against_plain_counting(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"spans": F.lit("x"), "digest": F.lit(0), "kind": F.lit(None), "clean": F.lit(1)})
        rows = D.find(frame.repartition(5))
        assert sorted(rows.columns) == ["clean", "digest", "doc_id", "kind", "spans", "text"]
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in rows.collect()}
        want, bad = plain(texts)
        assert bad == {"kestrelwick"}
        assert got == dict(enumerate(want))


def test_sanitised_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    texts = corpus(3) + ["+1 (663) 555-6869" * 9, "4111111111111111"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in D.sanitise(D.find(frame)).collect():
        want, last, names = "", 0, {}
        for kind, a, b in sorted(((s.kind, s.start, s.end) for s in r.spans), key=lambda s: (s[1], -s[2], s[0])):
            if a >= last:
                want += (r.text or "")[last:a] + ("" if kind == "term" else f"<{kind.upper()}>")
            last = max(last, b)
        assert r.clean == (None if r.text is None else want + r.text[last:])


def test_long_texts_and_empty_tables(spark):
    long = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "a." * 100_000 + "@", "+1" + "(" * 100_000, "x@y.z " * 3000, "1.2.3.4 " * 3000]
    frame = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in D.find(frame).collect()}
    assert [len(got[i]) for i in range(7)] == [0, 0, 0, 0, 0, 3000, 3000]
    assert [(s.start, s.end) for s in got[5]] == [(6 * i, 6 * i + 5) for i in range(3000)]
    assert D.find(frame.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = D.op13_disclosure(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
