import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smilegrid.functions import numeric as N
from smilegrid.functions import sizing
from smilegrid.functions import text as X
from smilegrid.functions.sizing import exact_quantiles, median_by
from smilegrid.settings import Cleaning


def test_normal_distribution_against_erfc(spark):
    xs = [float(x) for x in np.random.default_rng(42).normal(size=2000) * 5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", N.norm_cdf("x").alias("c")).collect()
    assert max(abs(r.c - 0.5 * math.erfc(-r.x / math.sqrt(2))) for r in rows) < 1e-15


def test_known_option_price_and_finite_difference_greeks(spark):
    h = 1e-3
    base = dict(s=100.0, k=105.0, t=0.7, r=0.03, q=0.01, v=0.23)
    shifts = [dict(), dict(s=h), dict(s=-h), dict(v=1e-5), dict(v=-1e-5), dict(t=1e-5), dict(t=-1e-5)]
    rows = [tuple(base[k] + d.get(k, 0.0) for k in base) for d in shifts]
    rows.append((100.0, 100.0, 1.0, 0.05, 0.0, 0.2))
    df = spark.createDataFrame(rows, "s double, k double, t double, r double, q double, v double").coalesce(1)
    df = N.with_option_price(df, "p", "s", "k", "t", "r", "q", "v", F.lit(True))
    out = N.with_greeks(df, "", "s", "k", "t", "r", "q", "v", F.lit(True)).collect()
    p = [r.p for r in out]
    assert p[-1] == pytest.approx(10.450583572185565, abs=1e-12)
    assert out[0].Delta == pytest.approx((p[1] - p[2]) / (2 * h), abs=1e-7)
    assert out[0].Gamma == pytest.approx((p[1] - 2 * p[0] + p[2]) / h**2, abs=1e-5)
    assert out[0].Vega == pytest.approx((p[3] - p[4]) / 2e-5, abs=1e-6)
    assert out[0].Theta == pytest.approx(-(p[5] - p[6]) / 2e-5, abs=1e-6)


def test_greeks_need_six_usable_inputs(spark):
    rows = [(100.0, 100.0, 0.5, 0.0, 0.0, v) for v in (0.2, 0.0, -0.1, float("nan"), float("inf"))]
    df = spark.createDataFrame(rows, "s double, k double, t double, r double, q double, v double").coalesce(1)
    out = N.with_greeks(df, "", "s", "k", "t", "r", "q", "v", F.lit(False)).collect()
    assert [r.Vega is not None for r in out] == [True, False, False, False, False]


def test_two_sided_books(spark):
    nan, inf = float("nan"), float("inf")
    books = [(0.0, 2.0), (-1.0, 2.0), (nan, 2.0), (inf, inf), (1.0, nan), (1.0, inf), (1.0, 0.9), (1.0, 1.0), (None, 1.0)]
    df = spark.createDataFrame(books, "b double, a double").coalesce(1)
    assert [r[0] for r in df.select(N.two_sided("b", "a")).collect()] == [False] * 7 + [True, False]


def test_mixed_dates(spark):
    cases = {
        "2024-02-01": dt.date(2024, 2, 1),
        "01/02/2024": dt.date(2024, 2, 1),
        "01/13/2024": dt.date(2024, 1, 13),
        "31/02/2024": None,
        "3.4.2024": dt.date(2024, 4, 3),
        "2024/3/5": dt.date(2024, 3, 5),
        "20240305": dt.date(2024, 3, 5),
        "5 Mar 2024": dt.date(2024, 3, 5),
        "2024-02-01 10:00:00": dt.date(2024, 2, 1),
        "n/a": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.d for r in df.select("s", X.lenient_date("s").alias("d")).collect()} == cases


def test_contract_key_rounds_half_even(spark):
    df = spark.createDataFrame([(" spx ", "spxw", dt.date(2024, 3, 15), 4.0000005, "call")], "u string, r string, e date, k double, o string")
    key = df.select(X.contract_key("u", "r", "e", "k", "o")).first()[0]
    assert key == "SPX|SPXW|2024-03-15|4.000000|C"


def test_reason_categories(spark):
    cases = {
        "NONPOSITIVE_VOLUME": "NONPOSITIVE_VOLUME_ONLY",
        "SPREAD_ABOVE_DEFAULT_MAX": "SPREAD_FILTER_ONLY",
        "NO_EXACT_RATE_DATE": "RATE_OR_IV_INPUT_RELATED",
        "T_OUTSIDE_DEFAULT_WINDOW": "MONEYNESS_OR_T_FILTER",
        "NONPOSITIVE_VOLUME;NO_EXACT_RATE_DATE": "MULTIPLE_REASONS",
        "NO_OBSERVABLE_DEFAULT_FAILURE_REASON": "NO_OBSERVABLE_REASON",
        "NONPOSITIVE_OPEN_INTEREST": "NONPOSITIVE_OPEN_INTEREST_ONLY",
        "ASK_NOT_ABOVE_BID": "OTHER_OBSERVABLE_REASON",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.c for r in df.select("s", X.reason_category("s").alias("c")).collect()} == cases


def test_missing_values_break_rules(spark):
    df = spark.createDataFrame([(None, 2.0, None, 1, 100.0, 100.0, 0.5, "C")], "b double, a double, v int, o int, s double, k double, t double, c string")
    text = df.select(X.quote_failures("b", "a", "v", "o", "s", "k", "t", "c", F.lit(None).cast("boolean"), Cleaning())).first()[0]
    assert text == "NONPOSITIVE_BID;ASK_NOT_ABOVE_BID;NONPOSITIVE_VOLUME;SPREAD_ABOVE_DEFAULT_MAX;NO_EXACT_RATE_DATE"


def test_tenor_rate_is_linear_and_flat_outside(spark):
    df = spark.createDataFrame([(t, 1.0, 2.0, 3.0, 4.0, 6.0, 12.0) for t in (0.01, 1 / 12, 1.5 / 12, 5 / 12, 0.75, 1.0, 2.0)], "t double, `1M` double, `2M` double, `3M` double, `4M` double, `6M` double, `12M` double").coalesce(1)
    got = [r[0] for r in df.select(N.tenor_rate("t")).collect()]
    assert got == pytest.approx([1.0, 1.0, 1.5, 5.0, 9.0, 12.0, 12.0])


def test_student_p_against_integration(spark):
    def survival(t, nu):
        x = np.linspace(0, t, 200_001)
        c = math.gamma((nu + 1) / 2) / math.sqrt(nu * math.pi) / math.gamma(nu / 2)
        return 1 - 2 * np.trapezoid(c * (1 + x * x / nu) ** (-(nu + 1) / 2), x)

    cases = [(0.7, 1), (1.3, 2), (-2.1, 3), (2.5, 4), (0.4, 9), (1.9, 38), (2.2, 117)]
    df = spark.createDataFrame(cases, "t double, nu int").coalesce(1)
    got = [r[0] for r in df.select(N.student_p("t", "nu")).collect()]
    assert got == pytest.approx([survival(abs(t), nu) for t, nu in cases], abs=1e-9)


def test_exact_quantiles_and_medians(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = {
        "a": rng.normal(size=5001),
        "b": rng.integers(0, 4, size=3000).astype(float),
        "c": np.array([2.5]),
        "d": np.r_[np.full(2000, 1.0), rng.uniform(1.0, 2.0, 2000)],
        "e": np.full(700, -3.0),
        None: rng.normal(size=40),
    }
    table = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(table, "k string, v double").repartition(5)
    wanted = {"q00": 0.0, "q10": 0.1, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    for sketch, finer in ((8, 32), (64, 512)):
        monkeypatch.setattr(sizing, "FINE_SKETCH", finer)
        out = {r.k: r for r in exact_quantiles(df, ["k"], "v", wanted, sketch=sketch).collect()}
        for k, vs in values.items():
            assert [out[k][name] for name in wanted] == pytest.approx(list(np.quantile(vs, list(wanted.values()))), abs=1e-12)
        assert set(out) == {*values, "empty"} and out["empty"].q50 is None
    medians = {r.k: (r.m, r.n) for r in median_by(df, ["k"], "v", "m", "n").collect()}
    for k, vs in values.items():
        assert medians[k] == (pytest.approx(np.median(vs), abs=1e-12), len(vs) + (k == "a"))
    assert exact_quantiles(df.limit(0), ["k"], "v", wanted).collect() == []


def test_keys_too_many_to_broadcast_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 3)
    rng = np.random.default_rng(4)
    values = {k: rng.normal(size=3000 if k == 0 else 100) for k in range(12)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k int, v double")
    out = {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.3}, sketch=16).collect()}
    assert out == {k: pytest.approx(np.quantile(vs, 0.3), abs=1e-12) for k, vs in values.items()}
