import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from smilegrid.operators import arma, boosting, checks, features, models, stats
from smilegrid.settings import Splits

D = dt.date


def series(spark, values, key="k"):
    rows = [(key, D(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, day date, x double")


def test_bootstrap_sums_against_explicit_resampling(spark):
    import hashlib

    x = np.random.default_rng(7).normal(0.01, 0.1, 23)
    for block in (5, 10, 40):
        got = {r.rep: r.x for r in stats.resampled_sums(series(spark, [float(v) for v in x]), ["key"], ["x"], "day", block, 20).collect()}
        for rep in range(20):
            places = []
            for k in range(-(-23 // block)):
                start = int(hashlib.md5(f"42-{rep}-{k}".encode()).hexdigest()[:8], 16) % 23
                places += [(start + j) % 23 for j in range(block)]
            assert got[rep] == pytest.approx(x[places[:23]].sum(), abs=1e-12)


def test_validated_join_rejects_duplicates_and_unmatched(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    right = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, b double")
    with pytest.raises(checks.DuplicateKeys):
        checks.validated_join(left, right, ["k"])
    with pytest.raises(Exception, match="unmatched"):
        checks.validated_join(left, right.limit(1), ["k"], matched=True).collect()


def test_table_diff_reports_cells(spark):
    a = spark.createDataFrame([("m", 1.0, None), ("n", 2.0, 3.0)], "model string, x double, y double")
    b = spark.createDataFrame([("m", 1.0, None), ("n", 2.5, 3.0)], "model string, x double, y double")
    out = {r.result_name: r.status for r in checks.table_diff(a, b, ["model"]).collect()}
    assert out["x[model=n]"] == "FAIL" and [v for k, v in out.items() if k != "x[model=n]"] == ["PASS"] * 4


def business_days(n):
    out, d = [], D(2024, 1, 2)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def walk(n=100, gaps=(12, 72)):
    x = 0.2 + np.cumsum(np.random.default_rng(4).normal(0, 0.002, n))
    x[list(gaps)] = np.nan
    return x


@pytest.mark.parametrize("order", [(1, 0, 0), (2, 0, 0), (1, 1, 0), (1, 0, 1), (2, 0, 1)])
def test_two_step_forecast_ignores_what_follows(order):
    x = walk()
    params = arma.two_step(x[:60], order)
    full = arma.run(x[None], params[None], order, 2)[1][0, 70]
    cut = x.copy()
    cut[71:] = np.nan
    assert arma.run(cut[None], params[None], order, 2)[1][0, 70] == pytest.approx(full, abs=1e-12)


def test_first_order_forecast_is_the_coefficient_times_the_value():
    x = walk(gaps=())
    phi = arma.two_step(x[:60], (1, 0, 0))
    assert phi[0] == pytest.approx((x[1:60] @ x[:59]) / (x[:59] @ x[:59]))
    forecast = lambda order, params: arma.run(x[None], np.array([params]), order, 1)[1][0, 70]
    assert forecast((1, 0, 0), phi) == pytest.approx(phi[0] * x[70], abs=1e-9)
    step = arma.two_step(x[:60], (1, 1, 0))
    assert forecast((1, 1, 0), step) == pytest.approx(x[70] + step[0] * (x[70] - x[69]), abs=1e-5)


def simulated(order, params, n, seed, gone=0.0):
    """Series of an ARMA process, about `gone` of the values missing."""
    rng = np.random.default_rng(seed)
    p, d, q = order
    e, w = rng.normal(size=n + 50), np.zeros(n + 50)
    for t in range(2, n + 50):
        w[t] = sum(params[i] * w[t - 1 - i] for i in range(p)) + e[t] + sum(params[p + i] * e[t - 1 - i] for i in range(q))
    x = (3 + w[50:].cumsum() if d else w[50:]) * 0.01
    x[rng.random(n) < gone] = np.nan
    return x


def dense_likelihood(x, params, order):
    """Log-likelihood with the shock variance concentrated out, from the covariance matrix of what was observed."""
    p, d, q = order
    ar = np.r_[1.0, -np.array(params[:p])]
    psi = np.zeros(4000)
    ma = np.r_[1.0, params[p:], np.zeros(4000)]
    for i in range(4000):
        psi[i] = ma[i] - sum(ar[j] * psi[i - j] for j in range(1, min(i, p) + 1))
    gamma = np.array([psi[: 4000 - k] @ psi[k:] for k in range(len(x))])
    cov = gamma[np.abs(np.subtract.outer(np.arange(len(x)), np.arange(len(x))))]
    there = np.isfinite(x)
    if d:  # differences between observed values, as sums of the process
        at = np.flatnonzero(there)
        sums = np.zeros((len(at) - 1, len(x)))
        for i, (a, b) in enumerate(zip(at, at[1:])):
            sums[i, a + 1 : b + 1] = 1
        cov, v = sums @ cov @ sums.T, np.diff(x[at])
    else:
        cov, v = cov[np.ix_(there, there)], x[there]
    n = len(v)
    return -0.5 * (n * (np.log(2 * np.pi * (v @ np.linalg.solve(cov, v)) / n) + 1) + np.linalg.slogdet(cov)[1])


CASES = [((1, 0, 0), [0.7]), ((2, 0, 0), [0.5, 0.3]), ((1, 1, 0), [0.4]), ((1, 0, 1), [0.8, -0.4]), ((2, 0, 1), [0.9, -0.2, 0.5])]


@pytest.mark.parametrize("order,params", CASES)
def test_filter_likelihood_against_the_covariance_matrix(order, params):
    for gone in (0.0, 0.3):
        x = simulated(order, params, 60, 3, gone)
        got = arma.run(x[None], np.array([params]), order)[0][0]
        assert got == pytest.approx(dense_likelihood(x, params, order), abs=1e-3 if order[1] else 1e-6)


@pytest.mark.parametrize("order,params", CASES)
def test_likelihood_fits_are_best(order, params):
    series = np.array([simulated(order, params, 300, s, 0.1 * (s % 3)) for s in range(8)] + [np.full(300, np.nan)])
    found, loglik, fitted = arma.fit(series, order)
    assert fitted.tolist() == [True] * 8 + [False]
    assert np.allclose(arma.run(series[:8], found[:8], order)[0], loglik[:8])
    start = np.array([arma.two_step(s, order) for s in series[:8]])
    inside = arma.coefficients(arma.free_numbers(start, order), order)
    assert (loglik[:8] >= arma.run(series[:8], inside, order)[0] - 1e-9).all()
    rng = np.random.default_rng(0)
    for _ in range(30):  # no place nearby is better
        near = arma.coefficients(arma.free_numbers(found[:8], order) + rng.normal(scale=0.05, size=found[:8].shape), order)
        assert (arma.run(series[:8], near, order)[0] <= loglik[:8] + 1e-3).all()
    assert np.abs(found[:8].mean(axis=0) - params).max() < 0.15


def test_first_order_fit_equals_a_direct_maximisation():
    x = simulated((1, 0, 0), [0.6], 120, 9, 0.2)
    found = arma.fit(x[None], (1, 0, 0))[0][0, 0]
    grid = np.linspace(-0.999, 0.999, 4001)
    direct = grid[np.argmax([dense_likelihood(x, [g], (1, 0, 0)) for g in grid[::40]]) * 40]
    fine = np.linspace(direct - 0.02, direct + 0.02, 81)
    direct = fine[np.argmax([dense_likelihood(x, [g], (1, 0, 0)) for g in fine])]
    assert found == pytest.approx(direct, abs=1e-3)


def panel(spark, n=120):
    days = business_days(n)
    rows = [(d, node, None if np.isnan(v) else float(v)) for node, shift in (("p", 0.0), ("q", 0.05)) for d, v in zip(days, walk(n) + shift)]
    df = spark.createDataFrame(rows, "quote_date date, node string, iv_grid double")
    from smilegrid.operators.calendar import calendar_table

    calendar = calendar_table(spark.createDataFrame([(d, True) for d in days], "session date, is_1545_open boolean"))
    return df, calendar, Splits(train_end=days[70], fit_end=days[100], min_train=40, min_validation=10, min_arma_train=40)


def test_purged_validation_window(spark):
    df, calendar, splits = panel(spark)
    for h in (1, 2):
        masked = features.split_masks(features.lag_features(df, calendar, h), splits)
        row = masked.agg(
            F.min(F.when(F.col("is_validation"), F.col("quote_date"))).alias("a"),
            F.max(F.when(F.col("is_train"), F.col("target_date"))).alias("b"),
            F.max(F.when(F.col("is_final"), F.col("target_date"))).alias("c"),
        ).first()
        assert row.a >= splits.train_end and row.b <= splits.train_end and row.c <= splits.fit_end


def test_ridge_matches_a_direct_solution(spark):
    df, calendar, splits = panel(spark)
    masked = features.split_masks(features.lag_features(df, calendar, 1), splits)
    fit = masked.where("is_final AND node = 'p'").orderBy("quote_date").toPandas()
    raw = fit[features.FEATURES].to_numpy(dtype=float)
    x = np.hstack([np.where(np.isnan(raw), np.nanmedian(raw, axis=0), raw), np.isnan(raw).astype(float)])
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / scale])
    penalty = np.diag([0.0] + [10.0] * x.shape[1])
    beta = np.linalg.solve(z.T @ z + penalty, z.T @ fit["label"].to_numpy())
    fits = models.ridge_fits(masked.where("is_final"), (10.0,))
    got = models.ridge_predict(masked.where("is_final AND node = 'p'"), fits).orderBy("quote_date").toPandas()["prediction"]
    np.testing.assert_allclose(got.to_numpy(), z @ beta, atol=1e-10)


def test_forecasts_need_history(spark):
    df, calendar, splits = panel(spark)
    masked = features.split_masks(features.lag_features(df, calendar, 1), splits)
    ready = models.ridge_forecast(masked, splits)
    assert ready.where("forecast IS NULL").count() == 0 and {r.status for r in ready.select("status").distinct().collect()} == {"OK"}
    starved = models.ridge_forecast(masked, Splits(train_end=splits.train_end, fit_end=splits.fit_end, min_train=500))
    assert {(r.status, r.forecast) for r in starved.select("status", "forecast").distinct().collect()} == {("INSUFFICIENT_HISTORICAL_LABELS", None)}
    arma = models.arma_forecast(df, splits, 2)
    assert arma.where("status = 'OK' AND forecast IS NOT NULL").count() == 240
    short = models.arma_forecast(df, Splits(train_end=splits.train_end, fit_end=splits.fit_end, min_arma_train=500))
    assert {r.status for r in short.select("status").distinct().collect()} == {"INSUFFICIENT_HISTORICAL_LABELS"}


def test_selection_rules(spark):
    rows = [("n", 0, "a", 1.0, 0.5), ("n", 1, "b", 1.0 + 5e-6, 0.4), ("n", 2, "c", float("inf"), 0.1)]
    losses = spark.createDataFrame(rows, "node string, position int, candidate string, rmse double, mae double")
    assert models.select_candidate(losses, ["node"]).first().candidate == "a"
    assert models.select_candidate(losses, ["node"], "near_tie").first().candidate == "b"


def test_registered_boosting_uses_all_rounds(monkeypatch):
    from types import SimpleNamespace

    from smilegrid.catalog import QUERIES, model_cases, registry

    used = {"configs": models.BOOST_CONFIGS}
    monkeypatch.setattr(models, "boosted_forecast", lambda *a, **k: used.update(k))
    monkeypatch.setattr(model_cases, "_masked", lambda m, horizon=1: None)
    monkeypatch.setattr(registry, "market_for", lambda *a: SimpleNamespace(nodes=None))
    monkeypatch.setattr(registry, "tidy", lambda df, *a: df)
    QUERIES["boosted_forecast"](None, "")
    assert used["configs"] == models.BOOST_CONFIGS
    assert [c["maxIter"] for c in models.BOOST_CONFIGS] == [200, 300]


def exhaustive_split(x, g):
    """(gain, feature, limit, missing on the left) of the best split, every limit and side tried."""
    quality = lambda v: v.sum() ** 2 / (len(v) + boosting.PENALTY)
    best = (boosting.LEAST_GAIN, None, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[~np.isnan(x[:, f]), f])
        limits = [*((values[1:] + values[:-1]) / 2), np.inf]
        for limit in limits:
            for side in (False, True):
                left = np.where(np.isnan(x[:, f]), side, x[:, f] < limit)
                if 0 < left.sum() < len(g):
                    gain = 0.5 * (quality(g[left]) + quality(g[~left]) - quality(g))
                    if gain > best[0] + 1e-12:
                        best = (gain, f, limit, side)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_boosted_splits_against_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 4)).round(1)
    x[rng.random(x.shape) < 0.2] = np.nan
    y = np.nan_to_num(x[:, 0]) + np.isnan(x[:, 1]) * 2 + rng.normal(size=60)
    trees = boosting.fit(x, y, 3, 2, 0.3, 1.0, 1.0, 0)
    made = np.full(60, y.mean())
    for k in range(3):
        g = made - y
        gain, f, limit, side = exhaustive_split(x, g)
        assert (trees.feature[k, 0], trees.threshold[k, 0], trees.missing_left[k, 0]) == (f, limit, side)
        left = np.where(np.isnan(x[:, f]), side, x[:, f] < limit)
        for node, rows in ((1, left), (2, ~left)):
            _, f2, limit2, side2 = exhaustive_split(x[rows], g[rows])
            if f2 is None:
                parts = [rows]
            else:
                assert trees.feature[k, node] == f2
                low = np.where(np.isnan(x[:, f2]), trees.missing_left[k, node], x[:, f2] < trees.threshold[k, node])
                want = np.where(np.isnan(x[rows, f2]), side2, x[rows, f2] < limit2)
                assert (low[rows] == want).all() or (low[rows] == ~want).all()  # the same two leaves
                parts = [rows & low, rows & ~low]
            for part in parts:
                made[part] -= 0.3 * g[part].sum() / (part.sum() + boosting.PENALTY)
    np.testing.assert_allclose(trees.predict(x), made, atol=1e-12)


def test_boosted_models_learn_and_repeat():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (400, 3))
    x[:, 2] = np.nan  # a column without any value
    y = np.sin(3 * x[:, 0]) + (x[:, 1] > 0)
    c = models.BOOST_CONFIGS[0]
    fit = lambda: boosting.fit(x, y, c["maxIter"], c["maxDepth"], c["stepSize"], 0.9, 0.9, 7)
    error = np.sqrt(np.mean((fit().predict(x) - y) ** 2))
    assert error < 0.1 * y.std() and np.array_equal(fit().predict(x), fit().predict(x))
    many = boosting.thresholds(rng.normal(size=5000))
    assert len(many) == boosting.MAX_BINS - 1 and (np.diff(many) > 0).all()
    one = boosting.fit(np.full((5, 2), np.nan), np.arange(5.0), 4, 2, 0.5, 1.0, 1.0, 0)
    assert np.allclose(one.predict(np.zeros((2, 2))), 2.0)


def test_boosted_forecast_per_node(spark):
    df, calendar, splits = panel(spark)
    masked = features.split_masks(features.lag_features(df, calendar, 1), splits)
    configs = [{**c, "maxIter": 20} for c in models.BOOST_CONFIGS]
    found = models.boosted_forecast(masked, splits, configs)
    assert found.count() == masked.count() and found.where("status = 'OK' AND forecast IS NULL").count() == 0
    alone = models.boosted_forecast(masked.where("node = 'p'"), splits, configs)
    assert sorted(map(tuple, alone.collect())) == sorted(tuple(r) for r in found.collect() if r.node == "p")
    best = {r.node: r for r in models.select_candidate(models.boosted_losses(masked, configs), ["node"], "near_tie").collect()}
    assert {r.node: r.candidate for r in found.select("node", "candidate").distinct().collect()} == {n: r.candidate for n, r in best.items()}
    starved = models.boosted_forecast(masked, Splits(train_end=splits.train_end, fit_end=splits.fit_end, min_train=500), configs)
    assert {(r.status, r.forecast) for r in starved.select("status", "forecast").distinct().collect()} == {("INSUFFICIENT_HISTORICAL_LABELS", None)}


@pytest.mark.parametrize("count", [2, 4, 30])
def test_confidence_set_against_plain_elimination(spark, count):
    rng = np.random.default_rng(count)
    days = business_days(60)
    values = rng.normal(size=(60, count)) + np.linspace(0, 1, count)
    names = [f"m{i}" for i in range(count)]
    df = spark.createDataFrame([("x", d, *map(float, v)) for d, v in zip(days, values)], "loss string, day date, " + ", ".join(f"{m} double" for m in names))
    found = {r.model: r.p_value for r in stats.model_confidence_set(df, names, "day", 5, 60, 7).collect()}
    draws = stats.resampled_sums(df, ["loss"], names, "day", 5, 60, 7).collect()
    boot = np.array([[r[m] / r.n for m in names] for r in draws])
    bar = values.mean(axis=0)
    dev = (boot[:, :, None] - boot[:, None, :]) - (bar[:, None] - bar[None, :])
    scale = np.sqrt((dev**2).mean(axis=0))
    np.fill_diagonal(scale, 1.0)
    t, left, p = (bar[:, None] - bar[None, :]) / scale, list(range(count)), 0.0
    while len(left) > 1:
        own = np.ix_(left, left)
        widest = np.unravel_index(np.abs(t[own]).argmax(), (len(left),) * 2)
        p = max(p, np.mean(np.abs(dev[:, own[0], own[1]] / scale[own]).max(axis=(1, 2)) > np.abs(t[own]).max()))
        a, b = (left[i] for i in widest)
        worst = a if t[a, b] > 0 else b
        assert found[names[worst]] == pytest.approx(p)
        left.remove(worst)
    assert found[names[left[0]]] == 1.0 and len(found) == count


def test_registered_bootstraps_use_all_draws():
    from smilegrid.catalog import ORACLES
    from smilegrid.catalog.inputs import INFERENCE
    from smilegrid.settings import Inference

    assert INFERENCE == Inference()
    for name in ("circular_block_bootstrap", "paired_state_effects", "paired_bootstrap_sensitivity"):
        assert "range(4000)" in ORACLES[name], name
    for name in ("metric_bootstrap_intervals", "model_confidence_set_block_5", "model_confidence_set_block_10"):
        assert "range(2000)" in ORACLES[name], name
