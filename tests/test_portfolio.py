"""Books, controls and inference on random data, each recomputed here row by row in plain Python."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smilegrid.operators import checks, pnl, risk, robustness, signals, stats
from smilegrid.settings import STATE_PAIRS, STATES, TRADED_MODELS

FIRST = dt.date(2022, 11, 7)
QUOTES = ("entry_bid", "entry_ask", "exit_bid", "exit_ask")
GREEKS = ("Delta", "Gamma", "Vega", "Theta")


def day(n):
    return FIRST + dt.timedelta(days=n)


def book(seed, per_day=7, days=3):
    """Positions of two models: one dict per contract held."""
    rng = np.random.default_rng(seed)
    rows = []
    for model, n in itertools.product(("ridge", "xgboost"), range(days)):
        move = rng.normal(0, 3)
        for k in range(per_day):
            low, later = rng.uniform(1, 40, 2)
            rows.append(
                {
                    "model": model,
                    "entry_date": day(3 * n),
                    "decision_date": day(3 * n - 1),
                    "intended_exit_date": day(3 * n + 2),
                    "contract_key": f"c{k}",
                    "underlying_symbol": "SPX",
                    "signed_weight": float((-1) ** k * rng.uniform(0.01, 0.4)),
                    "entry_bid": float(low),
                    "entry_ask": float(low + rng.uniform(0, 2)),
                    "exit_bid": float(later),
                    "exit_ask": float(later + rng.uniform(0, 2)),
                    "entry_spot": 80.0 + n,
                    "exit_spot": float(80.0 + n + move),
                    **{f"entry_{g}": float(rng.uniform(0.1, 9) * (1 if g == "Vega" else rng.choice([-1, 1]))) for g in GREEKS},
                }
            )
    return rows


def frame(spark, rows):
    kinds = {dt.date: "date", float: "double", str: "string", int: "long"}
    names = list(rows[0])
    kind = {c: next((kinds[type(r[c])] for r in rows if r[c] is not None), "double") for c in names}
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} {kind[c]}" for c in names))


def valued(spark, rows):
    return pnl.contract_pnl(frame(spark, rows).withColumn("weight_at_entry", F.col("signed_weight")))


def results(r):
    """Midpoint and executed result and premium of one position."""
    w = r["signed_weight"]
    mid_in, mid_out = (r["entry_bid"] + r["entry_ask"]) / 2, (r["exit_bid"] + r["exit_ask"]) / 2
    paid, got = (r["entry_ask"], r["exit_bid"]) if w > 0 else (r["entry_bid"], r["exit_ask"])
    return {"mid": w * (mid_out - mid_in), "exec": w * (got - paid), "premium": abs(w) * mid_in, "premium_exec": abs(w) * paid}


def by_day(rows):
    out = {}
    for r in rows:
        out.setdefault((r["model"], r["entry_date"]), []).append(r)
    return out


def test_positions_are_valued_at_midpoints_and_at_the_touch(spark):
    rows = book(1)
    found = {(r.model, r.entry_date, r.contract_key): r for r in valued(spark, rows).collect()}
    for r in rows:
        got, want = found[r["model"], r["entry_date"], r["contract_key"]], results(r)
        assert [got.pnl_mid, got.pnl_exec] == pytest.approx([want["mid"], want["exec"]])
        assert [got.gross_entry_premium_mid_component, got.gross_entry_premium_exec_component] == pytest.approx([want["premium"], want["premium_exec"]])
        half = [abs(r["signed_weight"]) * (r[f"{at}_ask"] - r[f"{at}_bid"]) / 2 for at in ("entry", "exit")]
        assert [got.entry_spread_cost, got.exit_spread_cost] == pytest.approx(half)
        assert want["mid"] - want["exec"] == pytest.approx(sum(half))


def scales(positions):
    sides = [sum(abs(r["signed_weight"]) * r["entry_Vega"] for r in positions if r["signed_weight"] * s > 0) for s in (1, -1)]
    return [min(sides) / side for side in sides]


def test_vega_balance_scales_the_larger_side_down(spark):
    rows = book(2)
    controls = risk.entry_controls(frame(spark, rows))
    found = {(r.model, r.entry_date): r for r in controls.collect()}
    for key, positions in by_day(rows).items():
        assert [found[key].a_L, found[key].a_S] == pytest.approx(scales(positions)) and max(scales(positions)) == 1.0
        for g in GREEKS:
            assert found[key][f"Net{g}"] == pytest.approx(sum(r["signed_weight"] * r[f"entry_{g}"] for r in positions))
        assert found[key].hedge_quantity == -found[key].NetDelta
    balanced = risk.vega_weights(frame(spark, rows), controls).groupBy("model", "entry_date").agg(F.sum(F.col("w_vega") * F.col("entry_Vega")).alias("net"))
    assert all(abs(r.net) < 1e-9 for r in balanced.collect())


@pytest.mark.parametrize("bad", [None, -0.5, 0.0, math.nan, -math.inf])
def test_one_bad_vega_closes_the_balance_of_its_day_only(spark, bad):
    rows = book(3)
    broken = rows[4] | {"entry_Vega": bad}
    open_days = {(r.model, r.entry_date): r.vega_balance_available for r in risk.entry_controls(frame(spark, rows[:4] + [broken] + rows[5:])).collect()}
    assert [k for k, ok in open_days.items() if not ok] == [(broken["model"], broken["entry_date"])]


def test_a_book_of_longs_has_no_balance(spark):
    longs = [r | {"signed_weight": abs(r["signed_weight"])} for r in book(4)]
    assert not any(r.vega_balance_available for r in risk.entry_controls(frame(spark, longs)).collect())


def baseline(spark, rows):
    out = []
    for (model, entry), positions in by_day(rows).items():
        each = [results(r) for r in positions]
        sums = [sum(x[c] for x in each) for c in ("mid", "exec", "premium", "premium_exec")]
        out.append((model, entry, entry, entry, *sums, sums[0] / sums[2], sums[1] / sums[3], len(each)))
    return spark.createDataFrame(
        out,
        "model string, entry_date date, decision_date date, exit_date date, PnL_mid double, PnL_exec double, GrossPremium_mid double, GrossPremium_exec double, Return_mid double, Return_exec double, number_contracts long",
    )


def states(spark, rows):
    contracts = valued(spark, rows)
    out = risk.portfolio_states(contracts, risk.entry_controls(contracts), risk.spot_by_day(contracts), baseline(spark, rows))
    return {(r.model, r.entry_date, r.portfolio_state): r for r in out.collect()}


def test_four_states_add_up(spark):
    rows = book(5)
    found = states(spark, rows)
    assert len(found) == 6 * 4
    for key, positions in by_day(rows).items():
        long, short = scales(positions)
        for state in STATES:
            kept = [long if r["signed_weight"] > 0 else short for r in positions] if state.startswith("VEGA") else [1.0] * len(positions)
            mid = sum(k * results(r)["mid"] for k, r in zip(kept, positions, strict=True))
            premium = sum(k * results(r)["premium"] for k, r in zip(kept, positions, strict=True))
            if state.endswith("DELTA_NEUTRAL"):
                delta = sum(k * r["signed_weight"] * r["entry_Delta"] for k, r in zip(kept, positions, strict=True))
                mid -= delta * (positions[0]["exit_spot"] - positions[0]["entry_spot"])
            got = found[*key, state]
            assert [got.PnL_mid, got.GrossPremium_mid, got.Return_mid] == pytest.approx([mid, premium, mid / premium])


def test_days_that_cannot_be_controlled_stay_without_results(spark):
    rows = book(6)
    rows[0]["entry_Vega"] = None  # no balance on the first day
    rows[-1]["exit_spot"] += 0.01  # spots disagree on the last one
    found = states(spark, rows)
    first, last = (rows[0]["model"], rows[0]["entry_date"]), (rows[-1]["model"], rows[-1]["entry_date"])
    shut = {k for k, r in found.items() if not r.available}
    assert shut == {(*first, s) for s in STATES if s.startswith("VEGA")} | {(*last, s) for s in STATES if s.endswith("DELTA_NEUTRAL")}
    assert all(found[k].PnL_mid is None and found[k].Return_exec is None for k in shut)
    spot = {(r.model, r.entry_date): r for r in risk.spot_by_day(valued(spark, rows)).collect()}[last]
    assert spot.S_exit is None and spot.S_entry == rows[-1]["entry_spot"] and not spot.spot_valid


def test_unavailable_days_count_in_the_share_not_in_the_sample(spark):
    rng = np.random.default_rng(7)
    rows = [("ridge", s, day(n), n % k != 1, float(rng.normal()), 5) for s, k in zip(STATES, (99, 2, 3, 5)) for n in range(30)]
    df = spark.createDataFrame(rows, "model string, portfolio_state string, entry_date date, available boolean, x double, number_contracts long")
    df = df.withColumns({f"{c}_{i}": F.when(F.col("available"), F.col("x") / 100) for c in ("Return", "PnL", "GrossPremium") for i in ("mid", "exec")})
    out = {r.portfolio_state: r for r in pnl.performance(df, ["model", "portfolio_state"], with_bootstrap=False).where("implementation = 'MID'").collect()}
    for state in STATES:
        live = [r[3] for r in rows if r[1] == state]
        assert out[state].n_days == sum(live) and out[state].unavailable_day_pct == pytest.approx(100 * (1 - sum(live) / 30))


def test_theta_runs_on_the_calendar(spark):
    rows = [r | {"intended_exit_date": r["entry_date"] + dt.timedelta(days=n)} for r, n in zip(book(8, per_day=5, days=1), (1, 2, 3, 4, 5) * 2)]
    more = {"strike": 80.0, "option_type": "C", "entry_T": 0.3, "entry_r": 0.01, "entry_q": 0.0, "entry_implied_vol": 0.2, "exit_quote_source": "NONE"}
    contracts = pnl.contract_pnl(
        frame(spark, [r | more for r in rows]).withColumns(
            {"weight_at_entry": F.col("signed_weight"), "entry_source_observation_count": F.lit(1), "all_entry_greeks_finite": F.lit(True), "entry_greeks_quality_valid": F.lit(True)}
        )
    )
    none = spark.createDataFrame([], "quote_date date, contract_key string, implied_vol double, T double, r double, q double, mid double, bid double, ask double, source_observation_count long")
    found = {(r.model, r.contract_key): r for r in risk.attribution(contracts, risk.spot_by_day(contracts), none).collect()}
    for r in rows:
        got = found[r["model"], r["contract_key"]]
        days = (r["intended_exit_date"] - r["entry_date"]).days
        assert got.Theta_component == pytest.approx(r["signed_weight"] * r["entry_Theta"] * days / 365)
        assert got.Delta_component == pytest.approx(r["signed_weight"] * r["entry_Delta"] * (r["exit_spot"] - r["entry_spot"]))
        assert got.Vega_component is None and got.DGT_residual == pytest.approx(got.pnl_mid - got.Delta_component - got.Gamma_component - got.Theta_component)


# ------------------------------------------------------------------ signals


def cross_section(spark, seed, nodes=70):
    rng = np.random.default_rng(seed)
    rows = []
    for n in range(nodes):
        near, far = rng.uniform(0.1, 0.4, 3), rng.uniform(0.1, 0.4, 3)
        rows.append((day(0), day(1), day(2), f"n{n:02d}", float(n), 0.3, 0.2, "a", "b", *map(float, near), *map(float, far)))
    names = "decision_date date, entry_date date, intended_exit_date date, node string, log_moneyness double, T double, observed_iv_at_decision double, moneyness_region string, maturity_region string, "
    return rows, spark.createDataFrame(rows, names + ", ".join(f"forecast_{m}_h{h} double" for h in (1, 2) for m in TRADED_MODELS))


def test_selection_against_a_plain_ranking(spark):
    rows, df = cross_section(spark, 11)
    found = {(r.model, r.node): (r.signal, r.selection_rank) for r in signals.rank_signals(signals.candidates(df)).collect()}
    for k, model in enumerate(TRADED_MODELS):
        change = np.array([r[12 + k] - r[9 + k] for r in rows])
        z = (change - change.mean()) / change.std(ddof=1)
        for side in (1, -1):
            order = [i for i in np.argsort(-side * z) if side * z[i] >= 0.5]
            for rank, i in enumerate(order, 1):
                assert found[model, rows[i][3]] == (side if rank <= 10 else 0, rank)


def test_selection_does_not_read_outcomes_and_needs_spread(spark):
    _, df = cross_section(spark, 12)
    ready = signals.candidates(df)
    noisy = ready.withColumns({c: F.rand(3) * 1e6 for c in ("actual_iv_entry", "actual_iv_exit", "actual_holding_change")})
    assert checks.same_frames("selection", signals.rank_signals(ready), signals.rank_signals(noisy)).first().status == "PASS"
    level = ready.withColumn(f"forecast_{TRADED_MODELS[0]}_holding_change", F.lit(-0.02))
    flat = signals.rank_signals(level).where(F.col("model") == TRADED_MODELS[0])
    assert {(r.z_score, r.signal, r.selection_rank) for r in flat.collect()} == {(0.0, 0, None)}


def test_netting_sums_signed_weights_per_contract(spark):
    rng = np.random.default_rng(13)
    rows = [("ridge", day(1), f"c{rng.integers(6)}", "MAPPED", float(s) / 8, int(s), f"n{n:02d}") for n, s in enumerate(rng.choice([-1, 1], 40))]
    df = spark.createDataFrame(rows, "model string, entry_date date, contract_key string, entry_mapping_status string, weight_at_entry double, signal int, node string")
    for r in signals.net_contracts(df).collect():
        own = [x for x in rows if x[2] == r.contract_key]
        total = sum(x[4] for x in own)
        assert r.weight_at_entry == total and r.nonzero_net_position == (total != 0) and r.node_gross_weight == len(own) / 8
        assert r.opposing_signals == (len({x[5] for x in own}) == 2) and r.mapped_nodes == ";".join(sorted(x[6] for x in own))


# ------------------------------------------------------------------ inference


def series(spark, values, key="k"):
    return spark.createDataFrame([(key, day(i), v) for i, v in enumerate(values)], "key string, day date, x double")


def test_wealth_compounds_from_one_and_stops_at_ruin(spark):
    x = np.random.default_rng(14).normal(-0.01, 0.1, 40)
    paths = stats.return_paths(series(spark, x.tolist()), ["key"], "x", "day").orderBy("day").collect()
    wealth = np.cumprod(1 + x)
    peak = np.maximum.accumulate(np.concatenate([[1.0], wealth]))[1:]
    assert [r.wealth for r in paths] == pytest.approx(wealth.tolist()) and [r.drawdown for r in paths] == pytest.approx((wealth / peak - 1).tolist())
    for spoiled in (-1.0, -3.5, None, math.nan):
        again = x.tolist()[:9] + [spoiled]
        assert {r.wealth for r in stats.return_paths(series(spark, again), ["key"], "x", "day").collect()} == {None}


def test_hac_is_a_weighted_quadratic_form(spark):
    rng = np.random.default_rng(15)
    x = np.convolve(rng.normal(size=50), [1, 0.6, 0.3], "valid")
    for lag in (0, 3, 7):
        n = len(x)
        kernel = np.maximum(0, 1 - np.abs(np.subtract.outer(np.arange(n), np.arange(n))) / (lag + 1))
        u = x - x.mean()
        row = stats.hac_test(series(spark, x.tolist()), ["key"], "x", "day", lag).first()
        assert row.HAC_standard_error == pytest.approx(math.sqrt(u @ kernel @ u / n / (n - 1)), rel=1e-10)


def test_adjusted_p_values_follow_their_definitions(spark):
    for seed in (16, 17):
        p = np.random.default_rng(seed).choice([0.001, 0.01, 0.02, 0.02, 0.3, 0.7, 1.0], 9)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, raw_p double").withColumn("f", F.lit(1))
        out = stats.with_adjusted_p(df, ["f"], tie=["i"]).orderBy("i").collect()
        order = sorted(range(9), key=lambda i: (p[i], i))
        place = {i: k for k, i in enumerate(order, 1)}
        for i in range(9):
            holm = max(min(1.0, (9 - place[j] + 1) * p[j]) for j in range(9) if place[j] <= place[i])
            rate = min(min(1.0, 9 * p[j] / place[j]) for j in range(9) if place[j] >= place[i])
            assert [out[i].holm_adjusted_p, out[i].BH_adjusted_p] == pytest.approx([holm, rate])


@pytest.mark.parametrize("bad", [1.0001, -1e-9, None, math.nan])
def test_families_of_improper_p_values_are_refused(spark, bad):
    df = spark.createDataFrame([(0.5, 1), (bad, 1)], "raw_p double, f int")
    with pytest.raises(Exception, match="outside 0 to 1"):
        stats.with_adjusted_p(df, ["f"]).collect()


def test_pairs_are_compared_on_shared_dates(spark):
    rng = np.random.default_rng(18)
    held = {m: {n: (float(rng.normal()), float(rng.normal())) for n in range(40) if rng.random() < 0.8} for m in TRADED_MODELS}
    rows = [(m, day(n), *v) for m, days in held.items() for n, v in days.items()]
    df = spark.createDataFrame(rows, "model string, entry_date date, Return_mid double, Return_exec double")
    found = pnl.pairwise_returns(df).collect()
    assert len(found) == 6
    for r in found:
        shared = held[r.model_A].keys() & held[r.model_B].keys()
        side = 0 if r.implementation == "MID" else 1
        want = np.mean([held[r.model_A][n][side] - held[r.model_B][n][side] for n in shared])
        assert r.n_inference_dates == len(shared) and r.mean_difference == pytest.approx(want)


@pytest.mark.parametrize("total", [-7.0, 0.0, 12.0])
def test_cost_share_needs_a_gain_to_lose_from(spark, total):
    df = spark.createDataFrame([("ridge", total, total - 3, 1.25, 1.75, 3.0, 0.2)], "model string, PnL_mid double, PnL_exec double, entry_spread_cost double, exit_spread_cost double, cost_wedge_pnl double, cost_wedge_return double")
    assert pnl.cost_wedge(df).first().fraction_midpoint_economic_value_lost == (0.25 if total > 0 else None)


# ------------------------------------------------------------------ robustness


def hedged_days(spark, seed, drift):
    rng = np.random.default_rng(seed)
    rows = []
    for n in range(25):
        gain, premium = float(drift + rng.normal(0, 0.1)), float(rng.uniform(5, 30))
        rows.append(("ridge", day(n), "DELTA_NEUTRAL", float(rng.normal()), gain, premium, gain / premium, gain - 0.1, premium + 0.2))
    df = spark.createDataFrame(rows, "model string, entry_date date, portfolio_state string, hedge_quantity double, PnL_mid double, GrossPremium_mid double, Return_mid double, PnL_exec double, GrossPremium_exec double")
    return df, spark.createDataFrame([("ridge", day(n), 50.0 + n) for n in range(25)], "model string, entry_date date, S_entry double")


def test_results_vanish_at_the_break_even_cost(spark):
    days = hedged_days(spark, 19, 1.0)
    even = robustness.hedge_break_even(*days).first()
    at_mean, at_total = (robustness.hedge_stress(*days, bps=[b]).first() for b in (even.break_even_bps_per_side, even.aggregate_break_even_bps_per_side))
    assert at_mean.mean_MID_after_hypothetical_cost == pytest.approx(0, abs=1e-12) and even.positive_mean_friction_budget
    assert at_total.total_MID_pnl_after_hypothetical_cost == pytest.approx(0, abs=1e-9)
    assert even.break_even_bps_round_trip == 2 * even.break_even_bps_per_side
    loss = robustness.hedge_break_even(*hedged_days(spark, 20, -1.0)).first()
    assert (loss.break_even_bps_per_side, loss.aggregate_break_even_bps_per_side, loss.positive_mean_friction_budget) == (0.0, 0.0, False)


def test_normalisation_uses_one_denominator_for_both(spark):
    df, _ = hedged_days(spark, 21, 0.4)
    rows = df.collect()
    base = [(r.model, r.entry_date, r.GrossPremium_mid * 1.5, r.GrossPremium_exec * 2) for r in rows]
    df = df.withColumn("Return_exec", F.col("PnL_exec") / F.col("GrossPremium_exec"))
    found = {r.implementation: r for r in robustness.normalisation(df, spark.createDataFrame(base, "model string, entry_date date, GrossPremium_mid double, GrossPremium_exec double")).collect()}
    for name, s in (("MID", "mid"), ("BID_ASK", "exec")):
        gains, own = [r[f"PnL_{s}"] for r in rows], [r[f"GrossPremium_{s}"] for r in rows]
        assert found[name].mean_Return_common_denom == pytest.approx(np.mean([g / b[2] for g, b in zip(gains, base, strict=True)]))
        assert found[name].primary_mean_daily_ratio == pytest.approx(np.mean(np.divide(gains, own)))
        assert found[name].pooled_premium_return == pytest.approx(sum(gains) / sum(own))


def state_panel(spark, days, missing=()):
    rng = np.random.default_rng(22)
    rows = [("xgboost", day(n), s, None if (n, s) in missing else float(rng.normal(0, 0.02))) for n in range(days) for s in STATES]
    return spark.createDataFrame(rows, "model string, entry_date date, portfolio_state string, Return_mid double")


def test_paired_tests_take_the_whole_panel_or_none(spark):
    full = state_panel(spark, 26)
    wide = {(r.entry_date, r.portfolio_state): r.Return_mid for r in full.collect()}
    found = {(r.target_state, r.reference_state): r for r in robustness.paired_effects(full, expected_days=26, with_bootstrap=False).collect()}
    assert set(found) == set(STATE_PAIRS)
    for (a, b), r in found.items():
        assert r["mean"] == pytest.approx(np.mean([wide[day(n), a] - wide[day(n), b] for n in range(26)]))
    for panel, days in ((state_panel(spark, 26, {(4, STATES[2])}), 26), (full, 27), (full, 25)):
        with pytest.raises(Exception, match="complete"):
            robustness.paired_effects(panel, expected_days=days, with_bootstrap=False).collect()


def test_regimes_split_at_the_median_before_the_cutoff(spark):
    rng = np.random.default_rng(23)
    iv = rng.uniform(0.1, 0.5, (30, 5))
    rows = [(day(n), f"n{k}", float(iv[n, k])) for n in range(30) for k in range(5)]
    surface = spark.createDataFrame(rows, "quote_date date, node string, iv_grid double")
    decisions = surface.select(F.col("quote_date").alias("decision_date")).distinct().where(F.col("quote_date") > day(17))
    middle = np.median(np.median(iv, axis=1)[:18])
    labels = {r.decision_date: r.IV_regime for r in robustness.iv_regimes(decisions, robustness.iv_levels(surface), day(17)).collect()}
    assert labels == {day(n): "LOW_IV" if np.median(iv[n]) <= middle else "HIGH_IV" for n in range(18, 30)}
    scrambled = surface.withColumn("iv_grid", F.when(F.col("quote_date") > day(17), 7.0 - F.col("iv_grid")).otherwise(F.col("iv_grid")))
    assert robustness.regime_threshold(robustness.iv_levels(scrambled), day(17)).first().threshold == pytest.approx(middle)
    with pytest.raises(Exception, match="decision date"):
        robustness.iv_regimes(spark.createDataFrame([(day(99),)], "decision_date date"), robustness.iv_levels(surface), day(17)).collect()


def test_coverage_check_fails_when_one_exit_is_missing(spark):
    active = spark.createDataFrame([(True,), (True,)], "BASE boolean")
    count = lambda df: checks._count(df, "coverage", ~F.coalesce(F.col("BASE"), F.lit(False))).first()
    assert (count(active).violations, count(active).status) == (0, "PASS")
    for missing in (False, None):
        broken = active.unionByName(spark.createDataFrame([(missing,)], "BASE boolean"))
        assert (count(broken).violations, count(broken).status) == (1, "FAIL")


def test_contribution_puts_a_spread_at_the_limit_inside(spark):
    spreads = [(1.05 - 0.95) / 1.0, (1.1 - 0.9) / 1.0, 0.2000001]
    assert spreads[0] > 0.1 and spreads[1] > 0.2
    rows = [("m", s, "PROCESSED_1545", None, 1.0, False, False, True, 1.0, 1.0, 0.1, 0.1) for s in spreads]
    names = "model string, relative_exit_spread double, exit_quote_source string, raw_trade_volume double, exit_quote_trade_volume double, STRICT_20 boolean, STRICT_10 boolean, POSITIVE_VOLUME boolean, pnl_mid double, pnl_exec double, entry_spread_cost double, exit_spread_cost double"
    found = {r.bucket: r.n_contracts for r in pnl.contribution(spark.createDataFrame(rows, names), quality=True).collect()}
    assert (found["spread_le_10"], found["spread_10_to_20"], found["spread_gt_20"]) == (1, 1, 1)
