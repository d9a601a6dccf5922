import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from smilegrid.functions import numeric as N
from smilegrid.functions import text as X
from smilegrid.operators import calendar as cal
from smilegrid.operators import cleaning, delaunay, implied_vol, mapping, nearest, quotes, surface
from smilegrid.settings import DIVIDEND, NO_QUOTE, PROCESSED, RATE_DATE, RECOVERED, TENOR_COLUMNS, Grid
from smilegrid.sources import tables

D = dt.date


def rates(spark, rows):
    names = [RATE_DATE, DIVIDEND, *TENOR_COLUMNS]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'date' if n == RATE_DATE else 'double'}" for n in names))


def test_rate_gaps_are_linear_in_calendar_time(spark):
    t = lambda d, v, q: (D(2024, 1, d), q, *[v] * 6)
    rows = [t(1, None, None), t(2, 1.0, 5.0), t(3, None, None), t(8, 7.0, None), t(9, None, 6.0)]
    out = {r[0].day: (r["1M"], r[DIVIDEND]) for r in cleaning.prepare_rates(rates(spark, rows)).collect()}
    assert out == {1: (1.0, 5.0), 2: (1.0, 5.0), 3: (2.0, 5.0), 8: (7.0, 5.0), 9: (7.0, 6.0)}


def random_day(n, seed):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.uniform(-0.3, 0.3, n), rng.uniform(0.02, 1.2, n)])


def test_delaunay_against_exhaustive_search():
    from itertools import combinations

    p = random_day(25, 1)
    v = np.random.default_rng(2).uniform(size=25)
    targets = random_day(40, 3)

    def exhaustive(q):
        for t in combinations(range(25), 3):
            m = np.column_stack([p[list(t)], np.ones(3)]).T
            w = np.linalg.solve(m, [*q, 1])
            plane = np.linalg.solve(m.T, (p[list(t)] ** 2).sum(axis=1))
            empty = ((p**2).sum(axis=1) - np.column_stack([p, np.ones(25)]) @ plane > -1e-12).all()
            if (w >= -1e-12).all() and empty:
                return w @ v[list(t)]
        return np.nan

    np.testing.assert_allclose(delaunay.interpolate(p, v, targets), [exhaustive(q) for q in targets], atol=1e-12)


def test_heavy_day_gives_the_same_triangulated_surface(spark):
    p = random_day(600, 5)
    v = np.random.default_rng(6).uniform(0.1, 0.4, 600)
    rows = [(D(2024, 1, 2), float(a), float(b), float(c), 1) for (a, b), c in zip(p, v)]
    df = spark.createDataFrame(rows, "quote_date date, log_moneyness double, T double, implied_vol double, n_quotes long")
    direct = {r.node: r.iv_grid for r in delaunay.delaunay_surface(df).collect()}
    heavy = {r.node: r.iv_grid for r in delaunay.delaunay_surface(df, bounded_day=100).collect()}
    assert direct.keys() == heavy.keys() and len(direct) > 400
    assert [heavy[k] for k in direct] == pytest.approx(list(direct.values()), abs=1e-9)


def test_heavy_day_takes_the_same_triangles_of_a_lattice(spark):
    xs, ts = np.log(np.arange(80, 126, 0.5) / 100.0), np.arange(1, 73) * 0.015  # several points a cell
    v = np.random.default_rng(11).uniform(0.1, 0.4, (len(xs), len(ts)))
    rows = [(D(2024, 1, 2), float(x), float(t), float(v[i, j]), 1) for i, x in enumerate(xs) for j, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "quote_date date, log_moneyness double, T double, implied_vol double, n_quotes long")
    direct = {r.node: r.iv_grid for r in delaunay.delaunay_surface(df, bounded_day=10**9).collect()}
    heavy = {r.node: r.iv_grid for r in delaunay.delaunay_surface(df, bounded_day=1).collect()}
    assert direct.keys() == heavy.keys() and len(direct) > 300
    assert [heavy[k] for k in direct] == pytest.approx(list(direct.values()), abs=1e-9)


@pytest.mark.parametrize("ts", [(0.08, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0), tuple(0.08 + 0.92 * i / 11 for i in range(12))])
def test_nodes_on_the_edge_of_the_hull(spark, ts):
    """Expiries at the first and last maturity of the grid put whole rows of nodes on the hull's edge."""
    xs = np.linspace(-0.24, 0.2, 45)
    v = np.random.default_rng(len(ts)).uniform(0.1, 0.4, (len(xs), len(ts)))
    rows = [(D(2024, 1, 2), float(x), float(t), float(v[i, j]), 1) for i, x in enumerate(xs) for j, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "quote_date date, log_moneyness double, T double, implied_vol double, n_quotes long")
    direct = {r.node: r.iv_grid for r in delaunay.delaunay_surface(df, bounded_day=10**9).collect()}
    heavy = {r.node: r.iv_grid for r in delaunay.delaunay_surface(df, bounded_day=1).collect()}
    assert len(direct) == 500 and direct.keys() == heavy.keys()
    assert [heavy[k] for k in direct] == pytest.approx(list(direct.values()), abs=1e-12)
    for j, t in ((0, 0), (len(ts) - 1, 19)):  # along the edge the surface is linear between its neighbours
        along = np.interp(np.linspace(-0.22, 0.18, 25), xs, v[:, j])
        np.testing.assert_allclose([direct[f"iv_x{i:02d}_t{t:02d}"] for i in range(25)], along, atol=1e-9)


def test_triangles_of_any_subset_that_holds_them():
    """Adding points outside the circles of a lattice's nodes, or changing the order, changes nothing."""
    rng = np.random.default_rng(21)
    xs, ts = np.linspace(-0.3, 0.3, 31), np.linspace(0.05, 1.05, 21)
    p = np.array([(x, t) for x in xs for t in ts])
    v = rng.uniform(size=len(p))
    targets = np.vstack([p[rng.choice(len(p), 60)], (p[:-1] + p[1:])[:200] / 2, random_day(100, 4) * [1, 0.8] + [0, 0.1]])
    whole = delaunay.interpolate(p, v, targets)
    order = rng.permutation(len(p))
    np.testing.assert_allclose(delaunay.interpolate(p[order], v[order], targets), whole, atol=1e-12)
    basis, weights = delaunay.triangles(p, targets)
    used = np.unique(basis[(basis >= 3) & (weights > 1e-9)]) - 3
    extra = np.union1d(used, rng.choice(len(p), 60))
    inside = np.isfinite(whole)
    np.testing.assert_allclose(delaunay.interpolate(p[extra], v[extra], targets)[inside], whole[inside], atol=1e-9)


def test_points_on_one_line():
    p = np.array([(0.01 * i, 0.5) for i in range(-5, 6)])
    found = delaunay.interpolate(p, p[:, 0] ** 2, np.array([(0.005, 0.5), (-0.05, 0.5), (0.0, 0.6)]))
    np.testing.assert_allclose(found[:2], [0.00005, 0.0025], atol=1e-12)
    assert np.isnan(found[2])


def test_lattice_triangles_depend_on_their_own_points_only():
    xs, ts = np.log(np.arange(70, 136, 2.5) / 100.0), np.arange(1, 27) / 20.0
    p = np.array([(x, t) for x in xs for t in ts])
    v = np.random.default_rng(12).uniform(size=len(p))
    targets = random_day(200, 13) * [0.5, 0.5] + [0.0, 0.2]
    far = np.array([(3.0, 0.1), (3.1, 4.0), (-4.0, 2.0)])
    np.testing.assert_allclose(
        delaunay.interpolate(p, v, targets), delaunay.interpolate(np.vstack([p, far]), np.r_[v, 1.0, 2.0, 3.0], targets), atol=1e-9
    )


def test_nearest_against_exhaustive_search(spark):
    p, targets = random_day(400, 7), random_day(60, 8)
    points = spark.createDataFrame([(1, f"k{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(p)], "d int, key string, log_moneyness double, T double")
    wanted = spark.createDataFrame([(1, f"n{i}", float(a), float(b)) for i, (a, b) in enumerate(targets)], "d int, node string, log_moneyness double, T double")
    got = {r.node: (r.key, r.mapping_distance) for r in nearest.nearest(wanted, points, "d", "node", "key").collect()}
    for i, q in enumerate(targets):
        distance = np.sqrt(((p[:, 0] - q[0]) / 0.02) ** 2 + ((p[:, 1] - q[1]) / 0.05) ** 2)
        assert got[f"n{i}"] == (f"k{distance.argmin():03d}", pytest.approx(distance.min()))


def test_nearest_with_far_places_crowded_cells_and_missing_coordinates(spark):
    rng = np.random.default_rng(21)
    lattice = np.array([(0.01 * i, 0.05 * j) for i in range(-8, 9) for j in range(1, 8)])
    days = {
        1: np.vstack([rng.normal(size=(300, 2)) * 0.2, [(-4.0e9, 0.3), (2.5, 7.0e11), (1e17, -1e17)]]),
        2: np.vstack([rng.uniform(size=(2000, 2)) * 1e-3, [(5.0, 5.0)]]),
        3: np.vstack([lattice, lattice]),
    }
    rows = [(d, f"k{i:04d}", float(a), float(b)) for d, p in days.items() for i, (a, b) in enumerate(p)]
    rows += [(1, "a", None, 0.1), (1, "b", 0.1, float("inf")), (2, "c", float("nan"), 0.0)]
    points = spark.createDataFrame(rows, "d int, key string, x double, t double").repartition(4)
    q = np.vstack([rng.normal(size=(25, 2)) * 0.1, rng.uniform(size=(10, 2)) * 1e-3, lattice[::9] + [0.005, 0.0], [(-3.9e9, 0.0), (1e16, 1e16)]])
    wanted = [(d, i, float(a), float(b)) for d in (1, 2, 3, 4) for i, (a, b) in enumerate(q)] + [(1, 999, None, 0.1)]
    targets = spark.createDataFrame(wanted, "d int, node int, x double, t double")
    got = {(r.d, r.node): (r.key, r.mapping_distance) for r in nearest.nearest(targets, points, "d", "node", "key", "x", "t").collect()}
    want = {}
    for d, p in days.items():
        for i, at in enumerate(q):
            distance = np.sqrt(((p[:, 0] - at[0]) / 0.02) ** 2 + ((p[:, 1] - at[1]) / 0.05) ** 2)
            first = np.flatnonzero(distance - distance.min() <= 1e-12)[0]
            want[d, i] = (f"k{first:04d}", pytest.approx(distance.min(), rel=1e-12))
    assert got == want
    assert nearest.nearest(targets, points.limit(0), "d", "node", "key", "x", "t").collect() == []


def test_a_target_meets_a_few_cells_however_many_the_day_has(spark):
    targets = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(random_day(40, 9))], "d int, node int, _x double, _t double")
    cells, met = [], []
    for n in (20, 200):
        side = np.linspace(-1.0, 1.0, n)
        places = spark.createDataFrame([(1, float(a), float(b)) for a in side for b in side], "d int, _px double, _pt double")
        _, levels = nearest._pyramid(places, "d", 0.02, 0.05)
        assert levels[-1].count() <= 4
        cells.append(levels[0].count())
        found = nearest._descend(targets, levels, "d", "node", 0.02, 0.05, 0.0)
        met.append(max(r["count"] for r in found.groupBy("node").count().collect()))
    assert cells == [400, 40_000] and max(met) <= 8


# ------------------------------------------------------------------ cleaning

MONDAY = D(2022, 11, 7)
QUOTE = [f.name for f in tables.QUOTE_SCHEMA.fields]


def archive(seed, n=400):
    """Raw quotes around every cleaning limit, as dicts."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        mid, spot = rng.uniform(0.5, 30), rng.uniform(70, 90)
        width = mid * rng.choice([0.02, 0.15, 0.19, 0.21, 0.6])
        day = MONDAY + dt.timedelta(days=int(rng.integers(0, 4)))
        rows.append(
            {
                "underlying_symbol": "spx",
                "quote_date": str(rng.choice([day.isoformat(), day.strftime("%d/%m/%Y"), "soon"], p=[0.7, 0.25, 0.05])),
                "root": "SPX",
                "expiration": (day + dt.timedelta(days=int(rng.choice([13, 14, 60, 200, 365, 366])))).isoformat(),
                "strike": float(spot * rng.choice([0.79, 0.81, 1.0, 1.19, 1.21])),
                "option_type": str(rng.choice(["c", "P", "X"], p=[0.45, 0.45, 0.1])),
                "trade_volume": int(rng.choice([0, 1, 9], p=[0.1, 0.45, 0.45])),
                "open_interest": int(rng.choice([0, 2], p=[0.1, 0.9])),
                "bid_1545": float(mid - width / 2),
                "ask_1545": float(mid + width / 2),
                "underlying_bid_1545": float(spot - 0.1),
                "underlying_ask_1545": float(spot + 0.1),
                "bid_eod": 1.0,
                "ask_eod": 2.0,
            }
        )
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in QUOTE) for r in rows], tables.QUOTE_SCHEMA)


def parsed(text):
    for style in ("%Y-%m-%d", "%d/%m/%Y"):
        try:
            return dt.datetime.strptime(text, style).date()
        except ValueError:
            pass
    return None


def first_failure(r, rate_days):
    """The first rule a quote breaks, at zero rates."""
    day, mid = parsed(r["quote_date"]), (r["bid_1545"] + r["ask_1545"]) / 2
    spot = (r["underlying_bid_1545"] + r["underlying_ask_1545"]) / 2
    if not (r["bid_1545"] > 0 and r["ask_1545"] > r["bid_1545"] and r["trade_volume"] > 0 and r["open_interest"] > 0):
        return "basic"
    if day is None:
        return "bad_dates"
    if not 14 <= (parsed(r["expiration"]) - day).days <= 365:
        return "t_window"
    if day not in rate_days:
        return "no_rates"
    if not 0.8 <= r["strike"] / spot <= 1.2:
        return "moneyness"
    if (r["ask_1545"] - r["bid_1545"]) / mid > 0.2:
        return "spread"
    if r["option_type"].upper() not in "CP":
        return "option_type"
    bound = max(0.0, (spot - r["strike"]) * (1 if r["option_type"].upper() == "C" else -1))
    return "lower_bound" if mid + 1e-4 < bound else None


def test_funnel_against_plain_rules(spark):
    rows = archive(31)
    days = [MONDAY, MONDAY + dt.timedelta(days=1), MONDAY + dt.timedelta(days=3)]
    flat = rates(spark, [(d, *[0.0] * 7) for d in days])
    want = [first_failure(r, days) for r in rows]
    flagged = cleaning.with_first_failure(as_frame(spark, rows), flat)
    assert sorted(map(str, (r.first_fail for r in flagged.collect()))) == sorted(map(str, want))
    assert len(set(want)) == 9
    removed = {r.step: r.rows_removed for r in cleaning.funnel(flagged).collect()}
    assert removed == {name: want.count(name) for name, _ in cleaning.FUNNEL}
    counts = cleaning.cleaning_counts(flagged)
    assert counts.first().kept_basic == want.count(None)
    assert {r.status for r in cleaning.conservation(counts).collect()} == {"PASS"}
    again = cleaning.funnel_of(spark, counts.first().asDict())
    assert again.collect() == cleaning.funnel(flagged).collect()


def test_inversion_recovers_random_volatilities(spark):
    rng = np.random.default_rng(32)
    rows = [(float(rng.uniform(50, 150)), float(rng.uniform(0.85, 1.15)), int(rng.integers(20, 360)), float(rng.uniform(0, 0.05)), 0.015, float(rng.uniform(0.1, 0.6)), o) for o in "CP" * 20]
    df = spark.createDataFrame(rows, "spot double, moneyness double, days int, r_annual double, q_annual double, v double, option_type string")
    df = df.withColumns({"T": F.col("days") / 365.0, "strike": F.col("spot") * F.col("moneyness"), "quote_date": F.lit(MONDAY), "expiration": F.date_add(F.lit(MONDAY), F.col("days"))})
    df = N.with_option_price(df, "mid", "spot", "strike", "T", "r_annual", "q_annual", "v", F.col("option_type") == "C")
    solved = implied_vol.invert(df)
    assert all(r.implied_vol == pytest.approx(r.v, abs=1e-7) for r in solved.collect())
    worthless = df.withColumn("mid", F.lit(-0.25))
    counts = implied_vol.inversion_counts(implied_vol.invert(worthless).unionByName(solved), worthless.withColumn("mid", F.lit(0.25)).unionByName(df)).first()
    assert (counts.valid, counts.solver_failure, counts.invalid_input) == (40, 40, 0)


def test_market_inputs_need_rates(spark):
    one = as_frame(spark, archive(33, 1)).withColumn("quote_date", F.lit(MONDAY.isoformat()))
    row = implied_vol.with_market_inputs(one, rates(spark, [(MONDAY, *[0.0] * 7)])).first()
    assert row.spot == pytest.approx((row.underlying_bid_1545 + row.underlying_ask_1545) / 2) and (row.r_annual, row.q_annual) == (0.0, 0.0)
    with pytest.raises(ValueError):
        implied_vol.with_market_inputs(one)


# ------------------------------------------------------------------ surfaces

COARSE = Grid(x_min=-0.3, x_max=0.3, x_points=7, t_min=0.1, t_max=0.9, t_points=5, min_points_day=6)


def tilted(spark, n=5):
    """Quotes on a lattice, three at each place, whose median lies on a plane."""
    rows = []
    for x in np.linspace(-0.25, 0.25, n):
        for t in np.linspace(0.05, 1.0, n):
            level = 0.3 + 0.4 * x - 0.1 * t
            rows += [(MONDAY, float(x), float(t), float(v)) for v in (level - 0.02, level, level + 0.09)]
    return spark.createDataFrame(rows, "quote_date date, log_moneyness double, T double, implied_vol double")


@pytest.mark.parametrize("method", ["separable", "delaunay"])
def test_surfaces_reproduce_a_plane_inside_the_quotes_only(spark, method):
    locations = surface.unique_locations(tilted(spark))
    nodes = surface.build_surface(locations, COARSE, method)
    places = {r.node: (r.log_moneyness, r.T) for r in surface.grid_nodes(spark, COARSE).collect()}
    found = {r.node: r.iv_grid for r in nodes.collect()}
    for node, (x, t) in places.items():
        inside = abs(x) <= 0.25 and 0.05 <= t <= 1.0
        assert found[node] == (pytest.approx(0.3 + 0.4 * x - 0.1 * t) if inside else None)
    day = surface.day_stats(locations, nodes, COARSE).first()
    assert (day.n_obs_raw, day.n_obs_unique, day.status) == (75, 25, "kept") and day.coverage == pytest.approx(25 / 35)
    assert surface.smooth(nodes, 0.0, COARSE) is nodes


def test_thin_days_have_no_surface(spark):
    locations = surface.unique_locations(tilted(spark))
    strict = Grid(min_points_day=26)
    assert surface.build_surface(locations, strict).count() == 0
    assert surface.day_stats(locations, surface.build_surface(locations, strict), strict).first().status == "skipped_min_points"


def test_default_grid_is_evenly_spaced(spark):
    rows = surface.grid_nodes(spark).collect()
    xs, ts = sorted({round(r.log_moneyness, 12) for r in rows}), sorted({round(r.T, 12) for r in rows})
    assert (len(rows), len(xs), len(ts)) == (500, 25, 20) and len({r.node for r in rows}) == 500
    assert np.ptp(np.diff(xs)) < 1e-11 and np.ptp(np.diff(ts)) < 1e-11


# ------------------------------------------------------------------ mapping


def offers(spark, day, places):
    """A market with contracts at the given (key, log-moneyness, maturity)."""
    schema = "quote_date date, contract_key string, underlying_symbol string, root string, expiration date, strike double, option_type string, bid double, ask double, mid double, spot double, implied_vol double, T double, r double, q double, trade_volume double, open_interest double, log_moneyness double, source_observation_count long"
    rows = [(day, k, "SPX", "SPX", D(2023, 3, 17), 80.0, "P", 3.0, 3.5, 3.25, 82.0, 0.25, float(t), 0.01, 0.0, 4.0, 6.0, float(x), 1) for k, x, t in places]
    return spark.createDataFrame(rows, schema)


def wishes(spark, signals):
    rows = [("arima", MONDAY, MONDAY + dt.timedelta(days=1), f"n{i}", 0.05, 0.4, s) for i, s in enumerate(signals)]
    return spark.createDataFrame(rows, "model string, decision_date date, entry_date date, node string, log_moneyness double, T double, signal int")


def week(spark, short=()):
    days = [MONDAY + dt.timedelta(days=i) for i in range(5)]
    return cal.calendar_table(spark.createDataFrame([(d, i not in short) for i, d in enumerate(days)], "session date, is_1545_open boolean"))


def test_equally_near_contracts_are_chosen_by_key(spark):
    entry = MONDAY + dt.timedelta(days=1)
    ring = [("z", 0.05 + 0.02, 0.4), ("m", 0.05 - 0.02, 0.4), ("q", 0.05, 0.45), ("far", 0.2, 0.4)]
    out = mapping.map_entry(wishes(spark, [1]), offers(spark, entry, ring), week(spark)).first()
    assert out.contract_key == "m" and out.entry_mapping_status == "MAPPED" and out.mapping_distance == pytest.approx(1.0)
    assert mapping.map_entry(wishes(spark, [-1]), offers(spark, entry, ring[2:]), week(spark)).first().entry_execution_price == 3.0


@pytest.mark.parametrize("ahead,short,status", [(2, (), "NO_ENTRY_MARKET"), (0, (), "NO_ENTRY_MARKET"), (1, (1,), "MARKET_CLOSED_AT_1545")])
def test_entries_use_an_open_market_of_their_own_day(spark, ahead, short, status):
    market = offers(spark, MONDAY + dt.timedelta(days=ahead), [("k", 0.05, 0.4)])
    out = mapping.map_entry(wishes(spark, [1]), market, week(spark, short)).first()
    assert (out.contract_key, out.entry_mapping_status) == (None, status)


@pytest.mark.parametrize("longs,shorts", [(4, 1), (2, 5), (3, 0), (0, 2)])
def test_each_side_has_half_the_budget_or_none(spark, longs, shorts):
    base = wishes(spark, [1] * longs + [-1] * shorts).withColumn("entry_mapping_status", F.lit("MAPPED"))
    weights = sorted(r.weight_at_entry for r in mapping.lock_weights(base).collect())
    both = longs and shorts
    assert weights == pytest.approx(sorted([0.5 / longs if both else 0.0] * longs + [-0.5 / shorts if both else 0.0] * shorts))


def test_contract_keys_need_every_part(spark):
    full = ("spx ", "SPXW", D(2023, 3, 17), 80.25, "call")
    rows = [full, *[tuple(None if i == gap else v for i, v in enumerate(full)) for gap in range(5)]]
    df = spark.createDataFrame(rows, "s string, r string, e date, k double, o string")
    assert [r[0] for r in df.coalesce(1).select(X.contract_key("s", "r", "e", "k", "o")).collect()] == ["SPX|SPXW|2023-03-17|80.250000|C", *[None] * 5]


# ------------------------------------------------------------------ exit quotes


def random_exits(seed, n=120):
    """Per contract: the processed book and the raw book found, either may be absent or improper."""
    rng = np.random.default_rng(seed)
    books = [None, (2.0, 2.6), (5.0, 5.0), (3.0, 2.0), (0.0, 1.0), (float("nan"), 4.0), (4.0, None)]
    return {f"c{i:03d}": (books[rng.integers(len(books))], books[rng.integers(len(books))], float(rng.integers(0, 2))) for i in range(n)}


def exit_frames(spark, exits, day):
    required = spark.createDataFrame([(day, k) for k in exits], "intended_exit_date date, contract_key string")
    processed = [(day, k, *p, v) for k, (p, _, v) in exits.items() if p]
    raw = [(day, k, *r, v, 1.0) for k, (_, r, v) in exits.items() if r]
    return (
        required,
        spark.createDataFrame(processed, "quote_date date, contract_key string, bid double, ask double, trade_volume double"),
        spark.createDataFrame(raw, "quote_date date, contract_key string, bid_1545 double, ask_1545 double, trade_volume double, open_interest double"),
    )


def proper(book):
    return bool(book) and book[1] is not None and 0 < book[0] <= book[1]


def test_exit_choice_against_a_plain_rule(spark):
    exits, day = random_exits(34), MONDAY + dt.timedelta(days=2)
    required, processed, raw = exit_frames(spark, exits, day)
    found = {r.contract_key: r for r in quotes.choose_quotes(required, processed, raw, week(spark)).collect()}
    for k, (p, r, volume) in exits.items():
        source, book = (PROCESSED, p) if proper(p) else (RECOVERED, r) if proper(r) else (NO_QUOTE, None)
        got = found[k]
        assert (got.exit_quote_source, got.BASE) == (source, book is not None)
        assert (got.exit_bid, got.exit_ask) == (book or (None, None))
        tight = book is not None and (book[1] - book[0]) / sum(book) * 2 <= 0.2
        assert (got.STRICT_20, got.POSITIVE_VOLUME) == (tight, book is not None and volume > 0)
    shut = quotes.choose_quotes(required, processed, raw, week(spark, (2,)))
    assert shut.where("BASE").isEmpty()


def test_a_spread_at_the_limit_is_inside_whatever_order_its_mean_was_summed_in(spark):
    day = MONDAY + dt.timedelta(days=2)
    books = {"a": (0.95, 1.05), "b": (0.9, 1.1), "c": (0.9, 1.1000001), "d": (0.95, 1.0500001)}
    assert (1.05 - 0.95) / 1.0 > 0.1 and (1.1 - 0.9) / 1.0 > 0.2
    required, processed, raw = exit_frames(spark, {k: (book, None, 1.0) for k, book in books.items()}, day)
    chosen = quotes.choose_quotes(required, processed, raw, week(spark))
    assert {r.contract_key: (r.STRICT_10, r.STRICT_20) for r in chosen.collect()} == {
        "a": (True, True), "b": (False, True), "c": (False, False), "d": (False, True),
    }
    held = chosen.select(F.lit("m").alias("model"), F.lit(True).alias("nonzero_net_position"), *chosen.columns)
    covered = quotes.coverage(held).first()
    assert (covered.STRICT_10_valid_exits, covered.STRICT_20_valid_exits) == (1, 3)
    quality = quotes.quote_quality(chosen, held).where(F.col("source") == PROCESSED)
    assert {(r.n_spread_gt_10, r.n_spread_gt_20) for r in quality.collect()} == {(3, 1)}


def test_exit_choice_reads_nothing_but_the_exact_books(spark):
    exits, day = random_exits(35), MONDAY + dt.timedelta(days=2)
    required, processed, raw = exit_frames(spark, exits, day)
    core = ["contract_key", "BASE", "exit_quote_source", "exit_bid", "exit_ask"]
    want = sorted(map(str, quotes.choose_quotes(required, processed, raw, week(spark)).select(*core).collect()))
    noise = lambda f: f.withColumns({"trade_volume": F.rand(1), "bid_eod": F.rand(2), "ask_eod": F.rand(3), "implied_vol": F.rand(4)})
    assert sorted(map(str, quotes.choose_quotes(required, noise(processed), noise(raw), week(spark)).select(*core).collect())) == want
    nowhere = quotes.choose_quotes(required, processed.withColumn("quote_date", F.date_sub("quote_date", 1)), raw.withColumn("contract_key", F.concat("contract_key", F.lit("x"))), week(spark))
    assert nowhere.where("BASE").isEmpty() and nowhere.count() == len(exits)


def test_snapshot_needs_a_session_that_runs_to_its_time(spark):
    closes = {D(2022, 11, 23): 16, D(2022, 11, 25): 13, D(2022, 11, 28): 16, D(2022, 11, 29): 16}
    calendar = cal.calendar_table(spark.createDataFrame([(d, dt.datetime(d.year, d.month, d.day, h)) for d, h in closes.items()], "session date, close_ts timestamp"))
    every = [D(2022, 11, 23) + dt.timedelta(days=i) for i in range(7)]
    guarded = cal.snapshot_guard(spark.createDataFrame([(d,) for d in every], "day date"), "day", calendar, "ok").collect()
    assert {r.day for r in guarded if r.ok} == {d for d, h in closes.items() if h == 16}
    following = {r.session: r.target_h1 for r in cal.with_targets(calendar).collect()}
    days = sorted(closes)
    assert following == dict(zip(days, [*days[1:], None], strict=True))
    plans = spark.createDataFrame([(a, b, c) for a in every for b in every for c in every], "decision_date date, entry_date date, intended_exit_date date")
    for r in cal.chronology(plans, calendar).collect():
        assert r.economic_calendar_eligible == (r.decision_date in closes and closes.get(r.entry_date) == 16 and closes.get(r.intended_exit_date) == 16)


# ------------------------------------------------------------------ sources


def test_csv_source_needs_its_columns(spark, tmp_path):
    path = str(tmp_path / "q")
    as_frame(spark, archive(36, 5)).drop("root").write.option("header", True).csv(path)
    with pytest.raises(tables.MissingColumns):
        tables.read_quotes_csv(spark, path)


def test_csv_layouts_are_matched_by_name_or_refused(spark, tmp_path):
    rows = archive(37, 12)
    one, two = (as_frame(spark, part).coalesce(1) for part in (rows[:6], rows[6:]))
    paths = [str(tmp_path / "one"), str(tmp_path / "two")]
    one.write.option("header", True).csv(paths[0])
    two.select(F.lit("x").alias("extra"), *reversed(QUOTE)).write.option("header", True).csv(paths[1])
    both = tables.read_quotes_csv(spark, paths)
    assert sorted(both.collect()) == sorted(one.collect() + two.collect())
    assert tables.csv_row_count(spark, paths[1]).first().rows == 6
    swapped = ["ask_1545" if c == "bid_1545" else "bid_1545" if c == "ask_1545" else c for c in QUOTE]
    two.select(*swapped).write.mode("append").option("header", True).csv(paths[0])
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_quotes_csv(spark, paths[0]).collect()


def test_reading_absent_dates_gives_no_rows(spark, tmp_path):
    path = str(tmp_path / "m")
    tables.write_by_date(offers(spark, MONDAY, [("a", 0.0, 0.3), ("b", 0.1, 0.3), ("c", 0.2, 0.3)]), path)
    wanted = lambda d: spark.createDataFrame([(d,)], "d date")
    assert tables.read_dates(spark, path, wanted(MONDAY)).count() == 3
    assert tables.read_dates(spark, path, wanted(MONDAY + dt.timedelta(days=1))).count() == 0


def test_reports_have_no_row_limit(spark, tmp_path):
    path = str(tmp_path / "r")
    tables.write_report(spark.range(100_500), path)
    assert tables.csv_row_count(spark, path).first().rows == 100_500
