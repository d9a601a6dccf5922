"""Cubic patches on Delaunay triangles."""

import datetime as dt

import numpy as np
import pytest

from smilegrid.operators import cubic, delaunay

DAY = dt.date(2024, 1, 2)
SCHEMA = "quote_date date, log_moneyness double, T double, implied_vol double, n_quotes long"


def scattered(n, seed):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.uniform(-0.3, 0.3, n), rng.uniform(0.02, 1.2, n)])


def inner_targets(n, seed):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.uniform(-0.2, 0.2, n), rng.uniform(0.2, 1.0, n)])


def all_triangles(p):
    """Every Delaunay triangle by exhaustive search."""
    from itertools import combinations

    lifted = np.column_stack([p, np.ones(len(p))])
    out = set()
    for t in combinations(range(len(p)), 3):
        plane = np.linalg.solve(lifted[list(t)], (p[list(t)] ** 2).sum(axis=1))
        if ((p**2).sum(axis=1) - lifted @ plane > -1e-12).all():
            out.add(t)
    return out


def test_stars_against_exhaustive_search():
    p = scattered(22, 1)
    owner, star, closed = cubic.stars(p, np.arange(len(p)) + 3)
    assert closed.all()
    found = {tuple(sorted(t - 3)) for t in star if (t >= 3).all()}
    assert found == all_triangles(p)
    # Each triangle is met once from each of its vertices.
    per_centre = [(o, *sorted(t - 3)) for o, t in zip(owner, star) if (t >= 3).all()]
    assert len(per_centre) == len(set(per_centre)) == 3 * len(found)


def test_stars_of_a_lattice_are_triangles_of_one_triangulation():
    p = np.array([(0.02 * i, 0.05 * j) for i in range(7) for j in range(6)])
    owner, star, closed = cubic.stars(p, np.arange(len(p)) + 3)
    real = [tuple(sorted(t - 3)) for t in star if (t >= 3).all()]
    assert closed.all() and len(set(real)) == 2 * 6 * 5 and len(real) == 3 * len(set(real))


def test_quadratic_is_closer_than_linear():
    p, q = scattered(300, 2), inner_targets(200, 3)
    f = lambda z: 0.2 + 0.5 * z[:, 0] - 0.1 * z[:, 1] + 2 * z[:, 0] ** 2 - 0.7 * z[:, 0] * z[:, 1] + 0.3 * z[:, 1] ** 2
    off = np.abs(cubic.interpolate(p, f(p), q) - f(q))
    linear = np.abs(delaunay.interpolate(p, f(p), q) - f(q))
    assert np.median(off) < 1e-9 and off.mean() < linear.mean() / 20 and off.max() < linear.max() / 2


def test_smooth_function_is_closer_than_linear():
    p, q = scattered(500, 4), inner_targets(300, 5)
    f = lambda z: 0.2 + 0.1 * np.sin(9 * z[:, 0]) * np.exp(-z[:, 1])
    off = np.abs(cubic.interpolate(p, f(p), q) - f(q))
    linear = np.abs(delaunay.interpolate(p, f(p), q) - f(q))
    assert off.mean() < linear.mean() / 4


def test_planes_and_data_are_met():
    p, q = scattered(200, 6), scattered(300, 7)
    plane = cubic.interpolate(p, 0.3 + 0.2 * p[:, 0] - 0.1 * p[:, 1], q)
    linear = delaunay.interpolate(p, 0.3 + 0.2 * p[:, 0] - 0.1 * p[:, 1], q)
    np.testing.assert_array_equal(np.isnan(plane), np.isnan(linear))
    assert np.isnan(plane).any()
    np.testing.assert_allclose(plane, linear, atol=1e-11)
    v = np.random.default_rng(8).uniform(0.1, 0.4, len(p))
    np.testing.assert_allclose(cubic.interpolate(p, v, p), v, atol=1e-11)


def test_first_derivatives_agree_across_edges_and_inner_lines():
    p = scattered(120, 9)
    v = np.random.default_rng(10).uniform(0.1, 0.4, len(p))
    basis, _ = delaunay.triangles(p, inner_targets(150, 11))
    h = 1e-8  # second derivatives are in the thousands
    checked, jumps = 0, []
    for corner in {tuple(sorted(b - 3)) for b in basis if (b >= 3).all()}:
        c = p[list(corner)]
        lines = [(c[0], c[1]), (c[1], c[2]), (c[0], c[2]), *[(k, c.mean(axis=0)) for k in c]]
        for a, b in lines:
            across = np.array([-(b - a)[1], (b - a)[0]]) / np.linalg.norm(b - a)
            at = a + np.array([[0.3], [0.65]]) * (b - a)
            ahead, here, behind = (cubic.interpolate(p, v, at + s * h * across) for s in (1, 0, -1))
            right, left = (ahead - here) / h, (here - behind) / h
            inside = np.isfinite([delaunay.interpolate(p, v, at + s * 1e-5 * across) for s in (1, -1)]).all(axis=0)
            np.testing.assert_allclose(right[inside], left[inside], atol=1e-3)
            checked += inside.sum()
            flat = [delaunay.interpolate(p, v, at + s * h * across) for s in (1, 0, -1)]
            jumps.extend(np.abs(flat[0] - 2 * flat[1] + flat[2])[inside] / h)
        if checked > 400:
            break
    assert checked > 200 and np.median(np.sort(jumps)[-100:]) > 0.5  # where the linear surface has its creases


def test_points_on_one_line_take_the_linear_value():
    p = np.array([(0.01 * i, 0.5) for i in range(-5, 6)])
    found = cubic.interpolate(p, p[:, 0] ** 2, np.array([(0.005, 0.5), (-0.05, 0.5), (0.0, 0.6)]))
    np.testing.assert_allclose(found[:2], [0.00005, 0.0025], atol=1e-12)
    assert np.isnan(found[2])
    assert np.isnan(cubic.interpolate(p[:2], np.ones(2), p)).all()


def test_order_of_points_does_not_matter():
    p = np.array([(0.02 * i, 0.05 * j) for i in range(-8, 9) for j in range(1, 20)])
    v = np.random.default_rng(12).uniform(size=len(p))
    order = np.random.default_rng(13).permutation(len(p))
    q = inner_targets(200, 14)
    np.testing.assert_allclose(cubic.interpolate(p[order], v[order], q), cubic.interpolate(p, v, q), atol=1e-11)


@pytest.mark.parametrize("lattice", [False, True])
def test_heavy_day_gives_the_same_cubic_surface(spark, lattice):
    if lattice:
        p = np.array([(x, t) for x in np.linspace(-0.24, 0.2, 30) for t in (0.08, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0)])
    else:
        p = scattered(700, 15)
    v = np.random.default_rng(16).uniform(0.1, 0.4, len(p))
    df = spark.createDataFrame([(DAY, float(a), float(b), float(c), 1) for (a, b), c in zip(p, v)], SCHEMA)
    direct = {r.node: r.iv_grid for r in cubic.cubic_surface(df).collect()}
    heavy = {r.node: r.iv_grid for r in cubic.cubic_surface(df, bounded_day=1).collect()}
    assert direct.keys() == heavy.keys() and len(direct) > 400
    assert [heavy[k] for k in direct] == pytest.approx(list(direct.values()), abs=1e-9)
