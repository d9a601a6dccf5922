"""Cubic surface interpolation: a C1 patch on every Delaunay triangle that holds a node.

Three steps, each depending only on the triangles around a node:

1. the star of each vertex, found by turning a direction around it: the triangle in
   that direction, then the triangle just past its last edge, until the turn is closed;
2. the gradient at a vertex: the quadratic through it that fits its neighbours best,
   with the least curvature where they do not determine one;
3. a cubic on each third of the triangle, split at its centroid, with a normal derivative
   that is linear along each edge. Values and derivatives along an edge come from its two
   ends alone, so patches meet with equal first derivatives, and quadratics are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..settings import Grid
from .delaunay import CORNERS, ORIGIN, STEPS, triangles, triangulated_surface

#: Weight of the curvature against the neighbours' values.
CURVATURE = 1e-5
#: Neighbours closer to one line than this do not determine a gradient.
FLAT = 1e-6
#: Angle by which a turn goes past an edge: beyond rounding, below any angle that matters.
PAST = 1e-8


def stars(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All triangles around the given vertices (numbers as in `triangles`).

    Returns per triangle the position of its centre and its vertices, where the last one is
    the neighbour reached counterclockwise, and per centre whether its turn was closed.
    """
    places = np.vstack([CORNERS, points - ORIGIN])
    here = places[centres]
    closed = np.zeros(len(centres), bool)
    step = np.tile(STEPS[:, :2], (len(centres), 1, 1))
    first, last = np.full(len(centres), -1), np.full(len(centres), -1)
    turned = np.zeros(len(centres))
    owners, found = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
    open_rows = np.arange(len(centres))
    for _ in range(len(places) + 1):
        if not len(open_rows):
            break
        steps = np.zeros((len(open_rows), 3, 2))
        steps[:, :2] = np.swapaxes(step[open_rows], 1, 2)
        basis, _ = triangles(points, points[centres[open_rows] - 3], steps=steps)
        other = basis != centres[open_rows][:, None]
        usable = other.sum(axis=1) == 2  # not so only for points that rounding cannot tell apart
        open_rows, basis, other = open_rows[usable], basis[usable], other[usable]
        pair = basis[other].reshape(-1, 2)
        leg = places[pair] - here[open_rows][:, None]
        cross = leg[:, 0, 0] * leg[:, 1, 1] - leg[:, 0, 1] * leg[:, 1, 0]
        pair[cross < 0] = pair[cross < 0, ::-1]
        leg[cross < 0] = leg[cross < 0, ::-1]
        turned[open_rows] += np.arctan2(np.abs(cross), (leg[:, 0] * leg[:, 1]).sum(axis=1))
        first[open_rows] = np.where(first[open_rows] < 0, pair[:, 0], first[open_rows])
        owners.append(open_rows)
        found.append(np.column_stack([centres[open_rows], pair]))
        aside = np.column_stack([-leg[:, 1, 1], leg[:, 1, 0]])
        step[open_rows] = np.stack([leg[:, 1] + PAST * aside, aside], axis=1)
        done = (pair[:, 1] == first[open_rows]) | (turned[open_rows] > 2 * np.pi - 1e-9)
        closed[open_rows[done]] = True
        stuck = pair[:, 1] == last[open_rows]
        last[open_rows] = pair[:, 1]
        open_rows = open_rows[~(done | stuck)]
    return np.concatenate(owners), np.concatenate(found), closed


def gradients(points: np.ndarray, values: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient at each centre, and whether its neighbours determine it."""
    owner, star, closed = stars(points, centres)
    real = star[:, 2] >= 3
    owner, beside = owner[real], star[real, 2] - 3
    order = np.argsort(owner, kind="stable")
    owner, beside = owner[order], beside[order]
    count = np.bincount(owner, minlength=len(centres))
    slot = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    width = max(int(count.max(initial=0)), 2)

    away = points[beside] - points[centres[owner] - 3]
    scale = np.zeros((len(centres), 2))
    np.maximum.at(scale, owner, np.abs(away))
    scale[scale == 0] = 1.0
    x, t = (away / scale[owner]).T
    near = 1.0 / np.hypot(x, t)
    design = np.zeros((len(centres), width + 3, 5))
    design[owner, slot] = np.column_stack([x, t, x * x / 2, x * t, t * t / 2]) * near[:, None]
    design[:, width + np.arange(3), 2 + np.arange(3)] = CURVATURE
    rise = np.zeros((len(centres), width + 3))
    rise[owner, slot] = (values[beside] - values[centres[owner] - 3]) * near
    slopes = (np.linalg.pinv(design) @ rise[..., None])[:, :2, 0] / scale
    spread = np.linalg.svd(design[:, :width, :2], compute_uv=False)
    return slopes, closed & (spread[:, 1] > FLAT * spread[:, 0])


def patch(corner: np.ndarray, value: np.ndarray, slope: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Value of each triangle's patch at barycentric weights.

    Arrays over triangles: corner (n, 3, 2), value (n, 3), slope (n, 3, 2), weight (n, 3).
    """
    rows = np.arange(len(corner))
    centre = corner.mean(axis=1)
    toward = lambda i, j: value[:, i] + (slope[:, i] * (corner[:, j] - corner[:, i])).sum(axis=1) / 3
    inner = np.stack([value[:, i] + (slope[:, i] * (centre - corner[:, i])).sum(axis=1) / 3 for i in range(3)], axis=1)
    # The coefficient in the middle of each third, named by the corner that the third leaves out.
    middle = np.empty_like(inner)
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        edge = corner[:, j] - corner[:, i]
        foot = ((centre - corner[:, i]) * edge).sum(axis=1) / (edge**2).sum(axis=1)
        there, back = toward(i, j), toward(j, i)
        at_i = inner[:, i] - (1 - foot) * value[:, i] - foot * there
        at_j = inner[:, j] - (1 - foot) * back - foot * value[:, j]
        middle[:, k] = (1 - foot) * there + foot * back + (at_i + at_j) / 2
    around = (inner + middle.sum(axis=1, keepdims=True) - middle) / 3
    top = around.mean(axis=1)

    k = weight.argmin(axis=1)
    i, j = (k + 1) % 3, (k + 2) % 3
    low = weight[rows, k]
    u, v, w = weight[rows, i] - low, weight[rows, j] - low, 3 * low
    tangent = np.stack([np.stack([toward(a, b) if a != b else value[:, a] for b in range(3)], axis=1) for a in range(3)], axis=1)
    return (
        u**3 * value[rows, i]
        + v**3 * value[rows, j]
        + w**3 * top
        + 3 * u * v * (u * tangent[rows, i, j] + v * tangent[rows, j, i])
        + 3 * w * (u * u * inner[rows, i] + v * v * inner[rows, j])
        + 3 * w * w * (u * around[rows, i] + v * around[rows, j])
        + 6 * u * v * w * middle[rows, k]
    )


def interpolate(points: np.ndarray, values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Cubic value on the Delaunay triangle of each target; NaN outside the hull.

    A target whose triangle has a vertex without a gradient, as where all points lie on one
    line, takes the linear value.
    """
    if len(points) < 3:
        return np.full(len(targets), np.nan)
    order = np.lexsort((points[:, 1], points[:, 0]))
    points, values = points[order], values[order]
    basis, weights = triangles(points, targets)
    outside = ((basis < 3) & (weights > 1e-9)).any(axis=1)
    weights = np.where(basis < 3, 0.0, np.maximum(weights, 0.0))
    weights /= np.where(outside, 1.0, weights.sum(axis=1))[:, None]
    # A vertex of weight 0 has no part in the value; the other two still need their gradients.
    needed = (basis >= 3) & ~outside[:, None]
    centres = np.unique(basis[needed])
    slope, known = np.zeros((len(points) + 3, 2)), np.ones(len(points) + 3, bool)
    if len(centres):
        slope[centres], known[centres] = gradients(points, values, centres)
    height = np.r_[np.zeros(3), values][basis]
    curved = patch(np.vstack([CORNERS + ORIGIN, points])[basis], height, slope[basis], weights)
    out = np.where(known[basis].all(axis=1), curved, (weights * height).sum(axis=1))
    return np.where(outside, np.nan, out)


def supports(points: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """All triangles that the targets' values depend on: their own and those around their vertices."""
    basis, _ = triangles(points, targets)
    centres = np.unique(basis[basis >= 3])
    if not len(centres):
        return basis
    return np.vstack([basis, np.unique(np.sort(stars(points, centres)[1], axis=1), axis=0)])


def cubic_surface(locations: DataFrame, grid: Grid = Grid(), bounded_day: int = 5_000) -> DataFrame:
    """Cubic surface of every day, in work units like those of the linear one.

    On a heavy day a block's points grow until the circles of its nodes' triangles and of all
    triangles around their vertices are empty, so both ways give the same values.
    """
    return triangulated_surface(locations, grid, bounded_day, interpolate, supports)
