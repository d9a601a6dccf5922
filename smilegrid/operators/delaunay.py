"""Delaunay-linear surface interpolation without building a triangulation.

Lifting a point p to |p|^2 turns the triangulation into the lower convex hull:
the triangle around a node is the cheapest way to write the node as a convex
combination of points, a linear program with three active points. A pivot brings
in the point deepest inside the current circumcircle and drops one vertex, until
no point lies inside. All nodes of a day pivot together.

Costs are compared in three levels, so the triangle depends on the points alone and
not on which of them were looked at, or in which order:

1. the weight of three artificial corners, which only a node outside the hull needs;
2. the lifted height;
3. a function of a point's coordinates, which decides among points on one circle, as
   if every point were lifted by an infinitely small multiple of it.

A node on an edge, of a triangle or of the hull, has a vertex of weight 0. Which vertex
leaves then is decided as if the node were moved by infinitely small steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import small_side
from ..plans.lineage import cut
from ..settings import Grid

DAY = "quote_date"
#: Tolerances of the levels: corner weight, height relative to that of the vertices, third cost.
CORNER, INSIDE, TIED = 1e-12, 1e-11, 1e-7
#: Ratios closer than this leave the choice to the next step of the node.
LEVEL = 1e-12
#: Frequencies of the third cost along (log-moneyness, T).
WAVES = ((917.3, 1303.7), (2711.9, -1987.1))
#: Steps of a node.
STEPS = np.array([[0.8090, 0.5878, 0.0], [-0.3827, 0.9239, 0.0]])
#: Origin of all coordinates, so that planes of any two subsets of a day compare.
ORIGIN = np.array([0.0, 0.5])


def _axis(start: float, stop: float, points: int) -> np.ndarray:
    return np.linspace(start, stop, points)


def grid_targets(grid: Grid) -> np.ndarray:
    x, t = np.meshgrid(_axis(grid.x_min, grid.x_max, grid.x_points), _axis(grid.t_min, grid.t_max, grid.t_points))
    return np.column_stack([x.ravel(), t.ravel()])


CORNERS = np.array([[-50.0, -30.0], [50.0, -30.0], [0.0, 60.0]])


def _lift(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertex table, and the costs of its rows by level; the first three vertices are the artificial corners."""
    moved = points - ORIGIN
    places = np.vstack([CORNERS, moved])
    corner = np.r_[np.ones(3), np.zeros(len(moved))]
    height = np.r_[np.zeros(3), (moved**2).sum(axis=1)]
    tie = np.r_[np.zeros(3), sum(np.sin(u * moved[:, 0] + v * moved[:, 1]) for u, v in WAVES)]
    return np.column_stack([places, np.ones(len(places))]), np.column_stack([corner, height, tie])


def _planes(lifted: np.ndarray, cost: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each triangle's planes through the costs (3 coefficients x 3 levels), and the tolerance of the heights."""
    return np.linalg.solve(lifted[basis], cost[basis]), INSIDE * np.maximum(1.0, np.abs(cost[basis][..., 1]).max(axis=1))


def _entering(lifted: np.ndarray, cost: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each triangle the real point that lowers its cost most in the first level in which any does, and whether one does."""
    plane, tolerance = _planes(lifted, cost, basis)
    slack = lambda rows, level: cost[None, 3:, level] - plane[rows][..., level] @ lifted[3:].T
    enter, moving = np.zeros(len(basis), np.int64), np.zeros(len(basis), bool)
    tied = np.ones((len(basis), len(lifted) - 3), bool)
    artificial = np.flatnonzero((basis < 3).any(axis=1))
    if len(artificial):
        below = slack(artificial, 0)
        enter[artificial] = below.argmin(axis=1)
        moving[artificial] = below.min(axis=1) < -CORNER
        tied[artificial] = np.abs(below) <= CORNER
    for level, limit in ((1, tolerance), (2, np.full(len(basis), TIED))):
        rows = np.flatnonzero(~moving)
        if not len(rows):
            break
        below = np.where(tied[rows], slack(rows, level), np.inf)
        enter[rows] = below.argmin(axis=1)
        moving[rows] = below.min(axis=1) < -limit[rows]
        tied[rows] &= np.abs(below) <= limit[rows][:, None]
    return enter + 3, moving


def _leaving(lifted: np.ndarray, basis: np.ndarray, goal: np.ndarray, steps: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """The place in each triangle of the vertex that makes room, so that the node and its steps stay inside."""
    columns = np.concatenate([np.column_stack([goal, np.ones(len(goal))])[..., None], steps, lifted[enter][..., None]], axis=2)
    found = np.linalg.solve(np.swapaxes(lifted[basis], 1, 2), columns)
    there = found[..., 3]
    open_ = there > 1e-13
    for k in range(3):
        weight = np.maximum(found[..., 0], 0.0) if k == 0 else found[..., k]
        ratio = np.where(open_, weight / np.where(open_, there, 1.0), np.inf)
        open_ &= ratio <= ratio.min(axis=1, keepdims=True) + LEVEL
    return open_.argmax(axis=1)


def triangles(points: np.ndarray, targets: np.ndarray, rounds: int = 10_000, steps: np.ndarray | None = None):
    """For each target the vertex numbers and weights of its Delaunay triangle.

    Targets outside the convex hull keep an artificial vertex (number below 3)
    with positive weight. `steps` (targets x 3 x 2) are each target's own infinitely small
    moves, which pick among the triangles around a target that is itself a point.
    """
    lifted, cost = _lift(points)
    goal = targets - ORIGIN
    steps = np.broadcast_to(STEPS.T, (len(goal), 3, 2)) if steps is None else steps
    basis = np.tile(np.arange(3), (len(goal), 1))
    open_rows = np.arange(len(goal))
    for _ in range(rounds):
        enter, moving = _entering(lifted, cost, basis[open_rows])
        open_rows, enter = open_rows[moving], enter[moving]
        if not len(open_rows):
            break
        basis[open_rows, _leaving(lifted, basis[open_rows], goal[open_rows], steps[open_rows], enter)] = enter
    else:
        raise RuntimeError(f"triangulation not settled after {rounds} rounds")
    corner = np.swapaxes(lifted[basis], 1, 2)
    weights = np.linalg.solve(corner, np.column_stack([goal, np.ones(len(goal))])[..., None])[..., 0]
    return basis, weights


def interpolate(points: np.ndarray, values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Linear value on the Delaunay triangle of each target; NaN outside the hull."""
    if len(points) < 3:
        return np.full(len(targets), np.nan)
    # A fixed order keeps the last digits repeatable.
    order = np.lexsort((points[:, 1], points[:, 0]))
    points, values = points[order], values[order]
    basis, weights = triangles(points, targets)
    outside = ((basis < 3) & (weights > 1e-9)).any(axis=1)
    padded = np.r_[np.zeros(3), values]
    out = (weights * np.where(basis < 3, 0.0, padded[basis])).sum(axis=1)
    return np.where(outside, np.nan, out)


_SCHEMA = "quote_date date, n int, iv_grid double"
#: Nodes of a heavy day that are solved together.
BLOCK = 50


def _own_triangles(points: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return triangles(points, targets)[0]


def delaunay_surface(locations: DataFrame, grid: Grid = Grid(), bounded_day: int = 20_000) -> DataFrame:
    """Delaunay-linear surface of every day."""
    return triangulated_surface(locations, grid, bounded_day, interpolate, _own_triangles)


def triangulated_surface(locations: DataFrame, grid: Grid, bounded_day: int, value: Callable, supports: Callable) -> DataFrame:
    """Surface of every day from a rule on Delaunay triangles.

    `value(points, values, targets)` gives the nodes' values, `supports(points, targets)` all
    triangles that they depend on.

    A day with at most `bounded_day` distinct locations is solved in one kernel
    call. A heavier day is solved in blocks of nodes without gathering it: each block
    works on a growing subset of its own, and a distributed pass over all locations
    adds every point found inside some node's circumcircle until none is left. Both
    ways give the same triangles.
    """
    locations = locations.select(DAY, "log_moneyness", "T", "implied_vol")
    counts = locations.groupBy(DAY).agg(F.count(F.lit(1)).alias("_n"))
    heavy = counts.where(F.col("_n") > bounded_day).select(DAY)
    targets = grid_targets(grid)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf["block"].iloc[0]
        own = np.arange(len(targets)) if block < 0 else np.arange(len(targets))[block * BLOCK : (block + 1) * BLOCK]
        z = value(pdf[["log_moneyness", "T"]].to_numpy(), pdf["implied_vol"].to_numpy(), targets[own])
        keep = np.flatnonzero(np.isfinite(z))
        return pd.DataFrame({DAY: pdf[DAY].iloc[0], "n": own[keep].astype("int32"), "iv_grid": z[keep]})

    bounded = locations.withColumn("block", F.lit(-1))
    if not heavy.isEmpty():
        heavy = small_side(heavy)
        bounded = bounded.join(heavy, DAY, "left_anti").unionByName(_active_points(locations.join(heavy, DAY, "left_semi"), targets, supports))
    solved = bounded.groupBy(DAY, "block").applyInPandas(solve, _SCHEMA)
    x_idx = (F.col("n") % grid.x_points).cast("int")
    t_idx = F.floor(F.col("n") / grid.x_points).cast("int")
    return solved.select(
        DAY, F.format_string("iv_x%02d_t%02d", x_idx, t_idx).alias("node"), x_idx.alias("x_idx"), t_idx.alias("t_idx"), "iv_grid"
    )


_COEFFICIENTS = [f"{c}{level}" for level in range(3) for c in "abc"]
_PLANES = f"quote_date date, block int, n int, {', '.join(f'{c} double' for c in _COEFFICIENTS)}, tolerance double"
CELLS_X, CELLS_T = 100, 50


def _active_points(points: DataFrame, targets: np.ndarray, supports: Callable) -> DataFrame:
    """(quote_date, block, point): for every block of nodes a subset of its day with the same triangles as the whole day.

    Starting from one point per grid cell, every round solves the subsets, then
    looks for the point deepest inside each circumcircle that the nodes depend on. Only the cells
    a circle reaches are searched: their bounding boxes are tested first, and
    the points of a reached cell come through an equi-join. A block whose circles hold no
    point, nor one that wins a tie, is done; rounds go on for the others.
    """

    def planes_of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        own = targets[block * BLOCK : (block + 1) * BLOCK]
        xy = pdf[["log_moneyness", "T"]].to_numpy()
        basis = supports(xy, own)
        plane, tolerance = _planes(*_lift(xy), basis)
        out = pd.DataFrame(np.hstack([plane[..., level] for level in range(3)]), columns=_COEFFICIENTS)
        out = out.assign(quote_date=pdf[DAY].iloc[0], block=np.int32(block), n=np.arange(len(basis), dtype="int32"), tolerance=tolerance)
        return out[[f.split()[0] for f in _PLANES.split(", ")]].astype({"block": "int32", "n": "int32"})

    x, t = F.col("_x"), F.col("_t")
    tie = sum((F.sin(F.lit(u) * x + F.lit(v) * t) for u, v in WAVES), F.lit(0.0))
    placed = points.withColumns(
        {
            "_i": F.floor(F.col("log_moneyness") * CELLS_X),
            "_j": F.floor(F.col("T") * CELLS_T),
            "_x": F.col("log_moneyness") - F.lit(float(ORIGIN[0])),
            "_t": F.col("T") - F.lit(float(ORIGIN[1])),
        }
    )
    placed = cut(placed.withColumn("_tie", tie))
    boxes = placed.groupBy(DAY, "_i", "_j").agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_t").alias("t0"), F.max("_t").alias("t1"))
    boxes = cut(boxes)
    fields = ["log_moneyness", "T", "implied_vol"]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-len(targets) // BLOCK) - 1)))
    start = placed.groupBy(DAY, "_i", "_j").agg(F.min(F.struct(*fields)).alias("p"))
    active = cut(start.select(DAY, blocks.alias("block"), "p.*"))

    def lowest(slope: str, lo: str, hi: str):
        """Smallest value of z * z - slope * z for z between lo and hi."""
        z = F.greatest(F.col(lo), F.least(F.col(hi), F.col(slope) / 2))
        return z * z - F.col(slope) * z

    def highest(slope: str, lo: str, hi: str):
        """Largest value of slope * z for z between lo and hi."""
        return F.greatest(F.col(slope) * F.col(lo), F.col(slope) * F.col(hi))

    # The levels' slacks of a point under a plane; the first two are also bounded over a box.
    height = F.col("_s") < -F.col("tolerance")
    level = F.when(F.col("_corner") < -CORNER, 0).when(
        F.col("_corner") <= CORNER, F.when(height, 1).when((F.col("_s") <= F.col("tolerance")) & (F.col("_third") < -TIED), 2)
    )
    most = highest("a0", "x0", "x1") + highest("b0", "t0", "t1") + F.col("c0")
    reaches = (most > CORNER) | ((most >= -CORNER) & (lowest("a1", "x0", "x1") + lowest("b1", "t0", "t1") - F.col("c1") <= F.col("tolerance")))
    settled = None
    while True:
        planes = cut(active.groupBy(DAY, "block").applyInPandas(planes_of_block, _PLANES))
        reached = small_side(planes).join(boxes, DAY).where(reaches).drop("x0", "x1", "t0", "t1")
        deepest = (
            placed.join(reached, [DAY, "_i", "_j"])
            .withColumns(
                {
                    "_corner": -(F.col("a0") * x + F.col("b0") * t + F.col("c0")),
                    "_s": x * x - F.col("a1") * x + t * t - F.col("b1") * t - F.col("c1"),
                    "_third": F.col("_tie") - F.col("a2") * x - F.col("b2") * t - F.col("c2"),
                }
            )
            .withColumn("_level", level)
            .where("_level is not null")
            .withColumn("_by", F.when(F.col("_level") == 0, F.col("_corner")).when(F.col("_level") == 1, F.col("_s")).otherwise(F.col("_third")))
            .groupBy(DAY, "block", "n")
            .agg(F.min(F.struct("_level", "_by", *fields)).alias("p"))
            .select(DAY, "block", *[F.col(f"p.{f}").alias(f) for f in fields])
        )
        fresh = cut(deepest.distinct().join(active, [DAY, "block", "log_moneyness", "T"], "left_anti"))
        still = fresh.select(DAY, "block").distinct()
        done = active.join(still, [DAY, "block"], "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if fresh.isEmpty():
            return settled
        active = cut(active.join(still, [DAY, "block"], "left_semi").unionByName(fresh))
