"""Nearest-neighbour join in the (log-moneyness, maturity) plane, one day at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import small_side
from ..plans.lineage import cut

STEP = 3  # a cell of one level is 8 x 8 cells of the next finer one
CROWD = 256  # distinct places that may share a finest cell before cells are made finer
FINEST = 8
FAR = 1 << 60  # places further out share border cells; boxes hold true coordinates, so results stay exact


def _cell(c: str, width: float) -> Column:
    return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(F.col(c) / F.lit(width))))


def _with_cells(places: DataFrame, x_scale: float, t_scale: float, finer: int) -> DataFrame:
    parts = 1 << (STEP * finer)
    return places.withColumns({"_cx": _cell("_px", x_scale / parts), "_ct": _cell("_pt", t_scale / parts)})


def _pyramid(places: DataFrame, day: str, x_scale: float, t_scale: float) -> tuple[DataFrame, list[DataFrame]]:
    """Places with their finest cell, and the bounding boxes of occupied cells from the finest level up to one of
    at most four cells a day. Both the finest width and the number of levels come from the data."""
    for finer in range(1, FINEST + 1):
        located = _with_cells(places, x_scale, t_scale, finer)
        crowd, reach = (
            located.groupBy(day, "_cx", "_ct")
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.max("n"), F.max(F.greatest(F.abs("_cx"), F.abs("_ct"))))
            .first()
        )
        if crowd is None or crowd <= CROWD:
            break
    corners = {"_x0": F.min, "_x1": F.max, "_t0": F.min, "_t1": F.max}
    boxes = located.withColumns({"_x0": F.col("_px"), "_x1": F.col("_px"), "_t0": F.col("_pt"), "_t1": F.col("_pt")})
    levels = []
    # An index of -8 ** k and all above is -1 or 0 after k steps.
    for level in range(1 + -(-int(reach or 0).bit_length() // STEP)):
        if level:
            boxes = boxes.withColumns({"_cx": F.shiftright("_cx", STEP), "_ct": F.shiftright("_ct", STEP)})
        boxes = boxes.groupBy(day, "_cx", "_ct").agg(*[f(c).alias(c) for c, f in corners.items()])
        levels.append(boxes)
    return located, levels


def _scaled(dx: Column, dt: Column, x_scale: float, t_scale: float) -> Column:
    return F.sqrt(F.pow(dx / F.lit(x_scale), F.lit(2.0)) + F.pow(dt / F.lit(t_scale), F.lit(2.0)))


def _descend(
    targets: DataFrame, levels: list[DataFrame], day: str, target_id: str, x_scale: float, t_scale: float, slack: float
) -> DataFrame:
    """The finest cells that can hold a target's closest place, found from the top level down."""
    def outside(c, lo, hi):
        return F.greatest(F.col(lo) - F.col(c), F.col(c) - F.col(hi), F.lit(0.0))

    def far(c, lo, hi):
        return F.greatest(F.abs(F.col(lo) - F.col(c)), F.abs(F.col(hi) - F.col(c)))

    near = _scaled(outside("_x", "_x0", "_x1"), outside("_t", "_t0", "_t1"), x_scale, t_scale)
    farthest = _scaled(far("_x", "_x0", "_x1"), far("_t", "_t0", "_t1"), x_scale, t_scale)
    per_target = Window.partitionBy(day, target_id)
    kept = None
    for boxes in reversed(levels):
        if kept is None:
            met = targets.join(boxes, day)
        else:
            parents = {"_up_x": F.shiftright("_cx", STEP), "_up_t": F.shiftright("_ct", STEP)}
            above = kept.withColumnsRenamed({"_cx": "_up_x", "_ct": "_up_t"})
            met = above.join(boxes.withColumns(parents), [day, "_up_x", "_up_t"])
        kept = (
            met.withColumns({"_near": near, "_bound": F.min(farthest).over(per_target)})
            .where(F.col("_near") <= F.col("_bound") * (1 + 1e-9) + slack + 1e-9)
            .select(day, target_id, "_x", "_t", "_cx", "_ct")
        )
    return kept


def nearest(
    targets: DataFrame,
    points: DataFrame,
    day: str,
    target_id: str,
    key: str,
    x: str = "log_moneyness",
    t: str = "T",
    x_scale: float = 0.02,
    t_scale: float = 0.05,
    tie_tolerance: float = 1e-12,
) -> DataFrame:
    """For each (day, target) the closest point of that day under the scaled
    Euclidean distance; among points within the tolerance of the minimum, the
    smallest key. Returns day, target_id, `mapping_distance`, key. Points and
    targets without finite coordinates match nothing.

    The day's distinct places form a pyramid of cells. A target starts at the
    at most four cells of the top and descends: of the cells it has kept it
    meets the children, and keeps those whose nearest possible place could beat
    the farthest corner of some other child. So it meets a few cells a level and
    the places of a few finest cells, however many the day has. The result is exact.
    """
    def finite(*columns):
        return F.greatest(*[F.abs(c) for c in columns]) < F.lit(float("inf"))

    targets = targets.select(day, target_id, F.col(x).alias("_x"), F.col(t).alias("_t")).distinct().where(
        F.col("_x").isNotNull() & F.col("_t").isNotNull() & finite("_x", "_t")
    )
    # Distinct places first: only numbers are grouped, which stays a hash aggregation.
    places = points.select(day, F.col(key).alias("_key"), F.col(x).cast("double").alias("_px"), F.col(t).cast("double").alias("_pt")).where(
        F.col("_px").isNotNull() & F.col("_pt").isNotNull() & finite("_px", "_pt")
    )
    located, levels = _pyramid(cut(places.select(day, "_px", "_pt").distinct()), day, x_scale, t_scale)

    cells = _descend(targets, levels, day, target_id, x_scale, t_scale, tie_tolerance)
    distances = cut(
        cells.join(located, [day, "_cx", "_ct"]).select(
            day, target_id, "_px", "_pt", _scaled(F.col("_px") - F.col("_x"), F.col("_pt") - F.col("_t"), x_scale, t_scale).alias("_d")
        )
    )
    closest = (
        distances.withColumn("mapping_distance", F.min("_d").over(Window.partitionBy(day, target_id)))
        .where(F.col("_d") - F.col("mapping_distance") <= tie_tolerance)
        .drop("_d")
    )
    # Few rows are left, so the keys at those places are found by scanning the points.
    return (
        places.join(small_side(cut(closest)), [day, "_px", "_pt"])
        .groupBy(day, target_id)
        .agg(F.min("mapping_distance").alias("mapping_distance"), F.min("_key").alias(key))
    )
