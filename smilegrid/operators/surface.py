"""Daily implied-volatility surfaces on a fixed moneyness and maturity grid."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.sizing import median_by, small_side
from ..settings import Grid
from .cubic import cubic_surface
from .delaunay import delaunay_surface
from .nearest import nearest

DAY = "quote_date"


def node_name(x_idx, t_idx) -> Column:
    return F.format_string("iv_x%02d_t%02d", N.col(x_idx).cast("int"), N.col(t_idx).cast("int"))


def _axis(index: Column, start: float, stop: float, points: int) -> Column:
    step = (stop - start) / (points - 1)
    return F.when(index == points - 1, F.lit(float(stop))).otherwise(F.lit(float(start)) + index * F.lit(step))


def grid_nodes(spark: SparkSession, grid: Grid = Grid()) -> DataFrame:
    """The node table: maturity outer, moneyness inner."""
    n = F.col("id")
    x_idx, t_idx = (n % grid.x_points).cast("int"), F.floor(n / grid.x_points).cast("int")
    return spark.range(0, grid.x_points * grid.t_points, 1, 1).select(
        node_name(x_idx, t_idx).alias("node"),
        x_idx.alias("x_idx"),
        t_idx.alias("t_idx"),
        _axis(x_idx, grid.x_min, grid.x_max, grid.x_points).alias("log_moneyness"),
        _axis(t_idx, grid.t_min, grid.t_max, grid.t_points).alias("T"),
    )


def surface_points(
    quotes: DataFrame,
    grid: Grid = Grid(),
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
) -> DataFrame:
    """Usable surface observations: finite positive volatility and moneyness inside
    the grid box (both ends included).

    Moneyness and maturity come from the first source the table offers:
    `k_over_s`, `moneyness`, strike over `spot`, or strike over the underlying
    midpoint; `T`, or the dates.
    """
    have = set(quotes.columns)
    if "implied_vol" not in have or DAY not in have:
        raise ValueError("surface points need quote_date and implied_vol")
    df = quotes.withColumn(DAY, X.as_date(quotes, DAY))
    if "T" in have:
        t = N.number("T")
    elif "expiration" in have:
        t = N.year_fraction(F.col(DAY), X.as_date(quotes, "expiration"))
    else:
        raise ValueError("neither T nor expiration is available")
    if "k_over_s" in have:
        k = N.number("k_over_s")
    elif "moneyness" in have:
        k = N.number("moneyness")
    elif "spot" in have:
        k = N.number("strike") / F.nullif(N.number("spot"), F.lit(0.0))
    elif {"underlying_bid_1545", "underlying_ask_1545"} <= have:
        middle = N.midpoint(N.number("underlying_bid_1545"), N.number("underlying_ask_1545"))
        k = N.number("strike") / F.nullif(middle, F.lit(0.0))
    else:
        raise ValueError("moneyness cannot be derived from this table")
    df = df.select(DAY, N.log_moneyness(k).alias("log_moneyness"), t.alias("T"), N.number("implied_vol").alias("implied_vol"))
    df = df.where(
        F.col(DAY).isNotNull()
        & (F.col("implied_vol") > 0)
        & F.col("log_moneyness").between(grid.x_min, grid.x_max)
        & F.col("T").between(grid.t_min, grid.t_max)
    )
    if date_from is not None:
        df = df.where(F.col(DAY) >= F.lit(date_from))
    if date_to is not None:
        df = df.where(F.col(DAY) <= F.lit(date_to))
    return df


def unique_locations(points: DataFrame) -> DataFrame:
    """One median volatility per day and location, with its number of quotes."""
    keys = [DAY, "log_moneyness", "T"]
    return median_by(points, keys, "implied_vol", "implied_vol", "n_quotes")


def location_counts(locations: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Raw and distinct location counts per day."""
    return (
        locations.groupBy(DAY)
        .agg(F.sum("n_quotes").alias("n_obs_raw"), F.count(F.lit(1)).alias("n_obs_unique"))
        .withColumn("enough", F.col("n_obs_unique") >= grid.min_points_day)
    )


def lerp_to_axis(
    df: DataFrame, keys: list[str], coordinate: str, value: str, start: float, stop: float, points: int, index: str
) -> DataFrame:
    """Linear interpolation of each key's points onto a fixed axis.

    A node takes the closest point at or below it and the closest at or above
    it; without both it has no row. Each point is assigned to the gap between
    two nodes and only the extremes of a gap survive the partial aggregation, so
    a key ships at most two rows per node however many points it has.
    """
    step = (stop - start) / (points - 1)
    at = lambda i: _axis(i, start, stop, points)
    c = F.col(coordinate)
    rough = F.greatest(F.lit(0), F.least(F.lit(points), F.ceil((c - start) / step)))
    up = (
        F.when((rough > 0) & (at(rough - 1) >= c), rough - 1)
        .when((rough < points) & (at(rough) < c), rough + 1)
        .otherwise(rough)
    )
    df = df.withColumn("_up", up.cast("int"))
    df = df.withColumn("_down", F.when((F.col("_up") < points) & (at(F.col("_up")) == c), F.col("_up")).otherwise(F.col("_up") - 1))
    gaps = df.groupBy(*keys, "_up", "_down").agg(
        F.max(coordinate).alias("_hi"),
        F.max_by(value, coordinate).alias("_hi_v"),
        F.min(coordinate).alias("_lo"),
        F.min_by(value, coordinate).alias("_lo_v"),
    )
    gathered = gaps.groupBy(*keys).agg(F.collect_list(F.struct("_up", "_down", "_hi", "_hi_v", "_lo", "_lo_v")).alias("_gaps"))

    def node(i):
        below = F.filter("_gaps", lambda g: g["_up"] <= i)
        above = F.filter("_gaps", lambda g: g["_down"] >= i)
        return F.struct(
            i.cast("int").alias("i"),
            F.array_max(F.transform(below, lambda g: F.struct(g["_hi"].alias("c"), g["_hi_v"].alias("v")))).alias("a"),
            F.array_min(F.transform(above, lambda g: F.struct(g["_lo"].alias("c"), g["_lo_v"].alias("v")))).alias("b"),
        )

    nodes = gathered.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), node)).alias("n"))
    a, b = F.col("n.a"), F.col("n.b")
    weight = (at(F.col("n.i")) - a["c"]) / (b["c"] - a["c"])
    return nodes.where(a.isNotNull() & b.isNotNull()).select(
        *keys,
        F.col("n.i").alias(index),
        F.when(a["c"] == b["c"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * weight).alias(value),
    )


def separable_surface(locations: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Interpolate along moneyness inside each observed maturity, then along
    maturity. Nothing is extrapolated: a node without both neighbours is absent."""
    slices = lerp_to_axis(
        locations, [DAY, "T"], "log_moneyness", "implied_vol", grid.x_min, grid.x_max, grid.x_points, "x_idx"
    )
    surface = lerp_to_axis(slices, [DAY, "x_idx"], "T", "implied_vol", grid.t_min, grid.t_max, grid.t_points, "t_idx")
    return surface.select(DAY, node_name("x_idx", "t_idx").alias("node"), "x_idx", "t_idx", F.col("implied_vol").alias("iv_grid"))


def on_every_node(surface: DataFrame, days: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """All grid nodes of the given days; nodes without a value stay NULL."""
    index = F.sequence(F.lit(0), F.lit(grid.x_points * grid.t_points - 1))
    full = days.select(DAY, F.explode(index).alias("n")).select(
        DAY, (F.col("n") % grid.x_points).cast("int").alias("x_idx"), F.floor(F.col("n") / grid.x_points).cast("int").alias("t_idx")
    )
    full = full.select(
        DAY,
        node_name("x_idx", "t_idx").alias("node"),
        "x_idx",
        "t_idx",
        _axis(F.col("x_idx"), grid.x_min, grid.x_max, grid.x_points).alias("log_moneyness"),
        _axis(F.col("t_idx"), grid.t_min, grid.t_max, grid.t_points).alias("T"),
    )
    return full.join(surface.select(DAY, "node", "iv_grid"), [DAY, "node"], "left")


def fill_nearest(nodes: DataFrame, locations: DataFrame) -> DataFrame:
    """Fill missing nodes from the nearest observation of the day (plain distance;
    equally near observations resolve to the smaller moneyness, then maturity)."""
    keyed = locations.withColumn("_at", F.struct("log_moneyness", "T"))
    holes = nodes.where(F.col("iv_grid").isNull())
    near = nearest(holes, keyed, DAY, "node", "_at", x_scale=1.0, t_scale=1.0, tie_tolerance=0.0)
    near = near.select(DAY, "node", F.col("_at.log_moneyness").alias("_x"), F.col("_at.T").alias("_t"))
    values = locations.select(
        DAY, F.col("log_moneyness").alias("_x"), F.col("T").alias("_t"), F.col("implied_vol").alias("_fill")
    )
    filled = near.join(values, [DAY, "_x", "_t"]).select(DAY, "node", "_fill")
    return nodes.join(filled, [DAY, "node"], "left").withColumn("iv_grid", F.coalesce("iv_grid", "_fill")).drop("_fill")


def smooth(nodes: DataFrame, sigma: float, grid: Grid = Grid(), truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing of observed nodes, normalised by the smoothed mask, with
    mirrored edges. Two one-dimensional passes; sigma <= 0 leaves the surface as is."""
    if sigma <= 0:
        return nodes
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = F.array(*[F.lit(w / sum(raw)) for w in raw])

    def mirrored(i: Column, n: int) -> Column:
        j = F.pmod(i, F.lit(2 * n))
        return F.when(j < n, j).otherwise(2 * n - 1 - j).cast("int")

    df = nodes.select(
        DAY,
        "x_idx",
        "t_idx",
        F.when(N.finite("iv_grid"), F.col("iv_grid")).otherwise(0.0).alias("_v"),
        N.finite("iv_grid").cast("double").alias("_m"),
    )
    for axis, points, other in (("x_idx", grid.x_points, "t_idx"), ("t_idx", grid.t_points, "x_idx")):
        # A target at i reads the cells i + k, mirrored at the edges: list the
        # cells each target reads, then meet them by an equi-join on the index.
        spark = nodes.sparkSession
        reads = spark.range(0, points, 1, 1).select(
            F.col("id").cast("int").alias("_to"),
            F.posexplode(F.sequence(F.col("id").cast("int") - radius, F.col("id").cast("int") + radius)).alias("_k", "_i"),
        )
        reads = reads.select("_to", F.element_at(weights, F.col("_k") + 1).alias("_w"), mirrored(F.col("_i"), points).alias(axis))
        reads = reads.groupBy("_to", axis).agg(F.sum("_w").alias("_w"))
        df = (
            df.join(F.broadcast(reads), axis)  # at most points ** 2 rows by construction
            .groupBy(DAY, other, F.col("_to").alias(axis))
            .agg(F.sum(F.col("_w") * F.col("_v")).alias("_v"), F.sum(F.col("_w") * F.col("_m")).alias("_m"))
        )
    smoothed = df.select(DAY, "x_idx", "t_idx", F.when(F.col("_m") >= 1e-6, F.col("_v") / F.col("_m")).alias("_s"))
    return nodes.join(smoothed, [DAY, "x_idx", "t_idx"], "left").withColumn("iv_grid", F.col("_s")).drop("_s")


def build_surface(
    locations: DataFrame,
    grid: Grid = Grid(),
    method: str = "separable",
    fill: bool = False,
    sigma: float = 0.0,
) -> DataFrame:
    """Every node of every day with enough distinct locations.

    `locations` (from `unique_locations`) is read more than once; pass a
    materialised table.
    """
    days = location_counts(locations, grid).where("enough").select(DAY)
    usable = locations.join(small_side(days), DAY, "left_semi")
    if method == "separable":
        surface = separable_surface(usable, grid)
    elif method == "delaunay":
        surface = delaunay_surface(usable, grid)
    elif method == "cubic":
        surface = cubic_surface(usable, grid)
    else:
        raise ValueError("method must be 'separable', 'delaunay' or 'cubic'")
    nodes = on_every_node(surface, days, grid)
    if fill:
        nodes = fill_nearest(nodes, usable)
    return smooth(nodes, sigma, grid)


def day_stats(locations: DataFrame, nodes: DataFrame, grid: Grid = Grid(), used: str = "separable") -> DataFrame:
    """Counts, coverage and keep/skip status per day."""
    coverage = nodes.groupBy(DAY).agg(F.avg(N.finite("iv_grid").cast("double")).alias("coverage"))
    counts = location_counts(locations, grid)
    status = (
        F.when(~F.col("enough"), "skipped_min_points")
        .when(F.col("coverage") >= grid.min_coverage, "kept")
        .otherwise("skipped_min_coverage")
    )
    return counts.join(coverage, DAY, "left").select(
        DAY,
        "n_obs_raw",
        "n_obs_unique",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        status.alias("status"),
        F.when(F.col("enough"), used).otherwise("").alias("interp_used"),
    )


def kept_nodes(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    return nodes.join(small_side(stats.where("status = 'kept'").select(DAY)), DAY, "left_semi")


def surface_summary(nodes: DataFrame) -> DataFrame:
    """Coverage statistics over the kept days, one row."""
    daily = nodes.groupBy(DAY).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(N.finite("iv_grid")).alias("observed")
    ).withColumn("coverage", F.col("observed") / F.col("cells"))
    return daily.agg(
        F.count(F.lit(1)).alias("grid_dates"),
        F.max("cells").alias("grid_nodes"),
        F.sum("cells").alias("potential_grid_observations"),
        F.sum("observed").alias("non_missing_grid_observations"),
        F.avg("coverage").alias("coverage_mean"),
        F.median("coverage").alias("coverage_median"),
        F.min("coverage").alias("coverage_min"),
        F.max("coverage").alias("coverage_max"),
        F.min(DAY).alias("first_date"),
        F.max(DAY).alias("last_date"),
    )


def to_wide(nodes: DataFrame, names: list[str]) -> DataFrame:
    """One column per node. The names are passed in, so no job has to collect them."""
    return nodes.groupBy(DAY).pivot("node", names).agg(F.first("iv_grid", ignorenulls=True))


def to_long(wide: DataFrame, names: list[str]) -> DataFrame:
    """Back to one row per day and node; missing cells are kept."""
    return wide.unpivot([DAY], names, "node", "iv_grid")
