"""Size checks for broadcasts, exact quantiles and rank statistics that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

BROADCAST_ROWS = 200_000
SKETCH = 64  # values a key's first quantile sketch holds exactly
FINE_SKETCH = 512  # the same for sketches of the few keys that have more


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a join side for broadcast only after counting that it is small.

    Beyond the bound the frame is returned unchanged and the planner joins by
    shuffle (with adaptive skew handling) instead.
    """
    few = df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def _proposals(sketch: str, size: int, n: Column) -> Column:
    """`_values`: the sketch's values at the middles of 2 * size equal intervals of ranks (ranks must be constants)."""
    ranks = F.expr(f"array({', '.join(f'{(j + 0.5) / (2 * size)!r}D' for j in range(2 * size))})")
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, ranks)).alias("_values")


def _at(share: Column, size: int) -> Column:
    """The proposal nearest to a rank share. At share (i + 0.5) / n that is value i of n, exactly, while the sketch
    holds all n <= size values: a middle lies in each value's interval of ranks, which is two middles wide."""
    slot = F.floor(share * (2 * size))
    return F.col("_values")[F.least(F.lit(2 * size - 1), F.greatest(F.lit(0), slot)).cast("int")]


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], count: str | None = None, sketch: int = SKETCH
) -> DataFrame:
    """Exact linear-interpolated quantiles per key (and the key's number of rows, if `count` names it).

    One aggregation builds a mergeable sketch per key. A key of at most `sketch` values is held whole by it, which
    settles the key. For the others the sketch only proposes two values around each wanted order statistic; the rows
    are counted below, at, between and above them, which tells for certain where the statistic lies, and sketched
    there again. Every round leaves a few per cent of a key's rows, and no task ever holds a key's values, be it a
    third of the table or one value throughout. Missing values are ignored (a key without others gets NULL), a NULL
    key part is a key like any other, and NaN must have become NULL before.

    Reads `df` again in each round, so it should be a table and not a long unmaterialised plan.
    """
    rows = df.select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_v"))
    first = cut(
        rows.groupBy("_key")
        .agg(
            F.kll_sketch_agg_double("_v", F.lit(sketch)).alias("_sketch"),
            F.count("_v").alias("_in"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .select("_key", _proposals("_sketch", sketch, F.col("_in")), "_in", "_rows")
    )
    size = [] if count is None else [F.col("_rows").alias(count)]
    named = [F.col("_key")[k].alias(k) for k in keys]

    def between(low: Column, high: Column, p: float) -> Column:
        position = F.lit(float(p)) * (F.col("_in") - 1)
        return low + (position - F.floor(position)) * (high - low)

    def ends(p: float) -> tuple[Column, Column]:
        position = F.lit(float(p)) * (F.col("_in") - 1)
        return F.floor(position), F.ceil(position)

    held = first.where(F.col("_in") <= sketch).select(
        *named,
        *[between(*[_at((rank + 0.5) / F.col("_in"), sketch) for rank in ends(p)], p).alias(name) for name, p in quantiles.items()],
        *size,
    )
    large = first.where(F.col("_in") > sketch)
    if large.isEmpty():
        return held
    wanted = F.array_distinct(F.array(*[rank for p in quantiles.values() for rank in ends(p)]))
    found = _order_statistics(rows, large.select("_key", F.explode(wanted).alias("_rank"), "_in", "_values"), sketch)
    by_rank = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_settled"))
    settled = large.join(by_rank, "_key").select(
        *named,
        *[between(*[F.col("_settled")[rank] for rank in ends(p)], p).alias(name) for name, p in quantiles.items()],
        *size,
    )
    return held.unionByName(settled)


def _order_statistics(rows: DataFrame, wanted: DataFrame, sketch: int) -> DataFrame:
    """(_key, _rank, _value) for ranks of keys that their sketches do not hold whole.

    A wanted rank carries the open interval (_a, _b) known to hold it, the number `_below` of the key's values up to
    `_a`, the number `_in` inside and proposed values from a sketch of those. The proposed values lie inside the
    interval, so each round removes at least them, whatever the sketch's luck was.
    """
    nothing = F.lit(None).cast("double")
    state = wanted.withColumns({"_a": nothing, "_b": nothing, "_below": F.lit(0).cast("long")})
    found, finer = None, FINE_SKETCH
    while True:
        share = (F.col("_rank") - F.col("_below") + 0.5) / F.col("_in")
        # Sketches are random, so their proposals are stored before any row is compared with them.
        brackets = cut(
            state.select(
                "_key", "_rank", "_a", "_b", "_below", "_in",
                _at(share - 4.0 / sketch, sketch).alias("_lo"),
                _at(share + 4.0 / sketch, sketch).alias("_hi"),
            )
        )
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        parts = {"under": v < lo, "mid": (v > lo) & (v < hi), "over": v > hi}
        counted = (
            _with_brackets(rows, brackets)
            .where((F.col("_a").isNull() | (v > F.col("_a"))) & (F.col("_b").isNull() | (v < F.col("_b"))))
            .groupBy("_key", "_rank", "_a", "_b", "_below", "_lo", "_hi")
            .agg(
                F.count_if(v == lo).alias("_n_lo"),
                F.count_if((v == hi) & (lo < hi)).alias("_n_hi"),
                *[F.count_if(inside).alias(f"_n_{part}") for part, inside in parts.items()],
                *[F.kll_sketch_agg_double(F.when(inside, v), F.lit(finer)).alias(f"_s_{part}") for part, inside in parts.items()],
            )
        )
        place = F.col("_rank") - F.col("_below")
        steps = ["_n_under", "_n_lo", "_n_mid", "_n_hi"]
        upto = [sum((F.col(c) for c in steps[1 : k + 1]), F.col(steps[0])) for k in range(4)]

        def choose(under, at_lo, mid, at_hi, over):
            return (
                F.when(place < upto[0], under).when(place < upto[1], at_lo).when(place < upto[2], mid)
                .when(place < upto[3], at_hi).otherwise(over)
            )

        none = F.lit(None)
        moved = counted.select(
            "_key",
            "_rank",
            choose(F.col("_a"), none, lo, none, hi).alias("_a"),
            choose(lo, none, hi, none, F.col("_b")).alias("_b"),
            (F.col("_below") + choose(F.lit(0), F.lit(0), upto[1], F.lit(0), upto[3])).alias("_below"),
            choose(F.col("_n_under"), F.lit(0), F.col("_n_mid"), F.lit(0), F.col("_n_over")).alias("_in"),
            choose(F.col("_s_under"), none, F.col("_s_mid"), none, F.col("_s_over")).alias("_sketch"),
            choose(none, lo, none, hi, none).alias("_value"),
        )
        proposed = _proposals("_sketch", finer, F.col("_in"))
        moved = cut(moved.select("_key", "_rank", "_a", "_b", "_below", "_in", proposed, "_value"))
        sketch = finer
        inner = _at((F.col("_rank") - F.col("_below") + 0.5) / F.col("_in"), sketch)
        done = moved.where(F.col("_in") <= sketch).select("_key", "_rank", F.coalesce("_value", inner).alias("_value"))
        found = done if found is None else found.unionByName(done)
        state = moved.where(F.col("_in") > sketch).drop("_value")
        if state.isEmpty():
            return found


def _with_brackets(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Rows with the brackets of their key. Brackets that hold more than 1 / BROADCAST_ROWS of all rows sought are
    broadcast, and there are fewer than BROADCAST_ROWS of those; the keys of the others fit a task and are shuffled."""
    sought = F.lit(brackets.agg(F.sum("_in")).first()[0] / BROADCAST_ROWS)
    # All ranks of a key go the same way.
    largest = brackets.withColumn("_most", F.max("_in").over(Window.partitionBy("_key")))
    hot = F.broadcast(largest.where(F.col("_most") > sought).drop("_most", "_in"))
    rest = largest.where(F.col("_most") <= sought).drop("_most", "_in")
    met = rows.join(hot, "_key")
    if rest.isEmpty():
        return met
    return met.unionByName(rows.join(hot.select("_key"), "_key", "left_anti").join(rest, "_key"))


def median_by(df: DataFrame, keys: list[str], value: str, name: str, count: str, **options) -> DataFrame:
    """Exact median and number of rows per key, by `exact_quantiles`."""
    return exact_quantiles(df, keys, value, {name: 0.5}, count, **options)


def mean_rank(value: str, partition: list[str]) -> Column:
    """Rank with ties averaged, for Spearman correlation."""
    by_value = Window.partitionBy(*partition).orderBy(value)
    same = Window.partitionBy(*partition, value)
    return F.rank().over(by_value) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)


def quantile(value, p: float) -> Column:
    """Linear-interpolated quantile for report-size groups (one value per model and session)."""
    return F.percentile(F.col(value) if isinstance(value, str) else value, F.lit(float(p)))
