"""HAC inference, circular block bootstrap, model confidence set and multiple testing.

These run on series with one value per trading session, so each group is bounded
by the calendar; the volume lies in the number of groups and replications.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.sizing import mean_rank, quantile
from ..plans.lineage import cut


def _or_raise(valid: Column, value: Column, message: str, strict: bool) -> Column:
    if not strict:
        return F.when(valid, value)
    return F.when(valid, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def hac_test(
    df: DataFrame,
    keys: list[str],
    value: str,
    order: str,
    lag: int = 5,
    reference: str = "normal",
    strict: bool = False,
) -> DataFrame:
    """Mean of a series with a Bartlett-weighted HAC standard error.

    `normal`: needs at least max(7, lag + 2) finite values; an invalid sample
    gives NULLs (or an error when strict). `student`: drops missing values and
    needs two. Both apply the n / (n - 1) correction.
    """
    if reference == "student":
        df = df.where(N.finite(value))
    by_key = Window.partitionBy(*keys)
    in_order = by_key.orderBy(order)
    x = F.col(value).cast("double")
    u = df.select(*keys, order, x.alias("_x"), (x - F.avg(x).over(by_key)).alias("_u"))
    lagged = u.withColumns({f"_u{k}": F.lag("_u", k).over(in_order) for k in range(1, lag + 1)})
    sums = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(N.finite("_x")).alias("_finite"),
        F.avg("_x").alias("mean"),
        F.median("_x").alias("median"),
        F.sum(F.col("_u") * F.col("_u")).alias("_g0"),
        *[F.coalesce(F.sum(F.col("_u") * F.col(f"_u{k}")), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lag + 1)],
    )
    meat = F.col("_g0")
    for k in range(1, lag + 1):
        meat = meat + 2 * (1 - k / (lag + 1)) * F.col(f"_g{k}")
    n = F.col("n").cast("double")
    least = 2 if reference == "student" else max(7, lag + 2)
    valid = (F.col("n") >= least) & (F.col("_finite") == F.col("n"))
    out = sums.withColumn("_se", F.sqrt(N.div(meat, n * (n - 1))))
    out = out.withColumn("_t", N.div("mean", "_se"))
    p = N.student_p("_t", F.col("n") - 1) if reference == "student" else N.two_sided_normal_p("_t")
    message = "invalid inference sample"
    guard = lambda c: _or_raise(valid, c, message, strict)
    return out.select(
        *keys,
        F.col("n"),
        guard(F.col("mean")).alias("mean"),
        guard(F.col("median")).alias("median"),
        guard(F.col("_se")).alias("HAC_standard_error"),
        guard(F.col("_t")).alias("HAC_t_stat"),
        guard(p).alias("raw_p"),
        F.lit(lag).alias("HAC_lag"),
    )


def with_adjusted_p(df: DataFrame, family: list[str], p: str = "raw_p", tie: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Holm step-down and Benjamini-Hochberg step-up p-values inside each family.

    A missing or out-of-range p-value is an error: it would silently change the
    family size.
    """
    bad = ~N.finite(p) | (F.col(p) < 0) | (F.col(p) > 1)
    checked = F.when(bad, F.raise_error(F.lit("a family of tests holds a p value outside 0 to 1 or none")).cast("double")).otherwise(F.col(p))
    upward = Window.partitionBy(*family).orderBy("_p", *tie)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    df = df.withColumn("_p", checked)
    df = df.withColumns({"_rank": F.row_number().over(upward), "family_size": size})
    df = df.withColumns(
        {
            "_holm": F.col("_p") * (F.col("family_size") - F.col("_rank") + 1),
            "_bh": F.col("_p") * F.col("family_size") / F.col("_rank"),
        }
    )
    by_rank = Window.partitionBy(*family).orderBy("_rank")
    df = df.withColumns(
        {
            "holm_adjusted_p": F.least(F.lit(1.0), F.max("_holm").over(by_rank.rowsBetween(Window.unboundedPreceding, 0))),
            "BH_adjusted_p": F.least(F.lit(1.0), F.min("_bh").over(by_rank.rowsBetween(0, Window.unboundedFollowing))),
        }
    )
    return df.withColumns(
        {
            "holm_reject_5pct": F.col("holm_adjusted_p") <= alpha,
            "BH_reject_5pct": F.col("BH_adjusted_p") <= alpha,
        }
    ).drop("_p", "_rank", "_holm", "_bh")


def block_start(seed: int, rep: Column, block_no: Column) -> Column:
    """A reproducible pseudo-random integer per (seed, replication, block), derived
    from a digest so that any engine can recompute it."""
    text = F.concat_ws("-", F.lit(str(seed)), rep.cast("string"), block_no.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def resampled_sums(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    order: str,
    block: int = 5,
    reps: int = 4000,
    seed: int = 42,
    tasks: int | None = None,
) -> DataFrame:
    """Sums of each column over circular block resamples: (keys, rep, n, columns).

    Every replication draws ceil(n / block) blocks and keeps the first n
    positions. A block sum is the difference of two prefix sums, so a
    replication costs one lookup per block instead of one joined row per
    position. A key's prefix sums are one array, bounded by the calendar.
    """
    by_key = Window.partitionBy(*keys)
    series = df.select(
        *keys,
        *columns,
        (F.row_number().over(by_key.orderBy(order)) - 1).alias("_pos"),
        F.count(F.lit(1)).over(by_key).alias("n"),
    )
    wrapped = F.least(F.lit(block), F.col("n")) - 1
    places = F.when(F.col("_pos") < wrapped, F.array(F.col("_pos"), (F.col("_pos") + F.col("n")).cast("int"))).otherwise(
        F.array(F.col("_pos"))
    )
    running = by_key.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    prefixed = series.select(*keys, *columns, "n", F.explode(places).alias("_at")).select(
        *keys, "n", "_at", *[F.sum(c).over(running).alias(c) for c in columns]
    )
    packed = prefixed.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("_at", *columns))).alias("_sorted"))
    prefix = lambda c: F.concat(F.array(F.lit(0.0)), F.col(f"_sorted.{c}").cast("array<double>"))
    packed = packed.select(*keys, "n", *[prefix(c).alias(c) for c in columns])
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    per_chunk = math.ceil(reps / tasks)
    spread = packed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(
        tasks, *keys, "_chunk"
    )
    first = F.col("_chunk") * per_chunk
    last = F.least(first + per_chunk, F.lit(reps)) - 1
    numbered = spread.where(first < reps).select(
        *keys, "n", *columns, F.explode(F.sequence(first, last)).alias("rep")
    )
    blocks = F.ceil(F.col("n") / F.lit(float(block)))
    drawn = numbered.withColumn(
        "_starts",
        F.transform(
            F.sequence(F.lit(0).cast("long"), blocks - 1),
            lambda k: F.struct(
                (block_start(seed, F.col("rep"), k) % F.col("n")).cast("int").alias("s"),
                F.least(F.lit(block).cast("long"), F.col("n") - k * block).cast("int").alias("len"),
            ),
        ),
    )

    def total(c: str) -> Column:
        return F.aggregate(
            "_starts",
            F.lit(0.0),
            lambda acc, b: acc + F.get(F.col(c), b["s"] + b["len"]) - F.get(F.col(c), b["s"]),
        )

    return drawn.select(*keys, "rep", "n", *[total(c).alias(c) for c in columns])


def bootstrap_mean_sharpe(
    df: DataFrame,
    keys: list[str],
    value: str,
    order: str,
    block: int = 5,
    reps: int = 4000,
    seed: int = 42,
    periods: float = 252.0,
) -> DataFrame:
    """95% intervals of the mean and the annualised Sharpe ratio."""
    centre = F.avg(value).over(Window.partitionBy(*keys))
    centred = df.select(*keys, order, (F.col(value) - centre).alias("_y"), centre.alias("_m"))
    centred = centred.withColumn("_yy", F.col("_y") * F.col("_y"))
    sums = resampled_sums(centred, keys, ["_y", "_yy", "_m"], order, block, reps, seed)
    n = F.col("n").cast("double")
    mean = (F.col("_m") + F.col("_y")) / n
    variance = N.div(F.col("_yy") - F.col("_y") * F.col("_y") / n, n - 1)
    spread = F.when(variance > 0, F.sqrt(variance))
    draws = sums.select(*keys, mean.alias("mean"), (math.sqrt(periods) * N.div(mean, spread)).alias("sharpe"))
    return draws.groupBy(*keys).agg(
        quantile("mean", 0.025).alias("bootstrap_mean_CI_low"),
        quantile("mean", 0.975).alias("bootstrap_mean_CI_high"),
        quantile("sharpe", 0.025).alias("bootstrap_sharpe_CI_low"),
        quantile("sharpe", 0.975).alias("bootstrap_sharpe_CI_high"),
    ).withColumns(
        {
            "bootstrap_block_length": F.lit(block),
            "bootstrap_repetitions": F.lit(reps),
            "bootstrap_seed": F.lit(seed),
        }
    )


def bootstrap_sensitivity(df, keys, value, order, blocks=(5, 10), **options) -> DataFrame:
    """The same intervals at several block lengths."""
    out = None
    for block in blocks:
        part = bootstrap_mean_sharpe(df, keys, value, order, block=block, **options)
        out = part if out is None else out.unionByName(part)
    return out


def metric_intervals(
    daily: DataFrame, order: str = "forecast_target_date", block: int = 5, reps: int = 2000, seed: int = 42
) -> DataFrame:
    """Bootstrap intervals of RMSE, MAE and QLIKE from daily loss sums and counts;
    whole dates are resampled, so nodes of one date stay together."""
    columns = ["sum_SE", "sum_AE", "sum_QLIKE", "n_common", "n_qlike"]
    typed = daily.select("model", order, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in columns])
    sums = resampled_sums(typed, ["model"], columns, order, block, reps, seed)
    values = sums.select(
        "model",
        F.explode(
            F.array(
                F.struct(F.lit("RMSE").alias("metric"), F.sqrt(N.div("sum_SE", "n_common")).alias("v")),
                F.struct(F.lit("MAE").alias("metric"), N.div("sum_AE", "n_common").alias("v")),
                F.struct(F.lit("QLIKE").alias("metric"), N.div("sum_QLIKE", "n_qlike").alias("v")),
            )
        ).alias("m"),
    )
    return values.groupBy("model", F.col("m.metric").alias("metric")).agg(
        quantile(F.col("m.v"), 0.025).alias("lower_95"), quantile(F.col("m.v"), 0.975).alias("upper_95")
    ).withColumns({"block_length": F.lit(block), "reps": F.lit(reps), "seed": F.lit(seed)})


def loss_panel(daily: DataFrame, models: list[str], day: str = "forecast_target_date") -> DataFrame:
    """Complete-date loss matrix in long blocks: loss, day, one column per model."""
    long = daily.select(
        day,
        "model",
        F.explode(
            F.array(*[F.struct(F.lit(x).alias("loss"), F.col(f"L_{x}").alias("value")) for x in ("SE", "AE", "QLIKE")])
        ).alias("l"),
    ).select(day, "model", "l.loss", "l.value")
    wide = long.groupBy("loss", day).agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in models])
    return wide.dropna(subset=models)


def diebold_mariano(panel: DataFrame, models: list[str], day: str = "forecast_target_date", lag: int = 5, alpha: float = 0.05) -> DataFrame:
    """HAC test of the daily loss difference of every model pair."""
    pairs = panel.select(
        "loss",
        day,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), (F.col(a) - F.col(b)).alias("d"))
                    for a, b in combinations(models, 2)
                ]
            )
        ).alias("p"),
    ).select("loss", day, "p.*")
    test = hac_test(pairs, ["loss", "model_a", "model_b"], "d", day, lag, reference="student")
    return test.select(
        "loss",
        "model_a",
        "model_b",
        F.col("mean").alias("mean_loss_differential"),
        F.col("HAC_t_stat").alias("DM_t_statistic"),
        F.col("raw_p").alias("p_value"),
        F.col("n").alias("n_dates"),
        F.col("HAC_lag").alias("hac_lag"),
        F.when(F.col("mean") < 0, F.col("model_a")).otherwise(F.col("model_b")).alias("lower_loss_model"),
        N.holds(F.col("raw_p") < alpha).alias("significant_5pct"),
    )


def model_confidence_set(
    panel: DataFrame,
    models: list[str],
    day: str = "forecast_target_date",
    block: int = 5,
    reps: int = 2000,
    seed: int = 42,
    size: float = 0.05,
) -> DataFrame:
    """Model confidence set with the range statistic and circular blocks.

    Which model leaves next depends on the observed pairs alone: the worse model of the widest
    pair of those left (ties: the earlier pair). So the order of elimination comes from one small table of
    pairs, and a pair belongs to all steps up to the first of its models' departure. Every replication
    then needs one running maximum over its pairs by that step; no subset of models is formed.
    """
    means = panel.groupBy("loss").agg(*[F.avg(m).alias(m) for m in models], F.count(F.lit(1)).alias("n_dates"))
    sums = resampled_sums(panel, ["loss"], list(models), day, block, reps, seed)
    observed = means.select("loss", "n_dates", F.struct(*models).alias("_bar"))
    gap = lambda a, b: F.col("_bar")[models[a]] - F.col("_bar")[models[b]]
    of_pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), gap(a, b).alias("gap"), ((F.col(models[a]) - F.col(models[b])) / F.col("n") - gap(a, b)).alias("dev"))
        for a, b in combinations(range(len(models)), 2)
    ]
    rows = cut(sums.join(F.broadcast(observed), "loss").select("loss", "rep", F.inline(F.array(*of_pairs))))  # one observed row per loss function
    pairs = rows.groupBy("loss", "a", "b").agg(F.max("gap").alias("gap"), F.sqrt(F.avg(F.col("dev") * F.col("dev"))).alias("scale"))
    pairs = cut(pairs.withColumn("t", N.div("gap", "scale")))

    # The order of elimination, one array per loss function.
    every = pairs.groupBy("loss").agg(F.collect_list(F.struct("a", "b", "t")).alias("_pairs"))
    out = lambda gone, i: F.array_contains(gone, i)

    def drop_worst(gone, _):
        left = F.filter("_pairs", lambda p: ~out(gone, p["a"]) & ~out(gone, p["b"]))
        width = lambda p: F.coalesce(F.abs(p["t"]), F.lit(-1.0))
        worse = lambda p: F.when(p["t"] > 0, p["a"]).otherwise(p["b"])
        widest = F.array_max(F.transform(left, lambda p: F.struct(width(p).alias("width"), (-p["a"]).alias("a"), (-p["b"]).alias("b"), worse(p).alias("worst"))))
        return F.concat(gone, F.array(widest["worst"]))

    steps = F.sequence(F.lit(1), F.lit(len(models) - 1))
    order = cut(every.select("loss", F.aggregate(steps, F.array().cast("array<int>"), drop_worst).alias("_order")))
    leaves = lambda i: F.when(out(F.col("_order"), F.col(i)), F.array_position("_order", F.col(i)).cast("int")).otherwise(len(models))
    placed = pairs.join(F.broadcast(order), "loss").select("loss", "a", "b", "t", "scale", F.least(leaves("a"), leaves("b")).alias("step"))  # one row per loss function

    later = Window.partitionBy("loss").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    stats = placed.groupBy("loss", "step").agg(F.max(F.abs("t")).alias("stat")).withColumn("stat", F.max("stat").over(later))
    by_rep = Window.partitionBy("loss", "rep").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sims = rows.join(F.broadcast(placed.select("loss", "a", "b", "scale", "step")), ["loss", "a", "b"])  # a row per pair of models
    sims = sims.groupBy("loss", "rep", "step").agg(F.max(F.abs(N.div("dev", "scale"))).alias("sim")).withColumn("sim", F.max("sim").over(by_rep))
    tested = sims.join(F.broadcast(stats), ["loss", "step"]).groupBy("loss", "step").agg(F.avg((F.col("stat") < F.col("sim")).cast("double")).alias("p"))
    so_far = Window.partitionBy("loss").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tested = tested.select("loss", "step", F.greatest(F.max("p").over(so_far), F.lit(0.0)).alias("p"))

    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("model")) for i, m in enumerate(models)])
    listed = order.select("loss", "_order", F.inline(names)).withColumn("step", leaves("i"))
    found = listed.join(tested, ["loss", "step"], "left").withColumn("p", F.when(F.col("step") == len(models), 1.0).otherwise(F.col("p")))
    return found.join(F.broadcast(means.select("loss", "n_dates")), "loss").select(
        "loss",
        "model",
        F.col("p").alias("p_value"),
        (F.col("p") > size).alias("included"),
        F.lit(size).alias("test_size"),
        "n_dates",
        F.lit(block).alias("block_length"),
        F.lit(reps).alias("reps"),
        F.lit(seed).alias("seed"),
    )


def return_paths(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Running arithmetic sum, compounded wealth and drawdown of each series.

    Wealth starts at 1 and is undefined for the whole series if any return is
    missing or at or below -1.
    """
    by_key = Window.partitionBy(*keys)
    so_far = by_key.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value)
    sound = F.min((N.finite(x) & N.holds(x > -1)).cast("int")).over(by_key) == 1
    df = df.withColumn("_sound", sound).withColumn("cumulative_arithmetic", F.sum(x).over(so_far))
    df = df.withColumn("wealth", F.exp(F.sum(F.when(F.col("_sound"), F.log1p(x))).over(so_far)))
    df = df.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(so_far)) - 1)
    return df.drop("_sound")


def correlations(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], names=("variable_A", "variable_B")) -> DataFrame:
    """Pearson and Spearman correlation of column pairs over rows where both are finite."""
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                    for a, b in pairs
                ]
            )
        ).alias("p"),
    ).select(*keys, "p.*")
    return pair_correlation(long.where(N.finite("x") & N.finite("y")), [*keys, *names], "x", "y")


def pair_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    ranked = df.withColumns({"_rx": mean_rank(x, keys), "_ry": mean_rank(y, keys)})
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_dates"),
        safe_corr(x, y).alias("pearson"),
        safe_corr("_rx", "_ry").alias("spearman"),
    )


def safe_corr(x: str, y: str) -> Column:
    """Correlation, NULL when either side is constant or has under two rows."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, N.div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
