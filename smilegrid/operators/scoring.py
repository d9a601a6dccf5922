"""Forecast scoring on the common sample of all models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.sizing import mean_rank, quantile
from ..settings import FORECAST_MODELS, Inference, Signals
from . import stats

TARGET = "forecast_target_date"


def attach_outcomes(
    forecasts: DataFrame,
    surface: DataFrame,
    joins: dict[str, str],
    day: str = "quote_date",
) -> DataFrame:
    """Observed volatility at several dates of each forecast row.

    `joins` maps a date column of the forecasts to the new value column; a date
    without an observation gives NULL.
    """
    out = forecasts
    for date, name in joins.items():
        observed = surface.select(F.col(day).alias(date), "node", F.col("iv_grid").alias(name))
        out = out.join(observed, [date, "node"], "left")
    return out


def annotate(journal: DataFrame, models=FORECAST_MODELS) -> DataFrame:
    """Availability flags, the common scoring sample and its QLIKE subset."""
    target = N.finite("actual_iv_at_target")
    columns = {"target_available": target}
    common, positive = target, N.holds(F.col("actual_iv_at_target") > 0)
    for m in models:
        have = N.finite(f"forecast_{m}")
        columns[f"available_{m}"] = have
        columns[f"scored_observation_{m}"] = target & have
        common = common & have
        positive = positive & N.holds(F.col(f"forecast_{m}") > 0)
    columns["common_sample_4models"] = common
    columns["common_sample_qlike"] = common & positive
    return journal.withColumns(columns)


def by_model(common: DataFrame, extra: list[str] = (), models=FORECAST_MODELS) -> DataFrame:
    """One row per observation and model, with its losses (a narrow unpivot)."""
    per_model = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"forecast_{m}").alias("forecast")) for m in models]
    )
    keep = [TARGET, "node", "observed_iv_at_origin", "actual_iv_at_target", "common_sample_qlike", *extra]
    long = common.select(*keep, F.explode(per_model).alias("m")).select(*keep, "m.model", "m.forecast")
    error = F.col("forecast") - F.col("actual_iv_at_target")
    return long.withColumns(
        {
            "SE": error * error,
            "AE": F.abs(error),
            "QL": F.when(F.col("common_sample_qlike"), N.qlike("actual_iv_at_target", "forecast")),
        }
    )


def _metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg("SE")).alias("RMSE"),
        F.avg("AE").alias("MAE"),
        F.avg("QL").alias("QLIKE"),
        F.count("QL").alias("QLIKE_n"),
    ]


def metrics(common: DataFrame, models=FORECAST_MODELS) -> DataFrame:
    return by_model(common, models=models).groupBy("model").agg(*_metrics())


def metrics_by_region(common: DataFrame, models=FORECAST_MODELS) -> DataFrame:
    """Both region dimensions in one pass with grouping sets."""
    dims = ("moneyness_region", "maturity_region")
    long = by_model(common, list(dims), models)
    model, first, second = F.col("model"), F.col(dims[0]), F.col(dims[1])
    grouped = long.groupingSets([[model, first], [model, second]], model, first, second).agg(
        *_metrics(), F.grouping(dims[0]).alias("_g")
    )
    return grouped.select(
        F.when(F.col("_g") == 0, dims[0]).otherwise(dims[1]).alias("region_type"),
        F.when(F.col("_g") == 0, first).otherwise(second).alias("region"),
        "model",
        "n",
        "RMSE",
        "MAE",
        "QLIKE",
        "QLIKE_n",
    )


def daily_losses(common: DataFrame, models=FORECAST_MODELS) -> DataFrame:
    return by_model(common, models=models).groupBy(TARGET, "model").agg(
        F.count(F.lit(1)).alias("n_common"),
        F.count("QL").alias("n_qlike"),
        F.avg("SE").alias("L_SE"),
        F.avg("AE").alias("L_AE"),
        F.avg("QL").alias("L_QLIKE"),
        F.sum("SE").alias("sum_SE"),
        F.sum("AE").alias("sum_AE"),
        F.coalesce(F.sum("QL"), F.lit(0.0)).alias("sum_QLIKE"),
    )


def daily_rank_ic(common: DataFrame, models=FORECAST_MODELS, minimum: int = 20) -> DataFrame:
    """Spearman correlation of predicted and realised change across nodes, per day.

    A day's cross-section is the grid, so the rank windows hold at most one row
    per node.
    """
    origin = F.col("observed_iv_at_origin")
    long = by_model(common, models=models).withColumns(
        {"predicted": F.col("forecast") - origin, "realised": F.col("actual_iv_at_target") - origin}
    )
    return rank_ic(long, [TARGET, "model"], "predicted", "realised", minimum).withColumnRenamed("n", "n_common")


def rank_ic(df: DataFrame, keys: list[str], predicted: str, realised: str, minimum: int) -> DataFrame:
    ranked = df.withColumns({"_p": mean_rank(predicted, keys), "_r": mean_rank(realised, keys)})
    grouped = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        stats.safe_corr("_p", "_r").alias("_ic"),
    )
    enough = F.col("n") >= minimum
    return grouped.select(
        *keys,
        "n",
        F.when(enough, F.col("_ic")).alias("rank_ic"),
        F.when(~enough, "TOO_FEW_NODES")
        .when(F.col("_ic").isNull(), "CONSTANT_CROSS_SECTION")
        .otherwise("OK")
        .alias("status"),
    )


def rank_ic_summary(daily_ic: DataFrame, day: str = TARGET, lag: int = 5) -> DataFrame:
    valid = daily_ic.where(F.col("rank_ic").isNotNull())
    summary = valid.groupBy("model").agg(
        F.avg("rank_ic").alias("mean_daily_IC"),
        F.median("rank_ic").alias("median_daily_IC"),
        F.stddev_samp("rank_ic").alias("std_daily_IC"),
        F.count(F.lit(1)).alias("n_valid_dates"),
        (100 * F.avg((F.col("rank_ic") > 0).cast("double"))).alias("percent_positive"),
        quantile("rank_ic", 0.25).alias("q25"),
        quantile("rank_ic", 0.75).alias("q75"),
    )
    test = stats.hac_test(valid, ["model"], "rank_ic", day, lag, reference="student").select(
        "model", F.col("HAC_t_stat").alias("NW_t_statistic"), F.col("raw_p").alias("p_value"), F.col("HAC_lag").alias("hac_lag")
    )
    return summary.join(test, "model")


def rolling_mean(
    daily: DataFrame, keys: list[str], value: str, order: str, window: int = 20, minimum: int = 10, root: bool = False
) -> DataFrame:
    """Trailing mean over the last sessions (optionally its root) once enough are seen."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    mean = F.when(F.count(value).over(frame) >= minimum, F.avg(value).over(frame))
    return daily.select(*keys, order, (F.sqrt(mean) if root else mean).alias(f"rolling_{value}"))


def cumulative_loss_gap(daily: DataFrame, loss: str, baseline: str = "persistence") -> DataFrame:
    """Running sum of each model's loss minus the baseline's."""
    base = F.max(F.when(F.col("model") == baseline, F.col(loss))).over(Window.partitionBy(TARGET))
    gap = daily.select(TARGET, "model", (F.col(loss) - base).alias("gap")).where(F.col("model") != baseline)
    so_far = Window.partitionBy("model").orderBy(TARGET).rowsBetween(Window.unboundedPreceding, 0)
    return gap.select(TARGET, "model", F.sum("gap").over(so_far).alias("cumulative_gap"))


def comparison_table(
    journal: DataFrame, daily: DataFrame, models=FORECAST_MODELS, inference: Inference = Inference()
) -> DataFrame:
    """Counts, retention, metrics, ranks and bootstrap intervals per model."""
    counts = journal.agg(
        *[F.count_if(f"available_{m}").alias(f"a_{m}") for m in models],
        *[F.count_if(f"scored_observation_{m}").alias(f"s_{m}") for m in models],
        F.count_if("common_sample_4models").alias("n_common"),
        F.countDistinct(F.when(F.col("common_sample_4models"), F.col(TARGET))).alias("n_dates_common"),
        F.countDistinct(F.when(F.col("common_sample_4models"), F.col("node"))).alias("n_nodes_common"),
    )
    counts = counts.select(
        "n_common",
        "n_dates_common",
        "n_nodes_common",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("model"),
                        F.col(f"a_{m}").alias("n_predictions_all"),
                        F.col(f"s_{m}").alias("n_scored_individual"),
                    )
                    for m in models
                ]
            )
        ),
    ).withColumn("common_retained_pct", 100 * N.div("n_common", "n_predictions_all"))
    scored = metrics(journal.where("common_sample_4models"), models).drop("n")
    out = counts.join(scored, "model")
    # One row per model: the unpartitioned rank windows hold four rows.
    out = out.withColumns({f"{k}_rank": F.rank().over(Window.orderBy(k)) for k in ("RMSE", "MAE", "QLIKE")})
    intervals = stats.metric_intervals(daily, TARGET, inference.blocks[0], inference.forecast_reps, inference.seed)
    wide = intervals.groupBy("model").agg(
        *[
            F.max(F.when(F.col("metric") == k, F.col(b))).alias(f"{k}_{b}")
            for k in ("RMSE", "MAE", "QLIKE")
            for b in ("lower_95", "upper_95")
        ]
    )
    return out.join(wide, "model")
