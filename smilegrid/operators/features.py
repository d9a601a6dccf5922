"""Lag features, horizon labels and target-date splits on the dense session panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.sizing import small_side
from ..settings import FEATURE_LAGS, Splits
from .calendar import with_targets

FEATURES = [f"lag_{k}" for k in FEATURE_LAGS] + ["roll_mean_5", "roll_std_5", "dow"]


def lag_features(
    panel: DataFrame, calendar: DataFrame, horizon: int = 1, value: str = "iv_grid", day: str = "quote_date"
) -> DataFrame:
    """Features known at the origin, the label h sessions ahead and its date.

    `panel` must be dense (every session of every node), so a row offset is a
    session offset. lag_1 is the origin value itself. Windows partition by node:
    one node's history is bounded by the calendar.
    """
    by_node = Window.partitionBy("node").orderBy(day)
    recent = by_node.rowsBetween(-4, 0)
    seen = F.count(value).over(recent)
    targets = small_side(
        with_targets(calendar, (horizon,)).select(
            F.col("session").alias(day),
            F.col(f"target_h{horizon}").alias("target_date"),
            F.col(f"dow_h{horizon}").alias("dow"),
        )
    )
    columns = {f"lag_{k}": F.lag(value, k - 1).over(by_node) for k in FEATURE_LAGS}
    columns["roll_mean_5"] = F.when(seen >= 2, F.avg(value).over(recent))
    columns["roll_std_5"] = F.when(seen >= 2, F.stddev_samp(value).over(recent))
    columns["label"] = F.lead(value, horizon).over(by_node)
    return panel.withColumns(columns).join(targets, day, "left")


def split_masks(features: DataFrame, splits: Splits = Splits(), day: str = "quote_date") -> DataFrame:
    """`is_train`, `is_validation`, `is_final` by target date.

    A validation origin must not precede the training cutoff, otherwise a
    two-session label could sit on both sides of it.
    """
    target, labelled = F.col("target_date"), N.finite("label")
    train_end, fit_end = F.lit(splits.train_end), F.lit(splits.fit_end)
    return features.withColumns(
        {
            "is_train": N.holds(target <= train_end) & labelled,
            "is_validation": N.holds((target > train_end) & (target <= fit_end) & (F.col(day) >= train_end))
            & labelled,
            "is_final": N.holds(target <= fit_end) & labelled,
        }
    )


def history_status(masked: DataFrame, splits: Splits = Splits()) -> DataFrame:
    """Label counts per node and whether there is enough history to fit it."""
    return masked.groupBy("node").agg(
        F.count_if("is_train").alias("n_train"),
        F.count_if("is_validation").alias("n_validation"),
        F.count_if("is_final").alias("n_final"),
        F.max(F.when(F.col("is_train"), F.col("target_date"))).alias("train_label_max"),
        F.max(F.when(F.col("is_final"), F.col("target_date"))).alias("final_label_max"),
    ).withColumn(
        "status",
        F.when(
            (F.col("n_train") >= splits.min_train) & (F.col("n_validation") >= splits.min_validation), "OK"
        ).otherwise("INSUFFICIENT_HISTORICAL_LABELS"),
    )


def coordinate_terciles(nodes: DataFrame, coordinate: str, labels: tuple[str, str, str], name: str) -> DataFrame:
    """Distinct sorted coordinates cut into three runs, the larger runs first.

    The window runs over the grid's distinct axis values only (25 or 20 rows).
    """
    third = F.ntile(3).over(Window.orderBy(coordinate))
    names = F.array(*[F.lit(x) for x in labels])
    return nodes.select(coordinate).distinct().select(coordinate, F.element_at(names, third).alias(name))


def regions(nodes: DataFrame) -> DataFrame:
    """Moneyness and maturity region of every grid node."""
    x = coordinate_terciles(nodes, "log_moneyness", ("lower", "central", "upper"), "moneyness_region")
    t = coordinate_terciles(nodes, "T", ("short", "medium", "long"), "maturity_region")
    return nodes.join(small_side(x), "log_moneyness").join(small_side(t), "T")
