"""Report tables that join counts and summaries across stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import PROCESSED, RECOVERED


def implementation_summary(
    signals: DataFrame, trades: DataFrame, ready: DataFrame, contracts: DataFrame, audit: DataFrame
) -> DataFrame:
    """From selected signals to evaluated contracts, one row per model."""
    source = F.col("exit_quote_source")
    parts = [
        contracts.groupBy("model").agg(
            F.count(F.lit(1)).alias("evaluated_contract_rows"),
            F.count_if(source == PROCESSED).alias("processed_exits"),
            F.count_if(source == RECOVERED).alias("raw_recovered_exits"),
            F.avg(F.col("BASE").cast("double")).alias("final_exit_coverage"),
            F.countDistinct("entry_date").alias("trading_days"),
        ),
        signals.groupBy("model").agg(F.count_if("selected").alias("selected_signals")),
        trades.groupBy("model").agg(F.count_if(F.col("entry_mapping_status") == "MAPPED").alias("entry_mapped")),
        ready.groupBy("model").agg(
            F.count(F.lit(1)).alias("unique_net_contract_rows"),
            F.count_if("nonzero_net_position").alias("active_net_contract_rows"),
        ),
        audit.groupBy("model").agg(
            F.count_if(~F.col("economic_calendar_eligible")).alias("calendar_excluded_decision_days"),
            F.count_if(~F.col("entry_snapshot_session")).alias("calendar_excluded_entry_days"),
            F.count_if(~F.col("exit_snapshot_session")).alias("calendar_excluded_exit_days"),
        ),
    ]
    return reduce(lambda a, b: a.join(b, "model", "left"), parts)


def signal_sheet(summary: DataFrame, economic: DataFrame, signals: DataFrame) -> DataFrame:
    """Signal summary with the candidate total and each model's selections."""
    total = economic.agg(F.count_if("common_economic_candidate").alias("economic_candidate_count")).withColumn("_k", F.lit(1))
    selected = signals.groupBy("model").agg(F.count_if("selected").alias("selected_signals"))
    out = summary.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")  # a single row
    return out.join(selected, "model", "left")


def forecast_sheet(comparison: DataFrame, ic: DataFrame) -> DataFrame:
    return comparison.join(ic.select("model", "mean_daily_IC"), "model")


def all_checks(*stages: tuple[int, DataFrame]) -> DataFrame:
    """Check rows of every stage under one header; missing columns are NULL."""
    names = {"check_name": "check", "result_name": "check", "max_abs_difference": "absolute_difference", "new_value": "observed", "reference_value": "reference", "violations": "absolute_difference"}
    columns = ["stage", "check", "status", "observed", "reference", "absolute_difference", "tolerance"]
    frames = []
    for stage, df in stages:
        renamed = df.withColumnsRenamed({c: names[c] for c in df.columns if c in names}).withColumn("stage", F.lit(stage))
        have = [c for c in columns if c in renamed.columns]
        frames.append(renamed.select(*[F.col(c).cast("string").alias(c) if c in ("observed", "reference") else F.col(c) for c in have]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*[c for c in columns if c in out.columns])
