"""Contract ledger, daily PnL and performance tables."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..settings import IMPLEMENTATIONS, PROCESSED, RECOVERED, TRADED_MODELS, Inference
from . import stats

DAY = ["model", "entry_date"]


def contract_pnl(book: DataFrame) -> DataFrame:
    """Midpoint and bid/ask PnL, premiums and half-spread costs of signed positions."""
    w = F.col("weight_at_entry")
    out = book.withColumns(
        {
            "signed_weight": w,
            "exit_date": F.col("intended_exit_date"),
            "entry_mid": N.midpoint("entry_bid", "entry_ask"),
            "exit_mid": N.midpoint("exit_bid", "exit_ask"),
            "entry_execution_price": F.when(w > 0, F.col("entry_ask")).otherwise(F.col("entry_bid")),
            "exit_execution_price": F.when(w > 0, F.col("exit_bid")).otherwise(F.col("exit_ask")),
        }
    )
    size = F.abs(w)
    out = out.withColumns(
        {
            "pnl_mid": w * (F.col("exit_mid") - F.col("entry_mid")),
            "pnl_exec": w * (F.col("exit_execution_price") - F.col("entry_execution_price")),
            "gross_entry_premium_mid_component": size * F.col("entry_mid"),
            "gross_entry_premium_exec_component": size * F.col("entry_execution_price"),
            "relative_entry_spread": N.relative_spread("entry_bid", "entry_ask"),
            "relative_exit_spread": N.relative_spread("exit_bid", "exit_ask"),
            "entry_spread_cost": size * (F.col("entry_ask") - F.col("entry_bid")) / 2,
            "exit_spread_cost": size * (F.col("exit_ask") - F.col("exit_bid")) / 2,
        }
    )
    return out.withColumn("cost_wedge_pnl", F.col("pnl_mid") - F.col("pnl_exec"))


def eligible_contracts(ready: DataFrame, audit: DataFrame) -> DataFrame:
    """Netted contracts of chronology-eligible model-days."""
    days = audit.where("economic_calendar_eligible").select(*DAY)
    return ready.join(days, DAY, "left_semi")


def calendar_audit(signals: DataFrame, ready: DataFrame, calendar: DataFrame) -> DataFrame:
    """Selected, mapped and active counts per model-day, zeros kept, with eligibility."""
    from .calendar import chronology

    selection = signals.where("selected").groupBy("model", "decision_date", "entry_date", "intended_exit_date").agg(
        F.count(F.lit(1)).alias("number_selected_nodes")
    )
    entered = ready.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("n_mapped_contracts"), F.count_if("nonzero_net_position").alias("n_active_contracts")
    )
    return (
        chronology(selection, calendar)
        .join(entered, DAY, "left")
        .na.fill(0, ["n_mapped_contracts", "n_active_contracts"])
    )


def daily_pnl(contracts: DataFrame, eligible_net: DataFrame, selection: DataFrame) -> DataFrame:
    """Portfolio PnL, premiums, counts and returns per model-day."""
    source = F.col("exit_quote_source")
    daily = contracts.groupBy(*DAY).agg(
        F.first("decision_date").alias("decision_date"),
        F.first("exit_date").alias("exit_date"),
        F.sum("pnl_mid").alias("PnL_mid"),
        F.sum("pnl_exec").alias("PnL_exec"),
        F.sum("gross_entry_premium_mid_component").alias("GrossPremium_mid"),
        F.sum("gross_entry_premium_exec_component").alias("GrossPremium_exec"),
        F.count(F.lit(1)).alias("number_contracts"),
        F.count_if(source == RECOVERED).alias("number_raw_recovered_exits"),
        F.count_if(source == PROCESSED).alias("number_processed_exits"),
        F.sum(F.abs("signed_weight")).alias("net_gross_weight"),
        F.sum("signed_weight").alias("net_signed_weight"),
        F.sum("entry_spread_cost").alias("entry_spread_cost"),
        F.sum("exit_spread_cost").alias("exit_spread_cost"),
    )
    before = eligible_net.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("number_unique_mapped_contracts"),
        F.sum("n_mapped_nodes").alias("number_mapped_nodes"),
        F.sum("node_gross_weight").alias("gross_pre_net_signal_weight"),
    )
    daily = daily.join(before, DAY).join(selection.select(*DAY, "number_selected_nodes"), DAY)
    daily = daily.withColumns(
        {
            "Return_mid": N.div("PnL_mid", "GrossPremium_mid"),
            "Return_exec": N.div("PnL_exec", "GrossPremium_exec"),
            "cost_wedge_pnl": F.col("PnL_mid") - F.col("PnL_exec"),
        }
    )
    return daily.withColumns(
        {
            "cost_wedge_return": F.col("Return_mid") - F.col("Return_exec"),
            "cost_wedge": F.col("cost_wedge_pnl"),
            "trading_day": F.col("entry_date"),
        }
    )


def eligible_gross(eligible_net: DataFrame) -> DataFrame:
    """Pre-netting gross weight per eligible model-day."""
    return eligible_net.groupBy(*DAY).agg(F.sum("node_gross_weight").alias("gross_weight"))


def by_implementation(daily: DataFrame, keep: list[str], fields=("Return", "PnL", "GrossPremium")) -> DataFrame:
    """Long form: one row per day and implementation (MID, BID_ASK)."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("implementation"), *[F.col(f"{f}_{suffix}").alias(f) for f in fields])
            for name, suffix in IMPLEMENTATIONS
        ]
    )
    return daily.select(*keep, F.explode(rows).alias("i")).select(*keep, "i.*")


def performance(
    daily: DataFrame,
    keys: list[str],
    inference: Inference = Inference(),
    contracts: DataFrame | None = None,
    with_bootstrap: bool = True,
) -> DataFrame:
    """Risk, return, HAC and bootstrap statistics per key and implementation.

    `daily` may carry an `available` flag; unavailable days count towards the
    day total but not the sample. Fewer than seven days, or a non-finite return,
    gives an UNAVAILABLE_INFERENCE row with NULL statistics.
    """
    if "available" not in daily.columns:
        daily = daily.withColumn("available", F.lit(True))
    group = [*keys, "implementation"]
    long = by_implementation(daily, [*keys, "entry_date", "available", "number_contracts"])
    total_days = long.groupBy(*group).agg(F.count(F.lit(1)).alias("_days"))
    live = long.where("available")
    paths = stats.return_paths(live, group, "Return", "entry_date")
    last = Window.partitionBy(*group)
    paths = paths.withColumn("_final", F.max_by("wealth", "entry_date").over(last))
    year = inference_periods = 252.0
    r = F.col("Return")
    table = paths.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(N.finite(r)).alias("_finite"),
        F.sum("number_contracts").alias("n_contracts"),
        F.avg(r).alias("_mean"),
        F.median(r).alias("median_daily_return"),
        F.stddev_samp(r).alias("daily_vol"),
        F.sum(r).alias("cumulative_normalized_return"),
        (F.max("_final") - 1).alias("compounded_normalized_return"),
        (100 * F.avg((r > 0).cast("double"))).alias("positive_day_pct"),
        F.min("drawdown").alias("max_drawdown"),
        F.min(r).alias("worst_daily_return"),
        F.max(r).alias("best_daily_return"),
        F.sum("PnL").alias("total_pnl"),
        F.bool_and(F.col("wealth").isNotNull()).alias("_wealthy"),
    )
    table = table.withColumns(
        {
            "annualized_mean": year * F.col("_mean"),
            "annualized_vol": math.sqrt(inference_periods) * F.col("daily_vol"),
            "annualized_sharpe": math.sqrt(year) * N.div("_mean", "daily_vol"),
            "wealth_index_status": F.when(
                F.col("_wealthy"), "MATHEMATICALLY_ADMISSIBLE_PREMIUM_EXPOSURE_INDEX"
            ).otherwise("INVALID_RETURN_LE_MINUS_ONE_OR_NONFINITE"),
        }
    )
    test = stats.hac_test(live, group, "Return", "entry_date", inference.hac_lag)
    test = test.select(
        *group,
        F.col("mean").alias("mean_daily_return"),
        "HAC_standard_error",
        "HAC_t_stat",
        F.col("raw_p").alias("HAC_p_value"),
        "HAC_lag",
    )
    out = total_days.join(table, group, "left").join(test, group, "left")
    if with_bootstrap:
        ci = stats.bootstrap_mean_sharpe(
            live.where(N.finite("Return")), group, "Return", "entry_date", inference.blocks[0], inference.reps, inference.seed
        )
        out = out.join(ci, group, "left")
    if contracts is not None:
        distinct = contracts.groupBy("model").agg(F.countDistinct("contract_key").alias("n_distinct_contract_keys"))
        out = out.join(distinct, "model", "left")
    usable = (F.coalesce("n_days", F.lit(0)) >= 7) & (F.col("_finite") == F.col("n_days"))
    numeric = [c for c, kind in out.dtypes if kind == "double"]
    out = out.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    out = out.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in numeric})
    out = out.withColumns(
        {
            "status": F.when(F.col("_ok"), "OK").otherwise("UNAVAILABLE_INFERENCE"),
            "implementation_label": F.when(F.col("implementation") == "MID", "valued at midpoints").otherwise("traded at bid and ask"),
            "n_days": F.coalesce("n_days", F.lit(0)),
            "unavailable_day_pct": 100 * (1 - F.coalesce("n_days", F.lit(0)) / F.col("_days")),
        }
    )
    return out.drop("_ok", "_days", "_finite", "_mean", "_wealthy")


def pairwise_returns(daily: DataFrame, models=TRADED_MODELS, lag: int = 5) -> DataFrame:
    """HAC test of return differences on the dates both models have."""
    long = by_implementation(daily, ["model", "entry_date"], ("Return",))
    wide = long.groupBy("implementation", "entry_date").agg(
        *[F.max(F.when(F.col("model") == m, F.col("Return"))).alias(m) for m in models]
    )
    pairs = wide.select(
        "implementation",
        "entry_date",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("model_A"), F.lit(b).alias("model_B"), (F.col(a) - F.col(b)).alias("d"))
                    for a, b in combinations(models, 2)
                ]
            )
        ),
    ).where(F.col("d").isNotNull())
    test = stats.hac_test(pairs, ["model_A", "model_B", "implementation"], "d", "entry_date", lag)
    return test.withColumnsRenamed({"mean": "mean_difference", "n": "n_inference_dates", "raw_p": "HAC_p_value"}).drop("median")


def cost_wedge(daily: DataFrame) -> DataFrame:
    """What bid/ask execution takes from midpoint value, split by entry and exit."""
    wedge, part = F.col("cost_wedge_pnl"), F.col("cost_wedge_return")
    out = daily.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(wedge).alias("mean_pnl_wedge"),
        F.median(wedge).alias("median_pnl_wedge"),
        F.sum(wedge).alias("cumulative_pnl_wedge"),
        F.avg(part).alias("mean_return_wedge"),
        F.median(part).alias("median_return_wedge"),
        F.sum(part).alias("cumulative_arithmetic_return_wedge"),
        F.sum("PnL_mid").alias("total_mid_pnl"),
        F.sum("PnL_exec").alias("total_exec_pnl"),
        F.sum("entry_spread_cost").alias("entry_spread_contribution"),
        F.sum("exit_spread_cost").alias("exit_spread_contribution"),
    )
    gain = F.col("total_mid_pnl") > 0
    both = F.col("entry_spread_contribution") + F.col("exit_spread_contribution")
    return out.withColumns(
        {
            "fraction_midpoint_economic_value_lost": F.when(gain, N.div("cumulative_pnl_wedge", "total_mid_pnl")),
            "midpoint_loss_fraction_status": F.when(gain, "POSITIVE_AGGREGATE_MID_PNL").otherwise(
                "UNDEFINED_NONPOSITIVE_AGGREGATE_MID_PNL"
            ),
            "entry_cost_fraction": F.when(both > 0, N.div("entry_spread_contribution", both)),
        }
    )


def contribution(contracts: DataFrame, quality: bool = False) -> DataFrame:
    """PnL share of overlapping quote-quality buckets, or of the quote sources."""
    source, spread = F.col("exit_quote_source"), F.col("relative_exit_spread")
    if quality:
        buckets = {
            "spread_le_10": N.spread_at_most(spread, 0.1),
            "spread_10_to_20": ~N.spread_at_most(spread, 0.1) & N.spread_at_most(spread, 0.2),
            "spread_gt_20": ~N.spread_at_most(spread, 0.2),
            "zero_volume_raw_recovered": (source == RECOVERED) & (F.col("raw_trade_volume") == 0),
            "positive_volume_chosen_quote": F.col("exit_quote_trade_volume") > 0,
            "STRICT_20": F.col("STRICT_20"),
            "STRICT_10": F.col("STRICT_10"),
            "POSITIVE_VOLUME": F.col("POSITIVE_VOLUME"),
        }
    else:
        buckets = {PROCESSED: source == PROCESSED, RECOVERED: source == RECOVERED}
    flags = F.array(
        *[F.struct(F.lit(name).alias("bucket"), N.holds(flag).alias("inside")) for name, flag in buckets.items()]
    )
    values = ["pnl_mid", "pnl_exec", "entry_spread_cost", "exit_spread_cost"]
    long = contracts.select("model", *values, F.inline(flags))
    inside = F.col("inside")
    out = long.groupBy("model", "bucket").agg(
        F.count_if(inside).alias("n_contracts"),
        (100 * F.avg(inside.cast("double"))).alias("contract_share_pct"),
        *[F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0.0)).alias(c) for c in values],
        F.sum("pnl_mid").alias("_all_mid"),
        F.sum("pnl_exec").alias("_all_exec"),
    )
    return out.withColumns(
        {
            "pnl_mid_share_of_total": N.div("pnl_mid", "_all_mid"),
            "pnl_exec_share_of_total": N.div("pnl_exec", "_all_exec"),
        }
    ).drop("_all_mid", "_all_exec")


SIGNAL_PAIRS = [
    ("top_minus_bottom", "Return_mid"),
    ("top_minus_bottom", "Return_exec"),
    ("Return_mid", "Return_exec"),
    ("predicted_cross_sectional_dispersion", "Return_mid"),
    ("predicted_cross_sectional_dispersion", "Return_exec"),
]


def signal_diagnostics(daily: DataFrame, signal_daily: DataFrame, signals: DataFrame) -> DataFrame:
    """Daily returns beside the day's signal diagnostics and forecast dispersion."""
    dispersion = signals.where("common_economic_candidate").groupBy("model", "decision_date").agg(
        F.stddev_samp("raw_signal").alias("predicted_cross_sectional_dispersion"),
        (F.max("raw_signal") - F.min("raw_signal")).alias("predicted_cross_sectional_range"),
    )
    keys = ["model", "decision_date"]
    return daily.join(signal_daily, keys, "left").join(dispersion, keys, "left")


def signal_correlations(diagnostics: DataFrame) -> DataFrame:
    return stats.correlations(diagnostics, ["model"], SIGNAL_PAIRS)
