"""Multiple testing, paired effects, normalisation, hedge costs, regimes, summaries."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.sizing import small_side
from ..settings import HAC_LAGS, HEDGE_COST_BPS, STATE_PAIRS, STATES, Inference
from . import stats
from .pnl import DAY, by_implementation

HEDGED = ("DELTA_NEUTRAL", "VEGA_BALANCED_DELTA_NEUTRAL")


def multiple_testing(perf: DataFrame) -> DataFrame:
    """Adjusted p-values over all model-states of an implementation, and again
    inside each model."""
    tests = perf.select(
        "model", "portfolio_state", "implementation", "mean_daily_return", F.col("HAC_p_value").alias("raw_p")
    )
    tie = ["model", "portfolio_state"]
    primary = stats.with_adjusted_p(tests, ["implementation"], tie=tie)
    primary = primary.withColumn("family", F.concat_ws("_", F.lit("PRIMARY"), "implementation", F.col("family_size")))
    second = stats.with_adjusted_p(tests, ["implementation", "model"], tie=tie)
    second = second.withColumn(
        "family", F.concat_ws("_", F.lit("SECONDARY"), "implementation", "model", F.col("family_size"))
    )
    return primary.unionByName(second)


def paired_panel(states: DataFrame, expected_days: int | None = None) -> DataFrame:
    """Daily differences of the four state pairs. All states must be present on the
    same dates (and on `expected_days` of them when given)."""
    wide = states.groupBy(*DAY).agg(
        *[F.max(F.when(F.col("portfolio_state") == s, F.col("Return_mid"))).alias(s) for s in STATES]
    )
    whole = N.finite(STATES[0])
    for s in STATES[1:]:
        whole = whole & N.finite(s)
    days = F.count(F.lit(1)).over(Window.partitionBy("model"))
    sound = whole if expected_days is None else whole & (days == expected_days)
    message = f"paired states need the same complete {expected_days or ''} dates"
    wide = wide.withColumn("_ok", sound)
    differences = wide.select(
        *DAY,
        "_ok",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{a}_MINUS_{b}").alias("transformation"),
                        F.lit(a).alias("target_state"),
                        F.lit(b).alias("reference_state"),
                        (F.col(a) - F.col(b)).alias("difference"),
                    )
                    for a, b in STATE_PAIRS
                ]
            )
        ),
    )
    guarded = F.when(F.col("_ok"), F.col("difference")).otherwise(F.raise_error(F.lit(message)).cast("double"))
    return differences.withColumn("difference", guarded).drop("_ok")


PAIR_KEYS = ["model", "transformation", "target_state", "reference_state"]


def paired_effects(
    states: DataFrame, inference: Inference = Inference(), expected_days: int | None = None, with_bootstrap: bool = True
) -> DataFrame:
    """HAC test, bootstrap interval and adjusted p-values of the state differences
    (one family over all models and pairs)."""
    panel = paired_panel(states, expected_days)
    tested = stats.hac_test(panel, PAIR_KEYS, "difference", "entry_date", inference.hac_lag, strict=True)
    if with_bootstrap:
        ci = stats.bootstrap_mean_sharpe(
            panel, PAIR_KEYS, "difference", "entry_date", inference.blocks[0], inference.reps, inference.seed
        )
        tested = tested.join(ci, PAIR_KEYS)
    # One family of model-pairs: the window below holds a dozen rows.
    out = stats.with_adjusted_p(tested.withColumn("_all", F.lit(1)), ["_all"], tie=["model", "transformation"])
    return out.drop("_all").withColumnRenamed("n", "n_days")


def paired_bootstrap(states: DataFrame, inference: Inference = Inference(), expected_days: int | None = None) -> DataFrame:
    panel = paired_panel(states, expected_days)
    return stats.bootstrap_sensitivity(
        panel, PAIR_KEYS, "difference", "entry_date", inference.blocks, reps=inference.reps, seed=inference.seed
    )


COMPONENTS = ["Delta_component", "Gamma_component", "Theta_component", "DGT_residual"]


def daily_components(attr: DataFrame) -> DataFrame:
    """Attribution components summed per model-day; missing attribution is an error."""
    have = F.when(F.col("DGT_available"), F.lit(0.0)).otherwise(
        F.raise_error(F.lit("full-sample attribution unavailable")).cast("double")
    )
    return attr.groupBy(*DAY).agg(*[F.sum(F.col(c) + have).alias(c) for c in COMPONENTS])


def component_inference(attr: DataFrame, lag: int = 5) -> DataFrame:
    long = daily_components(attr).unpivot(DAY, COMPONENTS, "component", "x")
    tested = stats.hac_test(long, ["model", "component"], "x", "entry_date", lag, strict=True)
    out = stats.with_adjusted_p(tested.withColumn("_all", F.lit(1)), ["_all"], tie=["model", "component"])
    return out.drop("_all").withColumnRenamed("n", "n_days").withColumn("units", F.lit("weighted quoted option price"))


def normalised_daily(states: DataFrame, baseline: DataFrame) -> DataFrame:
    """Returns over the original midpoint premium, for both implementations."""
    base = baseline.select(
        *DAY,
        F.col("GrossPremium_mid").alias("original_gross_premium_mid"),
        F.col("GrossPremium_exec").alias("original_gross_premium_exec"),
    )
    out = states.join(base, DAY)
    return out.withColumns(
        {f"Return_common_denom_{s}": N.div(f"PnL_{s}", "original_gross_premium_mid") for s in ("mid", "exec")}
    )


def normalisation(states: DataFrame, baseline: DataFrame) -> DataFrame:
    """Does the sign of the mean return depend on the premium it is divided by?"""
    daily = normalised_daily(states, baseline)
    fields = ("Return", "Return_common_denom", "PnL", "GrossPremium")
    long = by_implementation(daily, ["model", "portfolio_state", "entry_date"], fields)
    out = long.groupBy("model", "portfolio_state", "implementation").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("Return").alias("primary_mean_daily_ratio"),
        F.avg("Return_common_denom").alias("mean_Return_common_denom"),
        F.sum("PnL").alias("total_pnl"),
        F.sum("GrossPremium").alias("total_state_gross_premium"),
    )
    out = out.withColumn("pooled_premium_return", N.div("total_pnl", "total_state_gross_premium"))
    same = lambda c: N.holds(F.signum("primary_mean_daily_ratio") == F.signum(c))
    return out.withColumns(
        {
            "common_sign_matches_primary": same("mean_Return_common_denom"),
            "pooled_sign_matches_primary": same("pooled_premium_return"),
        }
    )


def hedge_inputs(states: DataFrame, spots: DataFrame) -> DataFrame:
    hedged = states.where(F.col("portfolio_state").isin(*HEDGED)).join(spots.select(*DAY, "S_entry"), DAY)
    return hedged.withColumn("hedge_notional", F.abs("hedge_quantity") * F.col("S_entry"))


def hedge_break_even(states: DataFrame, spots: DataFrame) -> DataFrame:
    """Per-side hedge cost that would use up the mean return (and the total PnL)."""
    x = hedge_inputs(states, spots)
    out = x.groupBy("model", "portfolio_state").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("Return_mid").alias("uncosted_mean_MID"),
        F.sum("PnL_mid").alias("uncosted_total_MID_pnl"),
        F.avg("hedge_notional").alias("mean_hedge_notional"),
        F.avg(N.div(2 * F.col("hedge_notional"), "GrossPremium_mid")).alias("mean_normalized_cost_load"),
        F.sum("hedge_notional").alias("_notional"),
    )
    load, mean = F.col("mean_normalized_cost_load"), F.col("uncosted_mean_MID")
    root = F.when(load > 0, N.div(mean, load))
    floor0 = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))
    pooled = F.when(F.col("_notional") > 0, N.div("uncosted_total_MID_pnl", 2 * F.col("_notional")))
    out = out.withColumns(
        {"break_even_decimal_per_side": floor0(root), "aggregate_break_even_decimal_per_side": floor0(pooled)}
    )
    return out.withColumns(
        {
            "break_even_bps_per_side": 10000 * F.col("break_even_decimal_per_side"),
            "break_even_bps_round_trip": 20000 * F.col("break_even_decimal_per_side"),
            "aggregate_break_even_bps_per_side": 10000 * F.col("aggregate_break_even_decimal_per_side"),
            "positive_mean_friction_budget": N.holds(mean > 0),
            "status": F.when(N.holds(mean > 0), "POSITIVE_MEAN_BUDGET").otherwise(
                "NO_POSITIVE_COST_BUDGET_ALREADY_NONPOSITIVE"
            ),
        }
    ).drop("_notional")


def hedge_stress(states: DataFrame, spots: DataFrame, bps=HEDGE_COST_BPS) -> DataFrame:
    """Mean and total results after hypothetical per-side hedge costs."""
    levels = F.explode(F.array(*[F.lit(float(b)) for b in bps]))
    x = hedge_inputs(states, spots).withColumn("bps_per_side", levels)
    cost = 2 * (F.col("bps_per_side") / 10000) * F.col("hedge_notional")
    x = x.withColumns({"_mid": F.col("PnL_mid") - cost, "_exec": F.col("PnL_exec") - cost})
    return x.groupBy("model", "portfolio_state", "bps_per_side").agg(
        (2 * F.max("bps_per_side")).alias("bps_round_trip"),
        F.count(F.lit(1)).alias("n_days"),
        F.avg(N.div("_mid", "GrossPremium_mid")).alias("mean_MID_after_hypothetical_cost"),
        F.sum("_mid").alias("total_MID_pnl_after_hypothetical_cost"),
        F.avg(N.div("_exec", "GrossPremium_exec")).alias("mean_BID_ASK_proxy_after_hypothetical_cost"),
    )


def hedge_report(break_even: DataFrame, stress: DataFrame) -> DataFrame:
    """Both cost tables in one sheet; columns a record type lacks are NULL."""
    first = break_even.withColumn("record_type", F.lit("BREAK_EVEN"))
    return first.unionByName(stress.withColumn("record_type", F.lit("STRESS")), allowMissingColumns=True)


def stability(
    states: DataFrame, variable: str, buckets, bid_states=("ORIGINAL", "VEGA_BALANCED"), lag: int = 5, strict: bool = True
) -> DataFrame:
    """Sharpe ratio and HAC test inside each bucket of a day-level variable."""
    chosen = states.where(F.col(variable).isin(*buckets)).withColumn("bucket", F.col(variable).cast("string"))
    keep = ["model", "portfolio_state", "bucket", "entry_date"]
    long = by_implementation(chosen, keep, ("Return",))
    long = long.where((F.col("implementation") == "MID") | F.col("portfolio_state").isin(*bid_states))
    group = ["model", "portfolio_state", "bucket", "implementation"]
    sharpe = long.groupBy(*group).agg(
        (math.sqrt(252.0) * N.div(F.avg("Return"), F.stddev_samp("Return"))).alias("annualized_sharpe")
    )
    tested = stats.hac_test(long, group, "Return", "entry_date", lag, strict=strict)
    return tested.join(sharpe, group).withColumnRenamed("n", "n_days").withColumn("partition_variable", F.lit(variable))


def iv_levels(surface: DataFrame, day: str = "quote_date") -> DataFrame:
    """Daily cross-sectional median volatility. A day has one row per grid node, so
    the exact median's buffer is bounded by the grid."""
    return surface.groupBy(F.col(day).alias("decision_date")).agg(
        F.median(N.finite_or_null("iv_grid")).alias("market_IV_level"),
        F.count_if(N.finite("iv_grid")).alias("n_observed_nodes"),
    )


def regime_threshold(levels: DataFrame, cutoff: dt.date) -> DataFrame:
    """Median of the daily levels up to the cutoff, one row; later levels are not read."""
    before = levels.where((F.col("decision_date") <= F.lit(cutoff)) & F.col("market_IV_level").isNotNull())
    return before.agg(
        F.median("market_IV_level").alias("threshold"),
        F.count(F.lit(1)).alias("pretest_n_dates"),
        F.min("decision_date").alias("pretest_first_date"),
        F.max("decision_date").alias("pretest_last_date"),
    )


def iv_regimes(decisions: DataFrame, levels: DataFrame, cutoff: dt.date, threshold: float | None = None) -> DataFrame:
    """LOW_IV / HIGH_IV label of every decision date. A decision date without a
    surface level, or no pre-cutoff history, is an error: nothing is imputed."""
    days = decisions.select("decision_date").distinct()
    out = days.join(levels, "decision_date", "left")
    if threshold is not None:
        limit = F.lit(float(threshold))
    else:
        one = regime_threshold(levels, cutoff).select("threshold").withColumn("_k", F.lit(1))
        out = out.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k", "left").drop("_k")  # a single row
        limit = F.col("threshold")
    bad = F.col("market_IV_level").isNull() | limit.isNull()
    label = F.when(bad, F.raise_error(F.lit("no volatility level on a decision date"))).otherwise(
        F.when(F.col("market_IV_level") <= limit, "LOW_IV").otherwise("HIGH_IV")
    )
    return out.withColumn("IV_regime", label).drop("threshold")


def lag_sensitivity(states: DataFrame, lags=HAC_LAGS) -> DataFrame:
    """HAC tests at several lags, adjusted within implementation and lag."""
    long = by_implementation(states, ["model", "portfolio_state", "entry_date"], ("Return",))
    group = ["model", "portfolio_state", "implementation"]
    out = None
    for lag in lags:
        one = stats.hac_test(long, group, "Return", "entry_date", lag, strict=True)
        out = one if out is None else out.unionByName(one)
    out = stats.with_adjusted_p(out, ["implementation", "HAC_lag"], tie=["model", "portfolio_state"])
    return out.withColumnRenamed("n", "n_days")


STATE_SHORT = {
    "ORIGINAL": "original",
    "DELTA_NEUTRAL": "delta_neutral",
    "VEGA_BALANCED": "vega_balanced",
    "VEGA_BALANCED_DELTA_NEUTRAL": "joint",
}


def full_chain(forecast: DataFrame, ic: DataFrame, signal: DataFrame, perf: DataFrame, multiple: DataFrame, costs: DataFrame) -> DataFrame:
    """One row per model from forecast error to traded result."""
    out = forecast.select("model", "RMSE", "MAE", "QLIKE")
    out = out.join(ic.select("model", F.col("mean_daily_IC").alias("forecast_Rank_IC")), "model")
    out = out.join(
        signal.select(
            "model",
            F.col("mean_IC").alias("holding_period_Rank_IC"),
            F.col("mean_top_minus_bottom").alias("holding_IV_top_minus_bottom"),
        ),
        "model",
    )
    cell = lambda s, i: F.max(
        F.when((F.col("portfolio_state") == s) & (F.col("implementation") == i), F.col("mean_daily_return"))
    )
    means = [cell("ORIGINAL", "BID_ASK").alias("original_BID_ASK_mean")]
    means += [cell(s, "MID").alias(f"{short}_MID_mean") for s, short in STATE_SHORT.items()]
    out = out.join(perf.groupBy("model").agg(*means), "model")
    joint = multiple.where(
        F.col("family").startswith("PRIMARY_MID") & (F.col("portfolio_state") == "VEGA_BALANCED_DELTA_NEUTRAL")
    )
    out = out.join(joint.select("model", "holm_adjusted_p", "holm_reject_5pct", "BH_adjusted_p", "BH_reject_5pct"), "model")
    even = costs.groupBy("model").agg(
        *[
            F.max(F.when(F.col("portfolio_state") == s, F.col("break_even_bps_per_side"))).alias(
                f"{STATE_SHORT[s]}_break_even_bps_per_side"
            )
            for s in HEDGED
        ]
    )
    return out.join(even, "model")


RANKED = (
    ("RMSE", True),
    ("forecast_Rank_IC", False),
    ("holding_period_Rank_IC", False),
    ("original_MID_mean", False),
    ("delta_neutral_MID_mean", False),
    ("joint_MID_mean", False),
)


def model_ranks(chain: DataFrame) -> DataFrame:
    """Rank of each model on six measures (a window over one row per model)."""
    order = lambda c, up: F.col(c).asc() if up else F.col(c).desc()
    return chain.select("model", *[F.rank().over(Window.orderBy(order(c, up))).alias(f"{c}_rank") for c, up in RANKED])
