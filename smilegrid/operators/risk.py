"""Entry Greeks, PnL attribution and delta / vega controlled portfolio states.

Everything here groups or joins on (model, entry_date), optionally with the
contract, so one partitioning serves the whole chain.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.sizing import quantile
from ..settings import GREEKS, PROCESSED, RECOVERED, STATES
from . import stats
from .pnl import DAY, contract_pnl

BOOK = [*DAY, "contract_key"]
SPOT_TOLERANCE = 1e-8
REPRICING_TOLERANCE = 1e-3


def greek_quality(contracts: DataFrame) -> DataFrame:
    """Per-contract sanity flags of the entry Greeks, and their gap to Greeks
    recomputed from the stored entry inputs."""
    c = F.col
    finite = {g: N.finite(f"entry_{g}") for g in GREEKS}
    every = finite["Delta"] & finite["Gamma"] & finite["Vega"] & finite["Theta"]
    call = c("option_type") == "C"
    carry = F.exp(-c("entry_q") * c("entry_T"))
    slack = 1e-10
    low = F.when(call, F.lit(-slack)).otherwise(-carry - slack)
    high = F.when(call, carry + slack).otherwise(F.lit(slack))
    peak = N.div(
        carry, c("entry_spot") * c("entry_implied_vol") * F.sqrt("entry_T") * math.sqrt(2 * math.pi)
    )
    inputs = ("entry_spot", "strike", "entry_T", "entry_r", "entry_q", "entry_implied_vol")
    out = N.with_greeks(contracts, "_again_", *inputs, call)
    out = out.withColumns({f"finite_{g}": finite[g] for g in GREEKS})
    out = out.withColumns(
        {
            "all_entry_greeks_finite": every,
            "nonpositive_or_invalid_vega": ~finite["Vega"] | N.holds(c("entry_Vega") <= 0),
            "delta_outside_admissible_bounds": ~finite["Delta"] | N.fails(c("entry_Delta").between(low, high)),
            "implausible_gamma": ~finite["Gamma"]
            | N.holds(c("entry_Gamma") <= 0)
            | N.holds(c("entry_Gamma") > peak * (1 + slack)),
            **{f"_gap_{g}": F.abs(c(f"entry_{g}") - c(f"_again_{g}")) for g in GREEKS},
        }
    ).drop(*[f"_again_{g}" for g in GREEKS])
    return out.withColumn(
        "entry_greeks_quality_valid",
        c("all_entry_greeks_finite")
        & ~c("nonpositive_or_invalid_vega")
        & ~c("delta_outside_admissible_bounds")
        & ~c("implausible_gamma"),
    )


def greek_quality_summary(flagged: DataFrame) -> DataFrame:
    pct = lambda name: 100 * F.avg(F.col(name).cast("double"))
    return flagged.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_contracts"),
        pct("all_entry_greeks_finite").alias("all_finite_pct"),
        pct("entry_greeks_quality_valid").alias("quality_valid_pct"),
        F.count_if("nonpositive_or_invalid_vega").alias("n_invalid_vega"),
        F.count_if("delta_outside_admissible_bounds").alias("n_invalid_delta"),
        F.count_if("implausible_gamma").alias("n_implausible_gamma"),
        *[pct(f"finite_{g}").alias(f"{g}_finite_pct") for g in GREEKS],
        *[F.max(f"_gap_{g}").alias(f"{g}_recomputed_max_abs_error") for g in GREEKS],
    )


def without_gaps(flagged: DataFrame) -> DataFrame:
    return flagged.drop(*[f"_gap_{g}" for g in GREEKS])


def spot_by_day(contracts: DataFrame, tolerance: float = SPOT_TOLERANCE) -> DataFrame:
    """One entry and exit spot per model-day. Contracts that disagree make the day
    invalid; the spots are never averaged."""
    aggs, columns = [], {}
    for label in ("entry", "exit"):
        s = F.col(f"{label}_spot")
        aggs += [
            F.min(s).alias(f"{label}_spot_min"),
            F.max(s).alias(f"{label}_spot_max"),
            F.first(s).alias(f"_first_{label}"),
            F.bool_and(N.finite(s) & N.holds(s > 0)).alias(f"_sound_{label}"),
        ]
        gap = F.col(f"{label}_spot_max") - F.col(f"{label}_spot_min")
        columns[f"{label}_spot_dispersion"] = gap
        columns[f"{label}_spot_valid"] = F.col(f"_sound_{label}") & N.holds(gap <= tolerance)
    out = contracts.groupBy(*DAY).agg(F.first("decision_date").alias("decision_date"), F.first("exit_date").alias("exit_date"), *aggs)
    out = out.withColumns(columns)
    out = out.withColumns(
        {
            "S_entry": F.when(F.col("entry_spot_valid"), F.col("_first_entry")),
            "S_exit": F.when(F.col("exit_spot_valid"), F.col("_first_exit")),
            "spot_valid": F.col("entry_spot_valid") & F.col("exit_spot_valid"),
        }
    )
    return out.withColumn("dS", F.col("S_exit") - F.col("S_entry")).drop("_first_entry", "_first_exit", "_sound_entry", "_sound_exit")


def spot_by_underlying(contracts: DataFrame, tolerance: float = SPOT_TOLERANCE) -> DataFrame:
    """Spot agreement per underlying and date over entry and exit observations."""
    seen = contracts.select(
        "underlying_symbol",
        F.inline(
            F.array(
                F.struct(F.col("entry_date").alias("date"), F.col("entry_spot").alias("spot")),
                F.struct(F.col("exit_date").alias("date"), F.col("exit_spot").alias("spot")),
            )
        ),
    )
    out = seen.groupBy("underlying_symbol", "date").agg(
        F.min("spot").alias("min"), F.max("spot").alias("max"), F.count("spot").alias("count")
    )
    gap = F.col("max") - F.col("min")
    return out.withColumns(
        {"dispersion": gap, "valid": N.finite("min") & N.finite("max") & N.holds(F.col("min") > 0) & N.holds(gap <= tolerance)}
    )


def entry_controls(contracts: DataFrame) -> DataFrame:
    """Net and gross Greeks per model-day, the vega-balancing scales and the static
    hedge. Only signed entry weights and entry Greeks are read."""
    w = F.col("signed_weight")
    vega = F.col("entry_Vega")
    aggs = [
        F.bool_and(N.finite(vega) & N.holds(vega > 0)).alias("_vega_ok"),
        F.coalesce(F.sum(F.when(w > 0, w * vega)), F.lit(0.0)).alias("_long"),
        F.coalesce(-F.sum(F.when(w < 0, w * vega)), F.lit(0.0)).alias("_short"),
    ]
    for g in GREEKS:
        exposure = w * N.finite_or_null(f"entry_{g}")
        whole = F.count(exposure) == F.count(F.lit(1))
        aggs.append(F.when(whole, F.sum(exposure)).alias(f"Net{g}"))
        aggs.append(F.when(whole, F.sum(F.abs(exposure))).alias(f"GrossAbs{g}"))
    out = contracts.groupBy(*DAY).agg(*aggs)
    available = F.col("_vega_ok") & N.holds(F.col("_long") > 0) & N.holds(F.col("_short") > 0)
    out = out.withColumns(
        {
            "LongVega": F.when(F.col("_vega_ok"), F.col("_long")),
            "ShortVegaMagnitude": F.when(F.col("_vega_ok"), F.col("_short")),
            "vega_balance_available": available,
        }
    )
    budget = F.when(F.col("vega_balance_available"), F.least("LongVega", "ShortVegaMagnitude"))
    return out.withColumns(
        {
            "B": budget,
            "a_L": N.div(budget, "LongVega"),
            "a_S": N.div(budget, "ShortVegaMagnitude"),
            "vega_balance_status": F.when(F.col("vega_balance_available"), "AVAILABLE").otherwise(
                "INVALID_OR_ZERO_LEG_VEGA"
            ),
            "VegaImbalance": F.when(F.col("GrossAbsVega") > 0, N.div("NetVega", "GrossAbsVega")),
            "hedge_quantity": -F.col("NetDelta"),
        }
    ).drop("_vega_ok", "_long", "_short")


def vega_weights(contracts: DataFrame, controls: DataFrame) -> DataFrame:
    """Contracts with their vega-balanced weight (NULL where no balance exists)."""
    side = controls.select(*DAY, "a_L", "a_S", "vega_balance_available")
    out = contracts.join(side, DAY)
    out = out.withColumn("leg_scale", F.when(F.col("signed_weight") > 0, F.col("a_L")).otherwise(F.col("a_S")))
    return out.withColumn("w_vega", F.col("signed_weight") * F.col("leg_scale"))


def attribution(contracts: DataFrame, spots: DataFrame, processed: DataFrame) -> DataFrame:
    """Delta, Gamma, Theta components and residual; Vega only where the exit quote
    is the very processed observation whose volatility is stored."""
    c = F.col
    out = contracts.join(spots.select(*DAY, "S_entry", "S_exit", "dS", "spot_valid"), DAY)
    out = out.withColumn("dt_calendar_days", F.datediff("exit_date", "entry_date"))
    out = out.withColumns({"dt_years": c("dt_calendar_days") / 365.0, "DGT_available": c("spot_valid") & c("all_entry_greeks_finite")})
    have = c("DGT_available")
    out = out.withColumns(
        {
            "Delta_component": F.when(have, c("signed_weight") * c("entry_Delta") * c("dS")),
            "Gamma_component": F.when(have, 0.5 * c("signed_weight") * c("entry_Gamma") * c("dS") * c("dS")),
            "Theta_component": F.when(have, c("signed_weight") * c("entry_Theta") * c("dt_years")),
        }
    )
    explained = c("Delta_component") + c("Gamma_component") + c("Theta_component")
    out = out.withColumn("DGT_residual", F.when(have, c("pnl_mid") - explained))
    fields = ["implied_vol", "T", "r", "q", "mid", "bid", "ask", "source_observation_count"]
    stored = processed.select(
        F.col("quote_date").alias("intended_exit_date"),
        "contract_key",
        *[F.col(f).cast("double").alias(f"processed_exit_{f}") for f in fields],
    )
    out = out.join(stored, ["intended_exit_date", "contract_key"], "left")
    call = c("option_type") == "C"
    entry_inputs = ("entry_spot", "strike", "entry_T", "entry_r", "entry_q", "entry_implied_vol")
    exit_inputs = ("exit_spot", "strike", *[f"processed_exit_{f}" for f in ("T", "r", "q", "implied_vol")])
    out = N.with_option_price(out, "_entry_price", *entry_inputs, call)
    out = N.with_option_price(out, "_exit_price", *exit_inputs, call)
    priceable = lambda *names: N.holds(F.least(*[N.finite_or_null(n) for n in names]) > 0)
    out = out.withColumns(
        {
            "entry_IV_repricing_error": F.when(
                priceable("entry_spot", "strike", "entry_T", "entry_implied_vol"), F.abs(c("_entry_price") - c("entry_mid"))
            ),
            "exit_IV_repricing_error": F.when(
                priceable("exit_spot", "strike", "processed_exit_T", "processed_exit_implied_vol"),
                F.abs(c("_exit_price") - c("exit_mid")),
            ),
        }
    )
    out = out.drop("_entry_price", "_exit_price")
    same = lambda a, b: N.holds(F.abs(a - b) <= 1e-10)
    exact = (c("exit_quote_source") == PROCESSED) & have & c("entry_greeks_quality_valid")
    for name in ("entry_implied_vol", "processed_exit_implied_vol", "processed_exit_r", "processed_exit_q", "processed_exit_T"):
        exact = exact & N.finite(name)
    for name in ("entry_implied_vol", "processed_exit_implied_vol", "processed_exit_T"):
        exact = exact & N.holds(c(name) > 0)
    for name in ("mid", "bid", "ask"):
        exact = exact & same(c(f"processed_exit_{name}"), c(f"exit_{name}"))
    exact = exact & same(c("entry_T") - c("processed_exit_T"), c("dt_years"))
    exact = exact & N.holds(c("entry_source_observation_count") == 1)
    exact = exact & N.holds(c("processed_exit_source_observation_count") == 1)
    for leg in ("entry", "exit"):
        exact = exact & N.holds(c(f"{leg}_IV_repricing_error") <= REPRICING_TOLERANCE)
    out = out.withColumn("DGVT_available", exact)
    usable = c("DGVT_available")
    out = out.withColumn(
        "dIV_exact_contract", F.when(usable, c("processed_exit_implied_vol") - c("entry_implied_vol"))
    )
    out = out.withColumn("Vega_component", c("signed_weight") * c("entry_Vega") * c("dIV_exact_contract"))
    return out.withColumn("DGVT_residual", F.when(usable, c("DGT_residual") - c("Vega_component")))


EXPOSURES = [f"Net{g}" for g in GREEKS] + [f"GrossAbs{g}" for g in GREEKS] + ["LongVega", "ShortVegaMagnitude"]


def exposures(controls: DataFrame, baseline: DataFrame) -> DataFrame:
    """Daily exposures, raw and per unit of gross midpoint premium."""
    out = controls.join(baseline.select(*DAY, "decision_date", "exit_date", "GrossPremium_mid", "GrossPremium_exec"), DAY)
    return out.withColumns({f"{c}_per_gross_premium": N.div(c, "GrossPremium_mid") for c in EXPOSURES})


def exposure_summary(daily: DataFrame) -> DataFrame:
    """Distribution of 21 exposures per model."""
    names = [*EXPOSURES, "VegaImbalance", *[f"{c}_per_gross_premium" for c in EXPOSURES]]
    long = daily.select("model", *names).unpivot(["model"], names, "exposure", "x")
    x = F.col("x")
    return long.groupBy("model", "exposure").agg(
        F.count(x).alias("n_days"),
        F.avg(x).alias("mean"),
        F.median(x).alias("median"),
        F.stddev_samp(x).alias("std"),
        *[quantile(x, p).alias(n) for n, p in (("p05", 0.05), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95))],
        F.avg(F.abs(x)).alias("mean_absolute"),
    )


def balance_diagnostics(daily: DataFrame) -> DataFrame:
    out = daily.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if("vega_balance_available").alias("n_available"),
        F.avg("a_L").alias("mean_a_L"),
        F.avg("a_S").alias("mean_a_S"),
        F.min("a_L").alias("min_a_L"),
        F.min("a_S").alias("min_a_S"),
        F.avg(F.abs("NetDelta")).alias("original_mean_abs_NetDelta"),
        F.avg(F.abs("NetVega")).alias("original_mean_abs_NetVega"),
    )
    return out.withColumn("unavailable_day_pct", 100 * (1 - F.col("n_available") / F.col("n_days")))


def attribution_summary(attr: DataFrame, subset: bool = False) -> DataFrame:
    """Totals, daily moments and shares of each PnL component per model."""
    if subset:
        parts = ["Delta_component", "Gamma_component", "Vega_component", "Theta_component", "DGVT_residual"]
        flag, scope = "DGVT_available", "EXACT_IV_DIAGNOSTIC_SUBSET"
    else:
        parts = ["Delta_component", "Gamma_component", "Theta_component", "DGT_residual"]
        flag, scope = "DGT_available", "PRIMARY_DGT"
    used = F.col(flag)
    source = F.col("exit_quote_source")
    overall = attr.groupBy("model").agg(
        F.count(F.lit(1)).alias("_full"),
        F.count_if(used).alias("n_contracts"),
        F.sum(F.when(used, F.col("pnl_mid"))).alias("total_mid_pnl"),
        F.count_if(used & (source == PROCESSED)).alias("n_processed"),
        F.count_if(used & (source == RECOVERED)).alias("n_raw_recovered"),
    )
    by_day = attr.where(used).groupBy(*DAY).agg(*[F.sum(p).alias(p) for p in parts])
    long = by_day.unpivot(DAY, parts, "component", "x")
    totals = long.groupBy("model", "component").agg(
        F.countDistinct("entry_date").alias("n_days"),
        F.sum("x").alias("total_component"),
        F.avg("x").alias("mean_daily_component"),
        F.median("x").alias("median_daily_component"),
    )
    absolute = totals.groupBy("model").agg(F.sum(F.abs("total_component")).alias("_abs"))
    out = totals.join(absolute, "model").join(overall, "model")
    return out.select(
        "model",
        F.lit(scope).alias("scope"),
        "component",
        "n_contracts",
        (100 * F.col("n_contracts") / F.col("_full")).alias("coverage_pct"),
        "n_days",
        "total_mid_pnl",
        "total_component",
        "mean_daily_component",
        "median_daily_component",
        F.when(F.abs("total_mid_pnl") > 1e-12, N.div("total_component", "total_mid_pnl")).alias("signed_share_of_mid_pnl"),
        F.when(F.col("_abs") > 0, N.div(F.abs("total_component"), "_abs")).alias("absolute_aggregate_component_share"),
        "n_processed",
        "n_raw_recovered",
    )


def vega_balanced_contracts(contracts: DataFrame, controls: DataFrame) -> DataFrame:
    """Contracts re-valued at the vega-balanced weights, on days that have them."""
    weighted = vega_weights(contracts, controls).where("vega_balance_available")
    return contract_pnl(weighted.withColumn("weight_at_entry", F.col("w_vega")))


def vega_ledger(contracts: DataFrame, controls: DataFrame) -> DataFrame:
    """Original contracts beside their vega-balanced PnL (NULL on unavailable days)."""
    parts = ["pnl_mid", "pnl_exec", "gross_entry_premium_mid_component", "gross_entry_premium_exec_component"]
    scaled = vega_balanced_contracts(contracts, controls).select(*BOOK, *[F.col(p).alias("vb_" + p) for p in parts])
    return vega_weights(contracts, controls).join(scaled, BOOK, "left")


STATE_COLUMNS = [
    *DAY, "decision_date", "exit_date", "portfolio_state", "available", "number_contracts",
    "PnL_mid", "PnL_exec", "GrossPremium_mid", "GrossPremium_exec", "Return_mid", "Return_exec",
    "PnL_underlying", "hedge_quantity", "option_NetDelta", "NetDelta", "NetGamma", "NetVega", "NetTheta",
]


def portfolio_states(contracts: DataFrame, controls: DataFrame, spots: DataFrame, baseline: DataFrame) -> DataFrame:
    """The original portfolio and its delta-neutral, vega-balanced and joint variants.

    A day on which a control cannot be formed keeps its row with NULL results.
    """
    net = [f"Net{g}" for g in GREEKS]
    moves = spots.select(*DAY, "dS", "spot_valid")
    base_columns = [*DAY, "decision_date", "exit_date", "number_contracts", "PnL_mid", "PnL_exec", "GrossPremium_mid", "GrossPremium_exec"]

    def finish(df: DataFrame, state: str) -> DataFrame:
        """Add the hedge PnL, blank unavailable days and compute returns."""
        moved = F.when(F.col("available"), F.col("hedge_quantity") * F.col("dS"))
        df = df.withColumn("PnL_underlying", moved if "DELTA" in state else F.lit(0.0))
        for s in ("mid", "exec"):
            df = df.withColumn(f"PnL_{s}", F.when(F.col("available"), F.col(f"PnL_{s}") + F.col("PnL_underlying")))
            df = df.withColumn(f"Return_{s}", N.div(f"PnL_{s}", f"GrossPremium_{s}"))
        df = df.withColumn("NetDelta", F.col("option_NetDelta") + F.col("hedge_quantity"))
        return df.withColumn("portfolio_state", F.lit(state)).select(*STATE_COLUMNS)

    original = baseline.select(*base_columns).join(controls.select(*DAY, *net), DAY).join(moves, DAY)
    original = original.withColumns({"option_NetDelta": F.col("NetDelta")})
    plain = original.withColumns({"available": F.lit(True), "hedge_quantity": F.lit(0.0)})
    hedged = original.withColumns(
        {"hedge_quantity": -F.col("NetDelta"), "available": F.col("spot_valid") & N.finite("NetDelta")}
    )
    scaled = vega_balanced_contracts(contracts, controls)
    totals = scaled.groupBy(*DAY).agg(
        F.sum("pnl_mid").alias("PnL_mid"),
        F.sum("pnl_exec").alias("PnL_exec"),
        F.sum("gross_entry_premium_mid_component").alias("GrossPremium_mid"),
        F.sum("gross_entry_premium_exec_component").alias("GrossPremium_exec"),
        F.count(F.lit(1)).alias("number_contracts"),
    )
    balanced = (
        baseline.select(*DAY, "decision_date", "exit_date")
        .join(totals, DAY, "left")
        .join(controls.select(*DAY, "vega_balance_available"), DAY)
        .join(entry_controls(scaled).select(*DAY, *net), DAY, "left")
        .join(moves, DAY)
        .withColumn("option_NetDelta", F.col("NetDelta"))
    )
    vega = balanced.withColumns({"available": F.col("vega_balance_available"), "hedge_quantity": F.lit(0.0)})
    joint = balanced.withColumns(
        {
            "hedge_quantity": -F.col("option_NetDelta"),
            "available": F.col("vega_balance_available") & F.col("spot_valid") & N.finite("option_NetDelta"),
        }
    )
    frames = [finish(f, s) for f, s in zip((plain, hedged, vega, joint), STATES)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


REDUCTIONS = (
    ("ORIGINAL", "DELTA_NEUTRAL", "Delta"),
    ("ORIGINAL", "VEGA_BALANCED", "Vega"),
    ("VEGA_BALANCED", "VEGA_BALANCED_DELTA_NEUTRAL", "Delta"),
    ("VEGA_BALANCED", "VEGA_BALANCED_DELTA_NEUTRAL", "Vega"),
    ("ORIGINAL", "VEGA_BALANCED", "Gamma"),
    ("ORIGINAL", "VEGA_BALANCED", "Theta"),
    ("VEGA_BALANCED", "VEGA_BALANCED_DELTA_NEUTRAL", "Gamma"),
    ("VEGA_BALANCED", "VEGA_BALANCED_DELTA_NEUTRAL", "Theta"),
)


def exposure_reduction(states: DataFrame) -> DataFrame:
    """Mean and 95th percentile of absolute exposure before and after each control,
    over the dates available in both states."""
    live = states.where("available")
    wide = live.groupBy(*DAY).agg(
        *[
            F.max(F.when(F.col("portfolio_state") == s, F.abs(f"Net{g}"))).alias(f"{s}_{g}")
            for s in STATES
            for g in GREEKS
        ],
        *[F.bool_or(F.col("portfolio_state") == s).alias(f"has_{s}") for s in STATES],
    )
    pairs = wide.select(
        "model",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(b).alias("before_state"),
                        F.lit(a).alias("after_state"),
                        F.lit(g).alias("greek"),
                        (F.col(f"has_{b}") & F.col(f"has_{a}")).alias("both"),
                        F.col(f"{b}_{g}").alias("x"),
                        F.col(f"{a}_{g}").alias("y"),
                    )
                    for b, a, g in REDUCTIONS
                ]
            )
        ),
    ).where("both")
    out = pairs.groupBy("model", "before_state", "after_state", "greek").agg(
        F.count(F.lit(1)).alias("n_common_days"),
        F.avg("x").alias("before_mean_abs"),
        F.avg("y").alias("after_mean_abs"),
        quantile("x", 0.95).alias("before_p95_abs"),
        quantile("y", 0.95).alias("after_p95_abs"),
    )
    cut = lambda a, b: F.when(F.col(b) > 1e-12, 100 * (1 - N.div(a, b)))
    return out.withColumns(
        {
            "mean_abs_reduction_pct": cut("after_mean_abs", "before_mean_abs"),
            "p95_abs_reduction_pct": cut("after_p95_abs", "before_p95_abs"),
        }
    )


def signal_alignment(states: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Correlation of each state's returns with the day's signal strength, over dates
    on which all four states and the signal are present."""
    labels = ["top_minus_bottom", "predicted_cross_sectional_dispersion"]
    wide = states.groupBy(*DAY).agg(
        *[F.max(F.when(F.col("portfolio_state") == s, F.col("Return_mid"))).alias(s) for s in STATES]
    )
    joined = wide.join(diagnostics.select(*DAY, *labels), DAY)
    everywhere = N.finite(STATES[0])
    for s in STATES[1:]:
        everywhere = everywhere & N.finite(s)
    out = stats.correlations(joined.where(everywhere), ["model"], [(l, s) for l in labels for s in STATES], ("signal", "portfolio_state"))
    return out.withColumnRenamed("n_dates", "n_common_dates")
