"""Validation: tolerance checks, keyed table comparison, invariants, join guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..settings import TRADED_MODELS
from .pnl import DAY


class DuplicateKeys(ValueError):
    """A join side that must have unique keys does not."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their counts (partially aggregated)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def validated_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "many_to_one", matched: bool = False
) -> DataFrame:
    """Join that fails on duplicate keys where they are not allowed, and optionally
    on unmatched left rows. The key probe is a separate aggregated pass."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[validate]
    for side in sides:
        if not duplicate_keys(side, keys).isEmpty():
            raise DuplicateKeys(f"{validate} join on {keys} has duplicate keys")
    if not matched:
        return left.join(right, keys, how)
    out = left.join(right.withColumn("_hit", F.lit(True)), keys, how)
    seen = F.when(F.col("_hit").isNull(), F.raise_error(F.lit("unmatched join key")).cast("boolean")).otherwise(F.col("_hit"))
    return out.withColumn("_hit", seen).where("_hit").drop("_hit")


def _verdict(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def tolerance_check(
    name: str, observed: DataFrame, reference: DataFrame, keys: list[str], column: str, tolerance: float = 0.0
) -> DataFrame:
    """One check row: same keys, same missing and infinite pattern, and a largest
    absolute difference within the tolerance."""
    a = observed.select(*keys, F.col(column).cast("double").alias("_a"), F.lit(True).alias("_in_a"))
    b = reference.select(*keys, F.col(column).cast("double").alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full")
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    infinite = lambda c: N.holds(F.abs(c) == float("inf"))
    gap = F.when(N.finite("_a") & N.finite("_b"), F.abs(F.col("_a") - F.col("_b")))
    out = both.agg(
        F.count("_in_a").alias("observed_rows"),
        F.count("_in_b").alias("reference_rows"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("_unmatched"),
        F.count_if((missing("_a") != missing("_b")) | (infinite("_a") != infinite("_b"))).alias("_pattern"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs_difference"),
    )
    ok = (F.col("_unmatched") == 0) & (F.col("_pattern") == 0) & (F.col("max_abs_difference") <= tolerance)
    return out.select(
        F.lit(name).alias("check_name"),
        _verdict(ok).alias("status"),
        "observed_rows",
        "reference_rows",
        "max_abs_difference",
        F.lit(float(tolerance)).alias("tolerance"),
    )


def table_diff(new: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Cell-by-cell comparison of two keyed tables.

    First a row for the keys themselves, then one row per numeric expected cell.
    A column absent from the new table is skipped, a key found on one side only
    fails.
    """
    kinds = dict(expected.dtypes)
    numeric = [c for c in expected.columns if c not in keys and c in new.columns and kinds[c] not in ("string", "boolean", "date")]
    text = [F.col(k).cast("string").alias(k) for k in keys]
    cells = lambda df, name: df.select(*text, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        keys, numeric, "column", name
    )
    pairs = cells(new, "new_value").withColumn("_n", F.lit(1)).join(
        cells(expected, "reference_value").withColumn("_e", F.lit(1)), [*keys, "column"], "full"
    )
    none = lambda c: F.col(c).isNull() | F.isnan(c)
    one_side = F.col("_n").isNull() | F.col("_e").isNull()
    gap = (
        F.when(one_side, F.lit(float("inf")))
        .when(none("new_value") & none("reference_value"), 0.0)
        .when(N.finite("new_value") & N.finite("reference_value"), F.abs(F.col("new_value") - F.col("reference_value")))
        .otherwise(float("inf"))
    )
    key_text = F.concat_ws(";", *[F.concat(F.lit(k + "="), F.col(k)) for k in keys])
    detail = pairs.select(
        F.concat(F.col("column"), F.lit("["), key_text, F.lit("]")).alias("result_name"),
        "reference_value",
        "new_value",
        gap.alias("absolute_difference"),
        F.lit(float(tolerance)).alias("tolerance"),
    )
    a = new.select(*text).withColumn("_n", F.lit(1))
    b = expected.select(*text).withColumn("_e", F.lit(1))
    keyed = a.join(b, keys, "full").agg(
        F.lit("row_keys").alias("result_name"),
        F.count("_e").cast("double").alias("reference_value"),
        F.count("_n").cast("double").alias("new_value"),
        F.count_if(F.col("_n").isNull() | F.col("_e").isNull()).cast("double").alias("absolute_difference"),
        F.lit(0.0).alias("tolerance"),
    )
    return keyed.unionByName(detail).withColumn("status", _verdict(F.col("absolute_difference") <= F.col("tolerance")))


def count_checks(counts: DataFrame, expected: DataFrame, key: str = "check_name") -> DataFrame:
    """Observed counts against expected counts by name."""
    both = counts.withColumnRenamed("n", "observed").join(expected.withColumnRenamed("n", "reference"), key, "full")
    return both.withColumn("status", _verdict(N.holds(F.col("observed") == F.col("reference"))))


def same_frames(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """One check row: equal as multisets. Differing rows are counted with signs in a
    single aggregation, so neither frame is collected."""
    columns = a.columns
    signed = a.select(*columns).withColumn("_s", F.lit(1)).unionByName(b.select(*columns).withColumn("_s", F.lit(-1)))
    off = signed.groupBy(*columns).agg(F.sum("_s").alias("_s")).where(F.col("_s") != 0)
    return off.agg(F.coalesce(F.sum(F.abs("_s")), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations", _verdict(F.col("violations") == 0).alias("status")
    )


def selection_ignores_outcomes(economic: DataFrame, select, outcomes: list[str]) -> DataFrame:
    """Overwrite every outcome column with an absurd value; the selection must not move."""
    poisoned = economic.withColumns({c: F.lit(1e9) for c in outcomes})
    return same_frames("signal_selection_ignores_future_IV", select(economic), select(poisoned))


def same_candidates(signals: DataFrame, models=TRADED_MODELS) -> DataFrame:
    """Every model sees the same candidate universe."""
    cells = signals.where("common_economic_candidate").groupBy("decision_date", "node").agg(
        F.countDistinct("model").alias("m"), F.count(F.lit(1)).alias("n")
    )
    bad = cells.agg(F.count_if((F.col("m") != len(models)) | (F.col("n") != len(models))).alias("violations"))
    return _rows(bad, "same_candidates_all_three_models")


def _rows(one: DataFrame, name: str) -> DataFrame:
    return one.select(F.lit(name).alias("check_name"), "violations", _verdict(F.col("violations") == 0).alias("status"))


def _count(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return _rows(df.agg(F.count_if(N.holds(bad)).alias("violations")), name)


def _apart(a: Column, b: Column, tolerance: float) -> Column:
    """TRUE where two numbers differ beyond tolerance or only one is present."""
    one_missing = a.isNull() != b.isNull()
    return one_missing | N.holds(F.abs(a - b) > tolerance)


def invariants(
    journal: DataFrame,
    economic: DataFrame,
    signals: DataFrame,
    trades: DataFrame,
    ready: DataFrame,
    active: DataFrame,
    contracts: DataFrame,
    attr: DataFrame,
    exposures: DataFrame,
    states: DataFrame,
    multiple: DataFrame,
    select,
    outcomes=("actual_iv_entry", "actual_iv_exit", "actual_holding_change"),
) -> DataFrame:
    """The accounting identities of the study, one row each with its violation count."""
    c = F.col
    common = journal.where("common_sample_4models")
    all_finite = N.finite("actual_iv_at_target")
    for m in ("persistence", "arima", "ridge", "xgboost"):
        all_finite = all_finite & N.finite(f"forecast_{m}")
    mapped = trades.where(c("weight_at_entry") != 0)
    sides = mapped.groupBy(*DAY, "signal").agg(F.sum("weight_at_entry").alias("w"))
    signed = mapped.groupBy(*DAY).agg(F.sum("weight_at_entry").alias("_w")).join(
        ready.groupBy(*DAY).agg(F.sum("weight_at_entry").alias("_net")), DAY, "full"
    )
    exact = attr.where("DGVT_available")
    hedged = states.where(c("portfolio_state").contains("DELTA_NEUTRAL") & c("available"))
    balanced = states.where(c("portfolio_state").startswith("VEGA_BALANCED") & c("available"))
    dgt = c("Delta_component") + c("Gamma_component") + c("Theta_component")
    scales = N.holds((c("a_L") < 0) | (c("a_L") > 1 + 1e-12) | (c("a_S") < 0) | (c("a_S") > 1 + 1e-12))
    rows = [
        _count(common, "common_forecasts_finite", ~all_finite),
        selection_ignores_outcomes(economic, select, list(outcomes)),
        same_candidates(signals),
        _count(sides, "entry_side_half_budgets", F.abs(F.abs(c("w")) - 0.5) > 1e-12),
        _count(signed, "contract_netting_signed_conservation", _apart(c("_w"), c("_net"), 1e-12)),
        _rows(
            duplicate_keys(contracts, [*DAY, "contract_key"]).agg(F.count(F.lit(1)).alias("violations")),
            "no_duplicate_active_contracts",
        ),
        _count(active, "BASE_exit_coverage_after_calendar", ~F.coalesce(c("BASE"), F.lit(False))),
        _count(
            contracts,
            "exact_exit_identity",
            ~(c("contract_key").eqNullSafe(c("exit_contract_key")) & c("intended_exit_date").eqNullSafe(c("exit_quote_date"))),
        ),
        _count(
            contracts,
            "mid_price_identity",
            _apart(c("pnl_mid"), c("signed_weight") * (c("exit_mid") - c("entry_mid")), 1e-10),
        ),
        _count(
            contracts,
            "bid_ask_spread_accounting",
            _apart(c("cost_wedge_pnl"), c("entry_spread_cost") + c("exit_spread_cost"), 1e-10),
        ),
        _count(attr, "DGT_identity", _apart(c("pnl_mid"), dgt + c("DGT_residual"), 1e-10)),
        _count(attr, "full_DGT_coverage", ~c("DGT_available")),
        _count(exact, "DGVT_identity", _apart(c("pnl_mid"), dgt + c("Vega_component") + c("DGVT_residual"), 1e-10)),
        _count(exposures, "entry_controls_do_not_leverage", scales),
        _count(hedged, "entry_delta_neutral", _apart(c("NetDelta"), F.lit(0.0), 1e-10)),
        _count(balanced, "entry_vega_balanced", _apart(c("NetVega"), F.lit(0.0), 1e-10)),
        *[
            _count(
                states, f"normalization_{s}", _apart(c(f"Return_{s}"), N.div(f"PnL_{s}", f"GrossPremium_{s}"), 1e-12)
            )
            for s in ("mid", "exec")
        ],
        *[
            _rows(
                multiple.agg(F.abs(F.count_if(c("family").startswith(f"PRIMARY_{i}_")) - 12).alias("violations")),
                f"twelve_test_family_{i}",
            )
            for i in ("MID", "BID_ASK")
        ],
    ]
    return reduce(DataFrame.unionByName, rows)
