"""Cross-sectional signals: candidate universe, z-scores, top-k selection, netting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.sizing import mean_rank
from ..settings import TRADED_MODELS, Inference, Signals
from . import stats

DECISION = "decision_date"
BOOK_KEY = ["model", "entry_date", "contract_key"]
NODE_FIELDS = (
    "node",
    "signal",
    "raw_signal",
    "z_score",
    "selection_rank",
    "selected",
    "T",
    "log_moneyness",
    "moneyness_region",
    "maturity_region",
    "observed_iv_at_decision",
    "actual_iv_entry",
    "actual_iv_exit",
    "actual_holding_change",
    "common_economic_candidate",
)
SELECTION_INPUTS = (
    "decision_date",
    "entry_date",
    "intended_exit_date",
    "node",
    "log_moneyness",
    "T",
    "observed_iv_at_decision",
    "moneyness_region",
    "maturity_region",
    "common_economic_candidate",
)


def candidates(frame: DataFrame, models=TRADED_MODELS) -> DataFrame:
    """Holding-change forecasts and the universe every model can trade."""
    observed = N.finite("observed_iv_at_decision")
    columns, common = {"observed_iv_available": observed}, None
    for m in models:
        h1, h2 = N.finite(f"forecast_{m}_h1"), N.finite(f"forecast_{m}_h2")
        change = F.col(f"forecast_{m}_h2") - F.col(f"forecast_{m}_h1")
        mine = observed & h1 & h2
        columns |= {
            f"available_{m}_h1": h1,
            f"available_{m}_h2": h2,
            f"candidate_{m}": mine,
            f"forecast_{m}_holding_change": change,
            f"available_{m}_holding_change": N.finite(change),
        }
        common = mine if common is None else common & mine
    columns["common_economic_candidate"] = common
    return frame.withColumns(columns)


def rank_signals(frame: DataFrame, rules: Signals = Signals(), models=TRADED_MODELS) -> DataFrame:
    """Standardise each model's forecast change across the day's candidates and
    select the strongest nodes per side.

    Only decision-time columns enter (`SELECTION_INPUTS` and the forecasts), so
    outcomes cannot change the selection. A day's cross-section is the grid, so
    the windows hold at most one row per node.
    """
    per_model = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(f"forecast_{m}_holding_change").alias("raw_signal"))
            for m in models
        ]
    )
    have = [c for c in SELECTION_INPUTS if c in frame.columns]
    df = frame.select(*have, F.explode(per_model).alias("m")).select(*have, "m.*")
    in_play = F.col("common_economic_candidate")
    day = Window.partitionBy("model", DECISION, "common_economic_candidate")
    sd, mean = F.stddev_samp("raw_signal").over(day), F.avg("raw_signal").over(day)
    z = F.when(in_play, F.when(sd > 0, (F.col("raw_signal") - mean) / sd).otherwise(0.0))
    df = df.withColumn("z_score", z)
    side = F.when(F.col("z_score") >= rules.threshold, 1).when(F.col("z_score") <= -rules.threshold, -1)
    df = df.withColumn("_side", side)
    strongest = Window.partitionBy("model", DECISION, "_side").orderBy(F.abs("z_score").desc(), "node")
    df = df.withColumn("selection_rank", F.when(F.col("_side").isNotNull(), F.row_number().over(strongest)))
    chosen = F.coalesce(F.col("selection_rank") <= rules.per_side, F.lit(False))
    return df.withColumns(
        {"selected": chosen, "signal": F.when(chosen, F.col("_side")).otherwise(0)}
    ).drop("_side")


def candidate_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy(DECISION).agg(F.count_if("common_economic_candidate").alias("n_common_candidates"))


def signal_daily(signals: DataFrame, minimum: int = 20) -> DataFrame:
    """Outcome diagnostics per model and day, joined after selection; selections
    without an outcome stay counted."""
    keys = ["model", DECISION]
    day = signals.where("common_economic_candidate")
    scored = N.finite("actual_iv_entry") & N.finite("actual_iv_exit")
    change, done = F.col("actual_holding_change"), N.finite("actual_holding_change")
    long = F.col("selected") & (F.col("signal") == 1)
    short = F.col("selected") & (F.col("signal") == -1)
    counts = day.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_common_candidates"),
        F.count_if(scored).alias("n_scored_nodes"),
        F.count_if(long).alias("n_selected_long"),
        F.count_if(short).alias("n_selected_short"),
        F.count_if(long & done).alias("n_scored_long"),
        F.count_if(short & done).alias("n_scored_short"),
        F.avg(F.when(long & done, change)).alias("long_mean_change"),
        F.avg(F.when(short & done, change)).alias("short_mean_change"),
        F.avg(F.when(long & done, (change > 0).cast("double"))).alias("long_hit_rate"),
        F.avg(F.when(short & done, (change < 0).cast("double"))).alias("short_hit_rate"),
    )
    counts = counts.withColumns(
        {
            "top_minus_bottom": F.col("long_mean_change") - F.col("short_mean_change"),
            "balanced_hit_rate": (F.col("long_hit_rate") + F.col("short_hit_rate")) / 2,
        }
    )
    ranked = day.where(scored).withColumns({"_x": mean_rank("raw_signal", keys), "_y": mean_rank("actual_holding_change", keys)})
    ic = ranked.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= minimum, stats.safe_corr("_x", "_y")).alias("rank_ic")
    )
    return counts.join(ic, keys, "left")


def signal_summary(daily: DataFrame, signals: DataFrame, inference: Inference = Inference()) -> DataFrame:
    """Per model: IC and spread moments with HAC tests, pooled and daily hit rates."""
    positive = lambda c: 100 * F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double")))
    moments = daily.groupBy("model").agg(
        F.avg("rank_ic").alias("mean_IC"),
        F.median("rank_ic").alias("median_IC"),
        F.stddev_samp("rank_ic").alias("std_IC"),
        F.count("rank_ic").alias("valid_IC_dates"),
        positive("rank_ic").alias("IC_percent_positive"),
        F.avg("top_minus_bottom").alias("mean_top_minus_bottom"),
        F.median("top_minus_bottom").alias("median_top_minus_bottom"),
        F.count("top_minus_bottom").alias("valid_spread_dates"),
        positive("top_minus_bottom").alias("spread_percent_positive"),
        F.avg("balanced_hit_rate").alias("mean_daily_balanced_hit"),
    )
    done = signals.where(F.col("selected") & N.finite("actual_holding_change"))
    change = F.col("actual_holding_change")
    hits = done.groupBy("model").agg(
        F.avg(F.when(F.col("signal") == 1, (change > 0).cast("double"))).alias("long_hit_rate"),
        F.avg(F.when(F.col("signal") == -1, (change < 0).cast("double"))).alias("short_hit_rate"),
        F.count_if(F.col("signal") == 1).alias("n_scored_long"),
        F.count_if(F.col("signal") == -1).alias("n_scored_short"),
    ).withColumn("balanced_hit_rate", (F.col("long_hit_rate") + F.col("short_hit_rate")) / 2)
    out = moments.join(hits, "model", "left")
    for value, prefix in (("rank_ic", "IC"), ("top_minus_bottom", "spread")):
        test = stats.hac_test(daily, ["model"], value, DECISION, inference.hac_lag, reference="student")
        out = out.join(
            test.select("model", F.col("HAC_t_stat").alias(f"{prefix}_NW_t"), F.col("raw_p").alias(f"{prefix}_p_value")),
            "model",
            "left",
        )
    return out.withColumn("hac_lag", F.lit(inference.hac_lag))


def net_contracts(trades: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Signed netting of nodes mapped to the same contract. A contract's cancelled
    legs stay as a FULLY_CANCELLED row, so signed weight is conserved."""
    mapped = trades.where((F.col("entry_mapping_status") == "MAPPED") & (F.col("weight_at_entry") != 0))
    dropped = {*BOOK_KEY, *NODE_FIELDS, "weight_at_entry"}
    carried = [c for c in trades.columns if c not in dropped]
    net = mapped.groupBy(*BOOK_KEY).agg(
        *[F.first(c).alias(c) for c in carried],
        F.sum("weight_at_entry").alias("weight_at_entry"),
        F.count(F.lit(1)).alias("n_mapped_nodes"),
        # A model-day selects at most 2 * per_side nodes, which bounds this list.
        F.array_join(F.array_sort(F.collect_list("node")), ";").alias("mapped_nodes"),
        F.sum(F.abs("weight_at_entry")).alias("node_gross_weight"),
        (F.min("signal") < F.max("signal")).alias("opposing_signals"),
    )
    active = F.abs("weight_at_entry") > tolerance
    net = net.withColumns(
        {
            "nonzero_net_position": active,
            "net_signal": F.when(active, F.signum("weight_at_entry").cast("int")).otherwise(0),
            "netting_status": F.when(active, "ACTIVE").otherwise("FULLY_CANCELLED"),
        }
    )
    if {"entry_bid", "entry_ask"} <= set(trades.columns):
        price = F.when(F.col("net_signal") > 0, F.col("entry_ask")).otherwise(F.col("entry_bid"))
        net = net.withColumn("entry_execution_price", F.when(F.col("nonzero_net_position"), price))
    return net


def collisions(trades: DataFrame, net: DataFrame) -> DataFrame:
    """How many selected nodes share a contract, before and after netting."""
    keys = ["model", "entry_date"]
    mapped = (F.col("entry_mapping_status") == "MAPPED") & (F.col("weight_at_entry") != 0)
    nodes = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected_nodes"),
        F.count_if(mapped).alias("entry_mapped_nodes"),
        F.coalesce(F.sum(F.when(mapped, F.abs("weight_at_entry"))), F.lit(0.0)).alias("gross_weight_before_netting"),
    )
    contracts = net.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_mapped_contracts"),
        F.max("n_mapped_nodes").alias("max_nodes_one_contract"),
        F.count_if("opposing_signals").alias("contracts_receiving_both_signals"),
        F.sum("weight_at_entry").alias("net_signed_weight"),
        F.sum(F.abs("weight_at_entry")).alias("gross_weight_after_netting"),
        F.count_if("nonzero_net_position").alias("active_net_contracts"),
    )
    out = nodes.join(contracts, keys, "left").na.fill(0)
    return out.withColumn("duplicated_mappings", F.col("entry_mapped_nodes") - F.col("unique_mapped_contracts")).withColumn(
        "collision_rate", N.div("duplicated_mappings", "entry_mapped_nodes")
    )
