"""Real contracts for grid nodes: identity, daily market, nearest entry, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.sizing import small_side
from ..plans.lineage import cut
from ..settings import Signals
from .calendar import snapshot_guard
from .nearest import nearest

IDENTITY = ["contract_key", "underlying_symbol", "root", "expiration", "strike", "option_type"]
MARKET_VALUES = ["bid", "ask", "bid_eod", "ask_eod", "mid", "spot", "moneyness", "log_moneyness", "T", "implied_vol", "r", "q"]
ENTRY_VALUES = [
    "bid", "ask", "mid", "spot", "implied_vol", "T", "r", "q",
    "trade_volume", "open_interest", "log_moneyness", "source_observation_count",
]


def normalise_market(quotes: DataFrame) -> DataFrame:
    """Typed processed quotes with the six-decimal contract identity; quotes that lack
    a part of it belong to no contract and are left out (`identified` keeps them)."""
    return identified(quotes).where(F.col("contract_key").isNotNull())


def identified(quotes: DataFrame) -> DataFrame:
    """All quotes, typed, with a NULL key where symbol, root, expiration, strike or side is missing."""
    typed = quotes.withColumns(
        {
            "quote_date": X.as_date(quotes, "quote_date") if dict(quotes.dtypes)["quote_date"] != "string" else X.strict_date("quote_date"),
            "expiration": X.as_date(quotes, "expiration") if dict(quotes.dtypes)["expiration"] != "string" else X.strict_date("expiration"),
            "underlying_symbol": X.label("underlying_symbol"),
            "root": X.label("root"),
            "option_type": X.option_side("option_type"),
            "strike": X.rounded_strike(N.number("strike")),
            **{c: N.number(c) for c in ("spot", "mid", "moneyness", "T", "implied_vol", "trade_volume", "open_interest", "bid_eod", "ask_eod")},
        }
    )
    return typed.select(
        "quote_date",
        X.contract_key("underlying_symbol", "root", "expiration", "strike", "option_type").alias("contract_key"),
        *IDENTITY[1:],
        N.number("bid_1545").alias("bid"),
        N.number("ask_1545").alias("ask"),
        "bid_eod",
        "ask_eod",
        "mid",
        "spot",
        "moneyness",
        N.log_moneyness("moneyness").alias("log_moneyness"),
        "T",
        "implied_vol",
        N.number("r_annual").alias("r"),
        N.number("q_annual").alias("q"),
        "trade_volume",
        "open_interest",
    )


def market_day(normalised: DataFrame) -> DataFrame:
    """One row per day and contract: mean prices, summed volume and open interest.

    Every aggregate is partially combined before the shuffle, so a contract
    quoted many times costs one row per task. All buffers have a fixed width,
    which keeps the aggregation on hashes instead of a sort of all quotes.
    """
    collapsed = normalised.groupBy("quote_date", *IDENTITY).agg(
        *[F.avg(c).alias(c) for c in MARKET_VALUES],
        F.coalesce(F.sum("trade_volume"), F.lit(0.0)).alias("trade_volume"),
        F.coalesce(F.sum("open_interest"), F.lit(0.0)).alias("open_interest"),
        F.count(F.lit(1)).alias("source_observation_count"),
    )
    return collapsed.withColumn("snapshot_label", F.lit("1545"))


def valid_market(market: DataFrame) -> DataFrame:
    return market.where(
        N.two_sided("bid", "ask")
        & N.finite("spot")
        & N.holds(F.col("spot") > 0)
        & N.finite("T")
        & N.holds(F.col("T") > 0)
        & N.finite("log_moneyness")
        & F.col("option_type").isin("C", "P")
        & (F.col("expiration") > F.col("quote_date"))
    )


def map_entry(selected: DataFrame, market: DataFrame, calendar: DataFrame, rules: Signals = Signals()) -> DataFrame:
    """Attach the nearest valid contract quoted on the entry date to each selected node.

    Quotes of any other date cannot match: the join key is the entry date. A
    date whose session closes before the snapshot maps nothing.
    """
    guarded = snapshot_guard(selected, "entry_date", calendar, "_open")
    targets = guarded.where("_open").select("entry_date", "node", "log_moneyness", "T").distinct()
    valid = valid_market(market).withColumnRenamed("quote_date", "entry_date")
    hit = cut(
        nearest(
            targets,
            valid,
            "entry_date",
            "node",
            "contract_key",
            x_scale=rules.x_scale,
            t_scale=rules.t_scale,
            tie_tolerance=rules.tie_tolerance,
        )
    )
    # The matches are a small table (at most one per node and date), so the market
    # is scanned for their books without being shuffled.
    book = valid.select(
        "entry_date", *IDENTITY, *[F.col(c).alias("entry_" + c) for c in ENTRY_VALUES]
    )
    mapped = book.join(small_side(hit), ["entry_date", "contract_key"])
    out = guarded.join(mapped, ["entry_date", "node"], "left")
    found = F.col("contract_key").isNotNull()
    return out.withColumns(
        {
            "entry_mapping_status": F.when(~F.col("_open"), "MARKET_CLOSED_AT_1545")
            .when(found, "MAPPED")
            .otherwise("NO_ENTRY_MARKET"),
            "abs_log_moneyness_diff": F.abs(F.col("entry_log_moneyness") - F.col("log_moneyness")),
            "abs_T_diff": F.abs(F.col("entry_T") - F.col("T")),
            "entry_execution_price": F.when(F.col("signal") == 1, F.col("entry_ask")).otherwise(F.col("entry_bid")),
        }
    ).drop("_open")


def lock_weights(mapped: DataFrame, budget: float = 0.5) -> DataFrame:
    """Half the budget long, half short, counted over mapped nodes only; a day with
    one empty side gets no weight."""
    day = Window.partitionBy("model", "entry_date")
    ok = F.col("entry_mapping_status") == "MAPPED"
    longs = F.count_if(ok & (F.col("signal") == 1)).over(day)
    shorts = F.count_if(ok & (F.col("signal") == -1)).over(day)
    both = (longs > 0) & (shorts > 0)
    weight = (
        F.when(ok & both & (F.col("signal") == 1), F.lit(budget) / longs)
        .when(ok & both & (F.col("signal") == -1), F.lit(-budget) / shorts)
        .otherwise(0.0)
    )
    status = (
        F.when(~ok, "NO_ENTRY").when(both, "LOCKED_SIDE_NEUTRAL").otherwise("NO_BOTH_SIDES_AT_ENTRY")
    )
    return mapped.withColumns({"weight_at_entry": weight, "entry_weight_status": status})


def assemble_trades(signals: DataFrame, market: DataFrame, calendar: DataFrame, rules: Signals = Signals()) -> DataFrame:
    """All models and dates in one plan: mapping, weights, entry Greeks, status."""
    mapped = map_entry(signals.where("selected"), market, calendar, rules)
    weighted = lock_weights(mapped, rules.side_budget)
    priced = N.with_greeks(
        weighted,
        "entry_",
        "entry_spot",
        "strike",
        "entry_T",
        "entry_r",
        "entry_q",
        "entry_implied_vol",
        N.holds(F.col("option_type") == "C"),
    )
    return priced.withColumn("trade_status", F.when(F.col("weight_at_entry") != 0, "ENTERED").otherwise("NOT_ENTERED"))
