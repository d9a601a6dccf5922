"""Exact exit quotes: required pairs, raw recovery, source priority, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.sizing import exact_quantiles, small_side
from ..settings import NO_QUOTE, PROCESSED, RATE_DATE, RECOVERED, Cleaning
from .calendar import snapshot_guard
from .mapping import IDENTITY

EXIT_KEY = ["intended_exit_date", "contract_key"]
QUOTE_KEY = ["quote_date", "contract_key"]
QUOTE_SOURCES = (PROCESSED, RECOVERED, NO_QUOTE)
RAW_VALUES = ["bid_1545", "ask_1545", "bid_eod", "ask_eod", "mid", "spot", "underlying_bid_1545", "underlying_ask_1545"]
SOURCE_TABLES = {PROCESSED: "processed_quotes", RECOVERED: "raw_quotes"}


def required_pairs(net: DataFrame) -> DataFrame:
    return net.select(*EXIT_KEY).distinct()


def as_quote_key(required: DataFrame) -> DataFrame:
    return required.select(F.col("intended_exit_date").alias("quote_date"), "contract_key")


def processed_pairs(market: DataFrame, required: DataFrame) -> DataFrame:
    """Processed quotes of exactly the required (date, contract) pairs."""
    return market.join(small_side(as_quote_key(required)), QUOTE_KEY, "left_semi")


def absent_pairs(required: DataFrame, processed: DataFrame) -> DataFrame:
    """Required pairs with no processed row. A pair that is present but invalid is
    not searched again."""
    present = processed.select(F.col("quote_date").alias("intended_exit_date"), "contract_key")
    return required.join(present, EXIT_KEY, "left_anti")


def _typed_raw(raw: DataFrame) -> DataFrame:
    iso = lambda c: F.col(c) if dict(raw.dtypes)[c] == "date" else X.iso_date(c)
    return raw.withColumns(
        {
            "quote_date": iso("quote_date"),
            "expiration": iso("expiration"),
            "underlying_symbol": X.label("underlying_symbol"),
            "root": X.label("root"),
            "option_type": X.option_side("option_type"),
            "strike": X.rounded_strike(N.number("strike")),
        }
    )


def _with_identity(typed: DataFrame) -> DataFrame:
    known = F.col("expiration").isNotNull() & F.col("strike").isNotNull()
    key = X.contract_key("underlying_symbol", "root", "expiration", "strike", "option_type")
    return typed.withColumns(
        {
            "contract_key": F.when(known, key),
            "spot": N.midpoint("underlying_bid_1545", "underlying_ask_1545"),
            "mid": N.midpoint("bid_1545", "ask_1545"),
        }
    )


def normalise_raw(raw: DataFrame) -> DataFrame:
    """Raw quotes with ISO dates (anything else is missing), labels, identity and midpoints."""
    return _with_identity(_typed_raw(raw))


def recover_raw(raw: DataFrame, missing: DataFrame, rates: DataFrame, rules: Cleaning = Cleaning()) -> DataFrame:
    """Search the raw archive for the missing pairs and say which default rules
    each found quote breaks. One pass: the wanted dates filter rows first, the
    exact contracts are met on their typed parts, and only found rows get a key."""
    part = F.split("contract_key", r"\|")
    identity = ["quote_date", "_symbol", "_root", "_expiration", "_micro", "_side"]
    wanted = small_side(
        as_quote_key(missing).select(
            "quote_date",
            part[0].alias("_symbol"),
            part[1].alias("_root"),
            X.iso_date(part[2]).alias("_expiration"),
            F.rint(part[3].cast("double") * 1e6).cast("long").alias("_micro"),
            part[4].alias("_side"),
        )
    )
    dates = small_side(as_quote_key(missing).select("quote_date").distinct())
    is_text = dict(raw.dtypes)["quote_date"] == "string"
    spelled = dates.select(F.date_format("quote_date", "yyyy-MM-dd").alias("quote_date")) if is_text else dates
    near = raw.join(small_side(spelled), "quote_date", "left_semi")
    typed = _typed_raw(near).withColumns(
        {
            "_symbol": F.col("underlying_symbol"),
            "_root": F.col("root"),
            "_expiration": F.col("expiration"),
            "_micro": F.rint(F.col("strike") * 1e6).cast("long"),
            "_side": F.col("option_type"),
        }
    )
    found = _with_identity(typed.join(wanted, identity, "left_semi").drop(*identity[1:]))
    rate_days = small_side(rates.select(F.col(RATE_DATE).alias("quote_date"), F.lit(True).alias("_rate")).distinct())
    found = found.join(rate_days, "quote_date", "left").withColumn("_t", N.year_fraction("quote_date", "expiration"))
    found = found.withColumn(
        "observable_failure_reasons",
        X.quote_failures(
            "bid_1545", "ask_1545", "trade_volume", "open_interest", "spot", "strike", "_t", "option_type", F.col("_rate"), rules
        ),
    )
    # At most 2 ** 10 different reason lists exist, which bounds the collected set.
    reasons = F.array_join(
        F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("observable_failure_reasons"), lambda s: F.split(s, ";"))))), ";"
    )
    return found.groupBy("quote_date", *IDENTITY).agg(
        *[F.avg(c).alias(c) for c in RAW_VALUES],
        F.coalesce(F.sum("trade_volume"), F.lit(0)).cast("double").alias("trade_volume"),
        F.coalesce(F.sum("open_interest"), F.lit(0)).cast("double").alias("open_interest"),
        reasons.alias("observable_failure_reasons"),
        F.count(F.lit(1)).alias("source_observation_count"),
    )


def choose_quotes(required: DataFrame, processed: DataFrame, raw: DataFrame, calendar: DataFrame) -> DataFrame:
    """One exit book per required pair: a valid processed quote, else a valid raw
    quote, else none. Only the exact key, the calendar guard and the book decide;
    diagnostics are attached afterwards."""
    out = required.select(*EXIT_KEY)
    for label, frame, bid, ask in (("processed", processed, "bid", "ask"), ("raw", raw, "bid_1545", "ask_1545")):
        extra = [c for c in ("trade_volume", "open_interest", "observable_failure_reasons", "spot", "source_observation_count") if c in frame.columns]
        side = frame.select(
            F.col("quote_date").alias("intended_exit_date"),
            "contract_key",
            F.col(bid).alias(f"{label}_bid"),
            F.col(ask).alias(f"{label}_ask"),
            F.lit(True).alias(f"{label}_available"),
            *[F.col(c).alias(f"{label}_{c}") for c in extra],
        )
        out = out.join(side, EXIT_KEY, "left").withColumn(f"{label}_available", F.coalesce(f"{label}_available", F.lit(False)))
    for c, kind in (("raw_trade_volume", "double"), ("raw_open_interest", "double"), ("processed_trade_volume", "double"), ("raw_observable_failure_reasons", "string")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    out = snapshot_guard(out, "intended_exit_date", calendar)
    guard = F.col("calendar_guard_pass")
    out = out.withColumns(
        {
            "processed_valid": F.col("processed_available") & guard & N.two_sided("processed_bid", "processed_ask"),
            "raw_valid": F.col("raw_available") & guard & N.two_sided("raw_bid", "raw_ask"),
        }
    )
    first, second = F.col("processed_valid"), F.col("raw_valid")
    pick = lambda a, b: F.when(first, F.col(a)).when(second, F.col(b))
    out = out.withColumns(
        {
            "exit_quote_source": F.when(first, PROCESSED).when(second, RECOVERED).otherwise(NO_QUOTE),
            "BASE": first | second,
            "exit_bid": pick("processed_bid", "raw_bid"),
            "exit_ask": pick("processed_ask", "raw_ask"),
            "exit_quote_date": F.when(first | second, F.col("intended_exit_date")),
            "exit_contract_key": F.when(first | second, F.col("contract_key")),
            "source_file": F.when(first, SOURCE_TABLES[PROCESSED]).when(second, SOURCE_TABLES[RECOVERED]).otherwise(""),
            "raw_relative_spread": N.relative_spread("raw_bid", "raw_ask"),
            "zero_volume_flag": N.holds(F.col("raw_trade_volume") == 0),
            "zero_open_interest_flag": N.holds(F.col("raw_open_interest") == 0),
            "nonpositive_volume_flag": N.holds(F.col("raw_trade_volume") <= 0),
            "nonpositive_open_interest_flag": N.holds(F.col("raw_open_interest") <= 0),
            "exit_quote_trade_volume": pick("processed_trade_volume", "raw_trade_volume"),
            "recovery_reason_category": X.reason_category("raw_observable_failure_reasons"),
        }
    )
    out = out.withColumns(
        {"exit_mid": N.midpoint("exit_bid", "exit_ask"), "relative_spread": N.relative_spread("exit_bid", "exit_ask")}
    )
    return out.withColumns(
        {
            "STRICT_20": F.col("BASE") & N.holds(N.spread_at_most("relative_spread", 0.2)),
            "STRICT_10": F.col("BASE") & N.holds(N.spread_at_most("relative_spread", 0.1)),
            "POSITIVE_VOLUME": F.col("BASE") & N.holds(F.col("exit_quote_trade_volume") > 0),
        }
    )


def join_trades(net: DataFrame, quotes: DataFrame) -> DataFrame:
    """Replace the exit fields of every entered contract; earlier exit fields are
    kept under a `stage3_` prefix. A contract without a required-pair row is an
    error."""
    earlier = ("preferred_exit_source", "exact_exit_available", "exit_status", "exit_bid", "exit_ask", "exit_mid", "exit_spot", "source_file", "exit_quote_date", "exit_contract_key")
    out = net.withColumns({"stage3_" + c: F.col(c) for c in earlier if c in net.columns})
    out = out.drop(*[c for c in quotes.columns if c not in EXIT_KEY and c in net.columns])
    out = out.join(quotes, EXIT_KEY, "left")
    base = F.when(F.col("BASE").isNull(), F.raise_error(F.lit("a held contract was not looked up at its exit date")).cast("boolean")).otherwise(F.col("BASE"))
    have = lambda c: F.col(c) if c in quotes.columns else F.lit(None).cast("double")
    source = F.col("exit_quote_source")
    return out.withColumn("BASE", base).withColumns(
        {
            "preferred_exit_source": source,
            "exact_exit_available": F.col("BASE"),
            "exit_status": F.when(F.col("BASE"), "VALID_EXACT_1545_QUOTE").otherwise(NO_QUOTE),
            "exit_spot": F.when(source == PROCESSED, have("processed_spot")).when(source == RECOVERED, have("raw_spot")),
        }
    )


def coverage(trades: DataFrame) -> DataFrame:
    """Exit coverage of active contracts per model."""
    pct = lambda flag: 100 * F.avg(flag.cast("double"))
    source = F.col("exit_quote_source")
    recovered = source == RECOVERED
    subsets = []
    for name in ("STRICT_20", "STRICT_10", "POSITIVE_VOLUME"):
        subsets += [F.count_if(name).alias(f"{name}_valid_exits"), pct(F.col(name)).alias(f"{name}_coverage_pct")]
    return trades.where("nonzero_net_position").groupBy("model").agg(
        F.count(F.lit(1)).alias("entered_active_net_contracts"),
        F.count_if(source == PROCESSED).alias("processed_valid_exits"),
        pct(source == PROCESSED).alias("processed_only_coverage_pct"),
        F.count_if(recovered).alias("raw_additional_recovered_exits"),
        F.count_if("BASE").alias("total_valid_BASE_exits"),
        F.count_if(~F.col("BASE")).alias("remaining_missing"),
        pct(F.col("BASE")).alias("BASE_coverage_pct"),
        pct(~F.col("BASE")).alias("remaining_missing_pct"),
        *subsets,
        (100 * F.avg(F.when(recovered, F.col("zero_volume_flag").cast("double")))).alias("recovered_zero_volume_pct"),
        (
            100 * F.avg(F.when(recovered, (F.col("recovery_reason_category") == "NONPOSITIVE_VOLUME_ONLY").cast("double")))
        ).alias("recovered_nonpositive_volume_only_pct"),
    )


def _levels(quotes: DataFrame, trades: DataFrame, columns: list[str]) -> DataFrame:
    pairs = quotes.select(F.lit("unique_required_pairs").alias("level"), F.lit("ALL").alias("model"), *columns)
    active = trades.where("nonzero_net_position").select(F.lit("active_net_contracts").alias("level"), "model", *columns)
    return pairs.unionByName(active)


def _complete(levels: DataFrame, name: str, values) -> DataFrame:
    """Every (level, model) with every label, so absent combinations report zero."""
    return levels.select("level", "model").distinct().withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def recovery_reasons(quotes: DataFrame, trades: DataFrame) -> DataFrame:
    """Recovered quotes per reason category, zero counts included."""
    rows = _levels(quotes, trades, ["exit_quote_source", "recovery_reason_category"])
    recovered = rows.where(F.col("exit_quote_source") == RECOVERED)
    counts = recovered.groupBy("level", "model", F.col("recovery_reason_category").alias("category")).agg(
        F.count(F.lit(1)).alias("count")
    )
    totals = recovered.groupBy("level", "model").agg(F.count(F.lit(1)).alias("n_recovered"))
    out = _complete(rows, "category", X.REASON_CATEGORIES).join(counts, ["level", "model", "category"], "left")
    out = out.join(totals, ["level", "model"], "left").na.fill(0, ["count", "n_recovered"])
    return out.withColumn("percent", 100 * N.div("count", "n_recovered"))


def quote_quality(quotes: DataFrame, trades: DataFrame) -> DataFrame:
    """Spread distribution and threshold counts per quote source."""
    columns = ["exit_quote_source", "relative_spread", "raw_trade_volume", "zero_volume_flag", "zero_open_interest_flag", "calendar_guard_pass"]
    by = ["level", "model", "source"]
    rows = _levels(quotes, trades, columns).withColumnRenamed("exit_quote_source", "source")
    spread = F.col("relative_spread")
    spreads = exact_quantiles(rows, by, "relative_spread", {"median_relative_spread": 0.5, "q90_relative_spread": 0.9})
    grouped = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(spread).alias("mean_relative_spread"),
        F.max(spread).alias("max_relative_spread"),
        F.count_if(~N.spread_at_most(spread, 0.2)).alias("n_spread_gt_20"),
        F.count_if(~N.spread_at_most(spread, 0.1)).alias("n_spread_gt_10"),
        F.count("raw_trade_volume").alias("n_raw_volume_observed"),
        F.count_if("zero_volume_flag").alias("n_raw_zero_volume"),
        F.count_if("zero_open_interest_flag").alias("n_raw_zero_OI"),
        F.count_if(~F.col("calendar_guard_pass")).alias("n_calendar_rejected"),
    )
    whole = _complete(rows, "source", QUOTE_SOURCES).join(grouped, by, "left").join(spreads, by, "left")
    return whole.na.fill(0, [c for c in whole.columns if c.startswith("n_") or c == "n"])


def missingness(trades: DataFrame, grid) -> DataFrame:
    """Recovery and missing-exit shares by side, type, tercile and month (one pass)."""
    def tercile(coordinate, at, points, labels):
        sizes = [points // 3 + (1 if k < points % 3 else 0) for k in range(3)]
        first, second = at(sizes[0] - 1), at(sizes[0] + sizes[1] - 1)
        c = F.col(coordinate)
        return F.when(c <= first, labels[0]).when(c <= second, labels[1]).otherwise(labels[2])

    dims = {
        "side": N.side_label("net_signal"),
        "option_type": F.col("option_type"),
        "maturity_tercile": tercile("entry_T", grid.t_at, grid.t_points, ("short", "medium", "long")),
        "moneyness_tercile": tercile("entry_log_moneyness", grid.x_at, grid.x_points, ("lower", "central", "upper")),
        "year_month": F.date_format("intended_exit_date", "yyyy-MM"),
    }
    active = trades.where("nonzero_net_position").select("model", "processed_valid", "exit_quote_source", "BASE", *[c.alias(n) for n, c in dims.items()])
    sets = [[F.col("model")]] + [[F.col("model"), F.col(d)] for d in dims]
    recovered = F.col("exit_quote_source") == RECOVERED
    grouped = active.groupingSets(sets, F.col("model"), *[F.col(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("n_active"),
        F.count_if("processed_valid").alias("n_processed"),
        F.count_if(recovered).alias("n_raw_recovered"),
        (100 * F.avg(recovered.cast("double"))).alias("raw_recovery_pct"),
        F.count_if(~F.col("BASE")).alias("n_remaining_missing"),
        (100 * F.avg((~F.col("BASE")).cast("double"))).alias("remaining_missing_pct"),
        (100 * F.avg(F.col("BASE").cast("double"))).alias("BASE_coverage_pct"),
        *[F.grouping(d).alias("_g_" + d) for d in dims],
    )
    dimension, bucket = F.lit("model"), F.col("model")
    for d in dims:
        dimension = F.when(F.col("_g_" + d) == 0, d).otherwise(dimension)
        bucket = F.when(F.col("_g_" + d) == 0, F.col(d)).otherwise(bucket)
    kept = [c for c in grouped.columns if not c.startswith("_g_") and c not in dims]
    return grouped.select(*kept, dimension.alias("dimension"), bucket.alias("bucket"))
