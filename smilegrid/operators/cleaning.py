"""Rate preparation and the sequential quote-cleaning funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.sizing import small_side
from ..settings import DIVIDEND, RATE_DATE, TENOR_COLUMNS, Cleaning

# --- fixed values: rule names, order and wording of the published funnel ---
FUNNEL = (
    ("basic", "positive book, volume, OI, spot, strike, mid; ask>bid"),
    ("bad_dates", "parseable quote/expiry dates"),
    ("t_window", "14/365 <= T <= 1"),
    ("no_rates", "exact rate-date inner join"),
    ("moneyness", "0.8 <= K/S <= 1.2"),
    ("spread", "relative spread <= 0.2"),
    ("option_type", "C or P"),
    ("lower_bound", "mid + 0.0001 >= discounted European lower bound"),
)
# --- end of fixed values ---


def prepare_rates(rates: DataFrame) -> DataFrame:
    """Fill rate gaps: tenors linear in calendar time, then edges carried outward;
    the dividend yield is carried forward, then backward.

    One row per calendar date, so the unpartitioned window is bounded by the
    length of the calendar and not by the quote volume.
    """
    before = Window.orderBy(RATE_DATE).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy(RATE_DATE).rowsBetween(0, Window.unboundedFollowing)
    day = F.unix_date(RATE_DATE)

    def around(c: str):
        known = F.when(F.col(f"`{c}`").isNotNull(), F.struct(day.alias("t"), F.col(f"`{c}`").alias("v")))
        return F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)

    out = [F.col(RATE_DATE)]
    for c in TENOR_COLUMNS:
        low, high = around(c)
        slope = (high["v"] - low["v"]) / (high["t"] - low["t"])
        inside = low["v"] + slope * (day - low["t"])
        out.append(
            F.coalesce(F.col(f"`{c}`"), F.when(high["t"] > low["t"], inside), low["v"], high["v"]).alias(c)
        )
    low, high = around(DIVIDEND)
    out.append(F.coalesce(low["v"], high["v"]).alias(DIVIDEND))
    return rates.where(F.col(RATE_DATE).isNotNull()).select(*out)


def with_first_failure(quotes: DataFrame, rates: DataFrame, rules: Cleaning = Cleaning()) -> DataFrame:
    """Add the derived quote columns and `first_fail`, the first broken rule or NULL.

    A single pass: the rate table joins on the exact date (broadcast once its
    counted size is small), and every later rule is an ordered CASE branch, so
    the funnel and the kept rows come from the same plan without a cache. Dates
    and what follows from them stay NULL on rows that fail the basic rule.
    """
    rate_days = small_side(rates.withColumn("_has_rate", F.lit(True)))
    df = quotes.withColumns(
        {
            "spot": N.midpoint("underlying_bid_1545", "underlying_ask_1545"),
            "mid": N.midpoint("bid_1545", "ask_1545"),
        }
    )
    df = df.withColumn("_basic", N.holds(passes_basic()))
    # Dates are read only where the first rule holds: most raw quotes fail it.
    df = df.withColumns(
        {c: F.when(F.col("_basic"), X.as_date(quotes, c)) for c in ("quote_date", "expiration")}
    )
    df = df.withColumn("T", N.year_fraction("quote_date", "expiration", rules.days_per_year))
    df = df.join(rate_days, df.quote_date == rate_days[RATE_DATE], "left")
    df = df.withColumns(
        {
            "r_annual": N.annualised(N.tenor_rate("T"), rules.trading_days),
            "q_annual": N.annualised(F.col(f"`{DIVIDEND}`"), rules.trading_days),
            "moneyness": F.col("strike") / F.nullif(F.col("spot"), F.lit(0.0)),
            "option_type": X.label("option_type"),
        }
    )
    return df.withColumn("first_fail", first_failure(rules)).drop("_basic")


def passes_basic() -> Column:
    c = F.col
    return (
        (c("bid_1545") > 0)
        & (c("ask_1545") > 0)
        & (c("ask_1545") > c("bid_1545"))
        & (c("trade_volume") > 0)
        & (c("open_interest") > 0)
        & (c("spot") > 0)
        & (c("strike") > 0)
        & (c("mid") > 0)
    )


def first_failure(rules: Cleaning) -> Column:
    c = F.col
    floor = N.price_floor("spot", "strike", "T", "r_annual", "q_annual", c("option_type") == "C")
    passed = {
        "basic": c("_basic"),
        "bad_dates": c("quote_date").isNotNull() & c("expiration").isNotNull(),
        "t_window": (c("T") >= rules.t_min_days / rules.days_per_year) & (c("T") <= rules.t_max_years),
        "no_rates": c("_has_rate"),
        "moneyness": c("moneyness").between(rules.moneyness_min, rules.moneyness_max),
        "spread": (c("ask_1545") - c("bid_1545")) / c("mid") <= rules.spread_rel_max,
        "option_type": c("option_type").isin("C", "P"),
        "lower_bound": c("mid") + rules.bound_tolerance >= floor,
    }
    out = None
    for name, _ in FUNNEL:
        failed = N.fails(passed[name])
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def kept(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("first_fail").isNull()).drop("first_fail", "_has_rate")


def clean_quotes(quotes: DataFrame, rates: DataFrame, rules: Cleaning = Cleaning()) -> DataFrame:
    return kept(with_first_failure(quotes, rates, rules))


def funnel(flagged: DataFrame) -> DataFrame:
    """Rows before, removed and after each rule (all eight rules, zeros included).

    The only shuffle moves at most nine pre-aggregated counts per task.
    """
    counts = flagged.groupBy("first_fail").agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input"),
        *[
            F.coalesce(F.sum(F.when(F.col("first_fail") == name, F.col("n"))), F.lit(0)).alias(name)
            for name, _ in FUNNEL
        ],
    )
    return _steps(row)


def funnel_of(spark: SparkSession, counters: dict[str, int]) -> DataFrame:
    """The same table from counters that were observed while the quotes were cleaned."""
    values = {"input": counters["input"], **{name: counters["dropped_" + name] for name, _ in FUNNEL}}
    return _steps(spark.range(1).select(*[F.lit(int(v)).cast("long").alias(c) for c, v in values.items()]))


def _steps(row: DataFrame) -> DataFrame:
    """One row per rule from one row of counts."""
    removed_so_far = F.lit(0)
    steps = []
    for position, (name, reason) in enumerate(FUNNEL, 1):
        before = F.col("input") - removed_so_far
        steps.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("step"),
                before.alias("rows_before"),
                F.col(name).alias("rows_removed"),
                (before - F.col(name)).alias("rows_after"),
                F.lit(reason).alias("reason"),
            )
        )
        removed_so_far = removed_so_far + F.col(name)
    return row.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def cleaning_counts(flagged: DataFrame) -> DataFrame:
    """One-row counter table: input, dropped_* and kept_basic."""
    f = F.col("first_fail")
    return flagged.agg(
        F.count(F.lit(1)).alias("input"),
        *[F.count_if(f == name).alias("dropped_" + name) for name, _ in FUNNEL],
        F.count_if(f.isNull()).alias("kept_basic"),
    )


def conservation(counts: DataFrame) -> DataFrame:
    """The two funnel gates, as check rows: input = dropped + kept, no negative count."""
    dropped = sum((F.col("dropped_" + name) for name, _ in FUNNEL), F.lit(0))
    lowest = F.least(*[F.col(c) for c in counts.columns])
    verdict = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    rows = F.array(
        F.struct(
            F.lit("cleaning_funnel_conservation").alias("check_name"),
            verdict(F.col("input") == dropped + F.col("kept_basic")).alias("status"),
            F.col("input").alias("observed"),
            (dropped + F.col("kept_basic")).alias("reference"),
        ),
        F.struct(
            F.lit("cleaning_counts_nonnegative").alias("check_name"),
            verdict(lowest >= 0).alias("status"),
            lowest.alias("observed"),
            F.lit(0).cast("long").alias("reference"),
        ),
    )
    return counts.select(F.explode(rows).alias("c")).select("c.*")
