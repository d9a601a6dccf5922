"""Option-market tables derived from the benchmark tables.

The benchmark holds no option quotes, so every registered query reads a quote
table computed from all rows of `lineitem`: each line is one quote, its keys
choose session, contract and liquidity, and an untraded quote of the same
contract at the next session, so every contract that can be entered has an exit. Rates, calendar, surface panel and
forecasts follow from the same rows.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import cleaning, features, scoring
from ..plans.lineage import cut
from ..plans.study import Study
from ..sources.tables import spread
from ..settings import DIVIDEND, RATE_DATE, TENOR_COLUMNS, Grid, Inference, Signals, Splits
from ..settings import Study as Settings

FIRST_DAY = dt.date(2024, 1, 1)
SESSIONS = 60
STRIKES = 51
EXPIRIES = (
    "2024-01-12",
    "2024-02-16",
    "2024-03-15",
    "2024-04-19",
    "2024-05-17",
    "2024-06-21",
    "2024-09-20",
    "2024-12-20",
    "2025-03-21",
)
SPLITS = Splits(train_end=dt.date(2024, 2, 2), fit_end=dt.date(2024, 2, 23), min_train=10, min_validation=5, min_arma_train=10)
RULES = Signals(min_ic_nodes=10)
INFERENCE = Inference()
LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
PANEL_X, PANEL_T = 0.05, 0.1
X_LOW = -0.22
GRID = Grid()


def session_index(day: str):
    n = F.datediff(day, F.lit(FIRST_DAY))
    return F.floor(n / F.lit(7.0)).cast("int") * 5 + n % 7


def session_rates(n) -> dict:
    """Daily tenor rates and dividend yield of the n-th session."""
    out = {c: F.lit(1e-4) + 1e-6 * n + 1e-5 * i for i, c in enumerate(TENOR_COLUMNS)}
    return {**out, DIVIDEND: F.lit(4e-5) + 1e-7 * n}


def true_vol(k, t, day):
    """The volatility surface the quotes are priced from."""
    wave = F.lit(0.02) * F.sin(day * 0.37) + F.lit(0.01) * F.sin(k * 40.0 + t * 9.0 + day * 1.3)
    return F.lit(0.18) + F.lit(0.5) * k * k + F.lit(0.03) * F.sqrt(t) + wave


class Market(Study):
    """The study over one scale-factor folder, with closed-form forecasts and a
    coarse panel so that every stage after them can be stated in SQL as well."""

    bootstrap = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.use(Settings(splits=SPLITS, signals=RULES, inference=INFERENCE))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        """Every line at its session and the next one, with `_contract`: session, expiry, strike and side as one number."""
        d = F.col("l_orderkey") % SESSIONS + F.col("ahead")
        # A remainder of a missing key, or of a negative one, keeps a code of its own.
        expiry = F.coalesce(F.col("l_suppkey") % len(EXPIRIES), F.lit(len(EXPIRIES))) + 10
        strike = F.coalesce(F.col("l_partkey") % STRIKES, F.lit(STRIKES)) + 60
        kind = F.when(F.col("l_orderkey") % 97 == 0, "X").when(F.col("l_linenumber") % 2 == 0, "P").otherwise("C")
        lines = spread(self.table("lineitem").select(*LINE_COLUMNS)).withColumn("ahead", F.explode(F.array(F.lit(0), F.lit(1))))
        return lines.where(d < SESSIONS).withColumns(
            {"d": d, "kind": kind, "_contract": (d * 1000 + expiry * 25) * 1000 + strike * 2 + (kind == "P").cast("long")}
        )

    @cached_property
    def _prices(self) -> DataFrame:
        """What all quotes of one contract and session share: dates, strike, spot and fair price. The keys are remainders,
        so there are at most some 55,000 of them, and none is priced once per quote."""
        days = F.array(*[F.lit(x).cast("date") for x in EXPIRIES])
        expiry = F.col("expiry").cast("int")
        put, d = F.col("put"), F.col("d")
        keys = self._lines.groupBy("_contract").agg(
            F.first("d").alias("d"),
            F.first(F.col("l_suppkey") % len(EXPIRIES)).alias("expiry"),
            F.first(F.col("l_partkey") % STRIKES).alias("strike_no"),
            F.first(F.col("kind") == "P").alias("put"),
        )
        df = keys.select(
            "_contract",
            "d",
            "put",
            F.date_add(F.lit(FIRST_DAY), (7 * F.floor(d / F.lit(5.0)) + d % 5).cast("int")).alias("qd"),
            F.get(days, expiry).alias("xd"),
            F.when(expiry.isin(2, 4, 6), "SPXW").otherwise("SPX").alias("root"),
            (F.lit(75.0) + F.col("strike_no")).alias("strike"),
            (F.lit(100.0) + ((d * 37) % 11) * 0.5).alias("s"),
        )
        df = df.withColumns(
            {
                "t": F.greatest(F.datediff("xd", "qd"), F.lit(1)) / F.lit(365.0),
                "intr": F.when(put, F.greatest(F.col("strike") - F.col("s"), F.lit(0.0))).otherwise(
                    F.greatest(F.col("s") - F.col("strike"), F.lit(0.0))
                ),
                **session_rates(d),
            }
        )
        df = df.withColumns({"r": N.annualised(N.tenor_rate("t")), "y": N.annualised(F.col(f"`{DIVIDEND}`"))})
        df = df.withColumn("vol", true_vol(F.ln(F.col("strike") / F.col("s")), F.col("t"), F.datediff("qd", F.lit(FIRST_DAY))))
        # Stored between the steps, so that the price's long code is generated apart from that of the rest.
        df = cut(df.select("_contract", "d", "put", "qd", "xd", "root", "strike", "s", "intr", "t", "r", "y", "vol"))
        df = N.with_option_price(df, "fair", "s", "strike", "t", "r", "y", "vol", ~put)
        df = cut(df.select("_contract", "d", "qd", "xd", "root", "strike", "s", "intr", "fair"))
        return cut(
            df.select(
                "_contract",
                "d",
                F.date_format("qd", "yyyy-MM-dd").alias("day_first_year"),
                F.date_format("qd", "dd/MM/yyyy").alias("day_first_day"),
                F.date_format("xd", "yyyy-MM-dd").alias("expiration"),
                "root",
                "strike",
                "s",
                "intr",
                "fair",
            )
        )

    @cached_property
    def raw_quotes(self) -> DataFrame:
        """Raw archive layout, dates as text in mixed formats (some unreadable). Not stored: a reader derives the columns
        it needs from the lines, which costs less than writing all columns of all quotes and reading them back."""
        text = (
            F.when((F.col("l_orderkey") % 89 == 0) & (F.col("ahead") == 0), "n/a")
            .when((F.col("l_linenumber") == 3) & (F.col("ahead") == 0), F.col("day_first_day"))
            .otherwise(F.col("day_first_year"))
        )
        # A share of deep in-the-money quotes is priced far below the no-arbitrage bound.
        broken = (F.col("l_tax") > 0.075) & (F.col("intr") > 10.0)
        priced = self._lines.join(F.broadcast(self._prices.drop("d")), "_contract").withColumn(
            "mid0", F.when(broken, 0.5 * F.col("intr")).otherwise(F.col("fair"))
        )
        edge = 1.3 * F.col("l_discount")
        return priced.select(
            F.lit("spx ").alias("underlying_symbol"),
            text.alias("quote_date"),
            "root",
            "expiration",
            "strike",
            F.col("kind").alias("option_type"),
            F.when(F.col("ahead") == 0, F.col("l_quantity").cast("long") - 1).otherwise(F.lit(0)).alias("trade_volume"),
            (F.col("l_partkey") % 29).alias("open_interest"),
            (F.col("mid0") * (1.0 - edge)).alias("bid_1545"),
            (F.col("mid0") * (1.0 + edge)).alias("ask_1545"),
            (F.col("s") - 0.25).alias("underlying_bid_1545"),
            (F.col("s") + 0.25).alias("underlying_ask_1545"),
            (F.col("mid0") * (1.0 - edge)).alias("bid_eod"),
            (F.col("mid0") * (1.0 + edge)).alias("ask_eod"),
        )

    @cached_property
    def clean(self) -> DataFrame:
        """Kept quotes. Nothing is observed on the way, which would make all columns of every raw quote before the filter;
        the funnel counts in a pass of its own, if it is wanted."""
        return cut(cleaning.kept(self.flagged))

    @cached_property
    def funnel(self) -> DataFrame:
        return cleaning.funnel(self.flagged)

    @cached_property
    def sessions(self) -> DataFrame:
        """Distinct quote dates: a calendar, read by many operators."""
        d = F.col("d")
        day = F.date_add(F.lit(FIRST_DAY), (7 * F.floor(d / F.lit(5.0)) + d % 5).cast("int"))
        days = self._prices.select("d").distinct().select(day.alias("session"))
        close = F.make_timestamp_ntz(
            F.year("session"), F.month("session"), F.dayofmonth("session"), F.when(F.datediff("session", F.lit(FIRST_DAY)) % 17 == 9, 13).otherwise(16), F.lit(0), F.lit(0)
        )
        return cut(days.withColumn("close_ts", close))

    @cached_property
    def raw_rates(self) -> DataFrame:
        """Daily rates, absent on some sessions."""
        n = session_index("session")
        tenors = [v.alias(c) for c, v in session_rates(n).items()]
        return self.calendar.where(n % 13 != 5).select(F.col("session").alias(RATE_DATE), *tenors)

    @cached_property
    def gappy_rates(self) -> DataFrame:
        """The same table with holes in every column."""
        n = session_index(RATE_DATE)
        holes = {c: F.when((n + i) % 7 != 3, F.col(f"`{c}`")) for i, c in enumerate(TENOR_COLUMNS)}
        return self.raw_rates.withColumns({**holes, DIVIDEND: F.when(n % 5 != 0, F.col(f"`{DIVIDEND}`"))})

    @cached_property
    def iv_quotes(self) -> DataFrame:
        """Cleaned quotes with the volatility they were priced from. The inversion job
        recovers the same numbers from the prices, in its own queries."""
        vol = true_vol(F.ln("moneyness"), F.col("T"), F.datediff("quote_date", F.lit(FIRST_DAY)))
        # A closed form of three stored columns: its readers compute it, a second copy of all quotes is not written.
        return self.clean.withColumn("implied_vol", vol)

    @cached_property
    def surface(self) -> DataFrame:
        """A coarse observed panel: mean volatility per day and coordinate bucket."""
        xi = F.floor((F.ln("moneyness") - X_LOW) / PANEL_X).cast("int")
        ti = F.floor(F.col("T") / PANEL_T).cast("int")
        cells = self.iv_quotes.select("quote_date", xi.alias("x_idx"), ti.alias("t_idx"), "implied_vol")
        means = cells.groupBy("quote_date", "x_idx", "t_idx").agg(F.avg("implied_vol").alias("iv_grid"))
        return cut(means.select("quote_date", F.format_string("iv_x%02d_t%02d", "x_idx", "t_idx").alias("node"), "x_idx", "t_idx", "iv_grid"))

    @cached_property
    def nodes(self) -> DataFrame:
        cells = self.surface.select("node", "x_idx", "t_idx").distinct()
        return cut(
            cells.select(
                "node",
                F.round(X_LOW + PANEL_X * (F.col("x_idx") + 0.5), 6).alias("log_moneyness"),
                F.round(PANEL_T * (F.col("t_idx") + 0.5), 6).alias("T"),
            )
        )

    @cached_property
    def journal(self) -> DataFrame:
        """Forecasts of four models at every origin. Closed forms of the lag features
        play the model outputs; the fitted models have their own queries."""
        f = self.lagged(1)
        near, week = F.col("lag_1"), F.col("roll_mean_5")
        tilt = F.lit(0.004) * F.sin(F.col("session_no") * 0.9 + F.ascii(F.substring("node", 6, 1)) * 2.1 + F.ascii(F.substring("node", 10, 1)) * 1.7)
        forecasts = f.select(
            F.col("quote_date").alias("forecast_origin_date"),
            F.col("target_date").alias("forecast_target_date"),
            "node",
            near.alias("forecast_persistence"),
            (0.7 * near + 0.3 * week + tilt).alias("forecast_arima"),
            (0.5 * near + 0.3 * F.col("lag_2") + 0.2 * week - 0.5 * tilt).alias("forecast_ridge"),
            (0.2 * near + 0.8 * week + 0.3 * tilt).alias("forecast_xgboost"),
            (0.5 * near + 0.5 * week - tilt).alias("forecast_arima_h2"),
            (0.3 * near + 0.3 * F.col("lag_2") + 0.4 * week + tilt).alias("forecast_ridge_h2"),
            (0.1 * near + 0.9 * week + 0.9 * tilt).alias("forecast_xgboost_h2"),
        )
        out = scoring.attach_outcomes(
            forecasts,
            self.surface,
            {"forecast_origin_date": "observed_iv_at_origin", "forecast_target_date": "actual_iv_at_target"},
        )
        out = out.join(features.regions(self.nodes), "node")
        return cut(scoring.annotate(out))


_markets: dict[tuple[str, str], Market] = {}


def market_for(spark: SparkSession, folder: str) -> Market:
    """One Market per session and folder, so queries share its checkpoints."""
    key = (spark.sparkContext.applicationId, str(folder))
    if key not in _markets:
        _markets[key] = Market(spark, str(folder))
    return _markets[key]
