"""Sources, scalar functions, cleaning, inversion and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.sizing import small_side
from ..operators import checks, cleaning, digests, implied_vol, mapping, quotes, surface
from ..plans.lineage import cut, shared_folder
from ..settings import DIVIDEND, RATE_DATE, TENOR_COLUMNS, Grid
from ..sources import tables
from .inputs import GRID, Market
from .registry import register
from .sql import _KEY, cdf, category, div, normal_p, num, price_sql

# ---------------------------------------------------------------- sources


def _quotes_csv(m: Market) -> str:
    path = shared_folder(m.spark, "quotes-csv")
    m.raw_quotes.write.option("header", True).csv(path)
    return path


def _csv_scan(m: Market):
    df = tables.read_quotes_csv(m.spark, _quotes_csv(m))
    return df.groupBy("root", "option_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("trade_volume").alias("volume"),
        F.sum("bid_1545").alias("bid_sum"),
        F.count_if(F.col("quote_date") == "n/a").alias("unreadable"),
    )


register(
    "csv_quote_scan",
    _csv_scan,
    "root option_type n volume unreadable",
    "bid_sum",
    "SELECT root, option_type, count(*) AS n, CAST(sum(trade_volume) AS BIGINT) AS volume, sum(bid_1545) AS bid_sum, count(*) FILTER (quote_date='n/a') AS unreadable FROM raw_quotes GROUP BY ALL",
    4,
)
register(
    "csv_row_count",
    lambda m: tables.csv_row_count(m.spark, _quotes_csv(m)),
    "rows",
    "",
    "SELECT count(*) AS rows FROM raw_quotes",
)


def _rates_file(m: Market):
    path = shared_folder(m.spark, "rates-csv")
    text = m.gappy_rates.select(
        F.date_format(RATE_DATE, "dd/MM/yyyy").alias(f" {RATE_DATE}"),
        *[F.col(f"`{c}`").cast("string").alias(f"{c} ") for c in (DIVIDEND, *TENOR_COLUMNS)],
    )
    text.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    filled = cleaning.prepare_rates(tables.read_rates_csv(m.spark, path))
    return filled.select(
        F.col(f"`{RATE_DATE}`").alias("day"),
        F.col(f"`{DIVIDEND}`").alias("dividend"),
        *[F.col(f"`{c}`").alias("rate_" + c.lower()) for c in TENOR_COLUMNS],
    )


_RATES_SQL = f'SELECT "{RATE_DATE}" AS day, "{DIVIDEND}" AS dividend, ' + ", ".join(f'"{c}" AS rate_{c.lower()}' for c in TENOR_COLUMNS) + " FROM filled_rates"
register("rate_table_load_and_fill", _rates_file, "day", "dividend " + " ".join("rate_" + c.lower() for c in TENOR_COLUMNS), _RATES_SQL, 10)


def _parquet_round_trip(m: Market):
    path = shared_folder(m.spark, "clean-parquet")
    tables.write_table(m.clean.drop("_has_rate"), path, sort=("quote_date", "strike"))
    df = tables.read_table(m.spark, path, ["quote_date", "option_type", "mid"])
    return df.groupBy("quote_date", "option_type").agg(F.count(F.lit(1)).alias("n"), F.sum("mid").alias("mid_sum"))


register(
    "parquet_sink_and_scan",
    _parquet_round_trip,
    "quote_date option_type n",
    "mid_sum",
    "SELECT quote_date, option_type, count(*) AS n, sum(mid) AS mid_sum FROM clean GROUP BY ALL",
)


def _dated_read(m: Market):
    path = shared_folder(m.spark, "market-by-date")
    tables.write_by_date(m.market, path)
    dates = m.required.select("intended_exit_date").distinct()
    df = tables.read_dates(m.spark, path, dates)
    return df.groupBy("quote_date").agg(F.count(F.lit(1)).alias("n"), F.sum("bid").alias("bid_sum"))


register(
    "date_partition_read",
    _dated_read,
    "quote_date n",
    "bid_sum",
    "SELECT quote_date, count(*) AS n, sum(bid) AS bid_sum FROM market WHERE quote_date IN (SELECT intended_exit_date FROM required) GROUP BY ALL",
)


def _report_round_trip(m: Market):
    folder = shared_folder(m.spark, "report")
    tables.write_report(cleaning.funnel(m.flagged), folder + "/funnel", "csv", ["position"])
    tables.write_report(cleaning.cleaning_counts(m.flagged), folder + "/counts", "json")
    counts = m.spark.read.json(folder + "/counts")
    steps = m.spark.read.option("header", True).csv(folder + "/funnel")
    total = steps.agg(F.sum(F.col("rows_removed").cast("long")).alias("removed"))
    both = counts.select(F.col("input").alias("n"), F.lit("input").alias("what")).unionByName(
        counts.select(F.col("kept_basic").alias("n"), F.lit("kept").alias("what"))
    )
    return both.unionByName(total.select(F.col("removed").alias("n"), F.lit("removed").alias("what")))


register(
    "report_sinks",
    _report_round_trip,
    "what n",
    "",
    "SELECT 'input' AS what, count(*) AS n FROM flagged UNION ALL SELECT 'kept', count(*) FROM clean UNION ALL SELECT 'removed', count(first_fail) FROM flagged",
)


def _range_diff(m: Market):
    """Orders against a copy with changed prices, missing customers, and orders that only one side has."""
    orders = m.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    moved = orders.where("o_orderkey % 211 <> 5").withColumns(
        {
            "o_totalprice": F.when(F.col("o_orderkey") % 97 == 3, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice")),
            "o_custkey": F.when(F.col("o_orderkey") % 89 != 1, F.col("o_custkey")),
        }
    )
    return digests.range_diff(moved, orders.where("o_orderkey % 223 <> 6"), ["o_orderkey"])


register(
    "table_range_diff",
    _range_diff,
    "result_name status",
    "reference_value new_value absolute_difference",
    """WITH e AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS ec, o_totalprice AS ep, true AS he FROM orders WHERE o_orderkey%223<>6),
 n AS (SELECT o_orderkey, CASE WHEN o_orderkey%89<>1 THEN CAST(o_custkey AS DOUBLE) END AS nc, CASE WHEN o_orderkey%97=3 THEN o_totalprice+0.5 ELSE o_totalprice END AS np, true AS hn
 FROM orders WHERE o_orderkey%211<>5),
 b AS (SELECT * FROM e FULL JOIN n USING (o_orderkey)),
 pairs AS (SELECT 'o_custkey' AS c, o_orderkey AS k, he, hn, ec AS r, nc AS v FROM b UNION ALL SELECT 'o_totalprice', o_orderkey, he, hn, ep, np FROM b),
 cells AS (SELECT c||'[o_orderkey='||k||']' AS result_name, r AS reference_value, v AS new_value,
  CASE WHEN he IS NULL OR hn IS NULL THEN 'Infinity'::DOUBLE WHEN r IS NULL AND v IS NULL THEN 0 WHEN r IS NULL OR v IS NULL THEN 'Infinity'::DOUBLE ELSE abs(v-r) END AS absolute_difference FROM pairs)
 SELECT result_name, reference_value, new_value, absolute_difference, 'FAIL' AS status FROM cells WHERE absolute_difference>1e-10
 UNION ALL SELECT 'row_keys', count(he), count(hn), count(*) FILTER (he IS NULL OR hn IS NULL), CASE WHEN count(*) FILTER (he IS NULL OR hn IS NULL)=0 THEN 'PASS' ELSE 'FAIL' END FROM b
 UNION ALL SELECT 'cells', count(*), count(*) FILTER (absolute_difference<=1e-10), count(*) FILTER (absolute_difference>1e-10), CASE WHEN count(*) FILTER (absolute_difference>1e-10)=0 THEN 'PASS' ELSE 'FAIL' END FROM cells""",
)


def _expected_diff(m: Market):
    folder = shared_folder(m.spark, "expected")
    table = m.daily.select("model", "entry_date", "PnL_mid", "Return_mid", "number_contracts")
    moved = table.withColumn("PnL_mid", F.when(F.dayofmonth("entry_date") == 9, F.col("PnL_mid") + 1.0).otherwise(F.col("PnL_mid")))
    tables.write_report(table, folder + "/expected")
    tables.write_report(moved, folder + "/actual")
    expected, actual = tables.expected_tables(m.spark, folder + "/expected", folder + "/actual")
    typed = lambda df: df.select("model", "entry_date", *[N.number(c).alias(c) for c in ("PnL_mid", "Return_mid", "number_contracts")])
    diff = checks.table_diff(typed(actual), typed(expected), ["model", "entry_date"])
    kind = F.substring_index("result_name", "[", 1)
    return diff.groupBy(kind.alias("column_name"), "status").agg(F.count(F.lit(1)).alias("n"), F.max("absolute_difference").alias("largest"))


register(
    "expected_table_diff",
    _expected_diff,
    "column_name status n",
    "largest",
    """SELECT 'row_keys' AS column_name, 'PASS' AS status, 1 AS n, 0e0 AS largest
UNION ALL SELECT 'PnL_mid', CASE WHEN day(entry_date)=9 THEN 'FAIL' ELSE 'PASS' END, count(*), max(CASE WHEN day(entry_date)=9 THEN 1e0 ELSE 0e0 END) FROM daily GROUP BY 1,2
UNION ALL SELECT 'Return_mid', 'PASS', count(*), 0e0 FROM daily UNION ALL SELECT 'number_contracts', 'PASS', count(*), 0e0 FROM daily""",
)

# ---------------------------------------------------------------- scalar functions

register(
    "lenient_dates",
    # A text is parsed once, not once per quote that bears it.
    lambda m: m.raw_quotes.groupBy("quote_date")
    .agg(F.count(F.lit(1)).alias("n"))
    .withColumns({"parsed": X.lenient_date("quote_date"), "iso": X.iso_date("quote_date")}),
    "quote_date parsed iso n",
    "",
    """SELECT quote_date, CAST(coalesce(try_strptime(quote_date,'%Y-%m-%d'),try_strptime(quote_date,'%d/%m/%Y')) AS DATE) AS parsed,
 CAST(try_strptime(quote_date,'%Y-%m-%d') AS DATE) AS iso, count(*) AS n FROM raw_quotes GROUP BY ALL""",
)


def _coerced(m: Market):
    text = F.when(F.col("l_linenumber") == 5, F.lit("bad")).otherwise(F.col("l_tax").cast("string"))
    df = m.table("lineitem").select("l_returnflag", N.number(text).alias("v"))
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_numeric"), F.sum("v").alias("total"))


register(
    "numeric_coercion",
    _coerced,
    "l_returnflag n n_numeric",
    "total",
    "SELECT l_returnflag, count(*) AS n, count(v) AS n_numeric, sum(v) AS total FROM (SELECT l_returnflag, TRY_CAST(CASE WHEN l_linenumber=5 THEN 'bad' ELSE CAST(l_tax AS VARCHAR) END AS DOUBLE) AS v FROM lineitem) GROUP BY 1",
)


def _identity(m: Market):
    df = quotes.normalise_raw(m.raw_quotes)
    return df.groupBy("contract_key").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("lowest_mid"), F.max("spot").alias("highest_spot"))


register(
    "contract_identity",
    _identity,
    "contract_key n",
    "lowest_mid highest_spot",
    "SELECT contract_key, count(*) AS n, min(mid) AS lowest_mid, max(spot) AS highest_spot FROM raw_typed GROUP BY 1",
)


def _half_even(m: Market):
    # An odd number over two million has its seventh decimal on a half.
    strike = (2 * F.col("l_partkey") + 1) / F.lit(2e6)
    key = X.contract_key(F.lit(" spx"), F.col("l_returnflag"), F.to_date("l_shipdate"), strike, F.lit("call"))
    return m.table("lineitem").select(key.alias("contract_key")).groupBy("contract_key").agg(F.count(F.lit(1)).alias("n"))


register(
    "half_even_contract_keys",
    _half_even,
    "contract_key n",
    "",
    """SELECT 'SPX|'||l_returnflag||'|'||strftime(l_shipdate,'%Y-%m-%d')||'|'||printf('%.6f',round_even((2*l_partkey+1)/2e6*1e6,0)/1e6)||'|C' AS contract_key, count(*) AS n FROM lineitem GROUP BY 1""",
)


def _maturity(m: Market):
    return m.clean.groupBy("quote_date", "expiration").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("T").alias("t"),
        F.min("r_annual").alias("r"),
        F.min("q_annual").alias("q"),
        F.max("moneyness").alias("k_over_s"),
        F.max(N.log_moneyness("moneyness")).alias("x"),
    )


register(
    "maturity_rates_and_moneyness",
    _maturity,
    "quote_date expiration n",
    "t r q k_over_s x",
    "SELECT quote_date, expiration, count(*) AS n, min(T) AS t, min(r_annual) AS r, min(q_annual) AS q, max(moneyness) AS k_over_s, max(ln(moneyness)) AS x FROM clean GROUP BY ALL",
    9,
)


def _bounds(m: Market):
    floor = N.price_floor("spot", "strike", "T", "r_annual", "q_annual", F.col("option_type") == "C")
    return m.clean.withColumn("floor", floor).groupBy("quote_date", "option_type").agg(
        F.avg("floor").alias("mean_floor"), F.min(F.col("mid") - F.col("floor")).alias("least_slack")
    )


register(
    "price_lower_bounds",
    _bounds,
    "quote_date option_type",
    "mean_floor least_slack",
    """SELECT quote_date, option_type, avg(f) AS mean_floor, min(mid-f) AS least_slack FROM (SELECT *, greatest(0e0, CASE WHEN option_type='C'
 THEN spot*exp(-q_annual*T)-strike*exp(-r_annual*T) ELSE strike*exp(-r_annual*T)-spot*exp(-q_annual*T) END) AS f FROM clean) GROUP BY ALL""",
)


def _normal(m: Market):
    z = m.table("lineitem").select(((F.col("l_extendedprice") - 50000.0) / 6000.0).alias("z"), "l_linestatus")
    z = z.withColumns({"c": N.norm_cdf("z"), "d": N.norm_pdf("z")})
    return z.groupBy("l_linestatus").agg(F.sum("c").alias("cdf_sum"), F.sum("d").alias("pdf_sum"), F.max("c").alias("cdf_max"), F.min("c").alias("cdf_min"))


register(
    "normal_distribution",
    _normal,
    "l_linestatus",
    "cdf_sum pdf_sum cdf_max cdf_min",
    f"""SELECT l_linestatus, sum({cdf('z')}) AS cdf_sum, sum(exp(-z*z/2)/sqrt(2*pi())) AS pdf_sum, max({cdf('z')}) AS cdf_max, min({cdf('z')}) AS cdf_min
 FROM (SELECT l_linestatus, (l_extendedprice-50000e0)/6000e0 AS z FROM lineitem) GROUP BY 1""",
)


def _priced(m: Market):
    inputs = ("spot", "strike", "T", "r_annual", "q_annual", "implied_vol")
    call = F.col("option_type") == "C"
    df = N.with_option_price(m.iv_quotes, "fair", *inputs, call)
    df = N.with_greeks(df, "g_", *inputs, call)
    return df.groupBy("quote_date", "option_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("fair").alias("fair_sum"),
        F.max(F.abs(F.col("fair") - F.col("mid"))).alias("worst_gap"),
        *[F.sum(f"g_{g}").alias(f"sum_{g.lower()}") for g in ("Delta", "Gamma", "Vega", "Theta")],
    )


_PDF = "(exp(-d1*d1/2)/sqrt(2*pi()))"
_GREEK_ROWS = f"""SELECT *, sg*carry*{cdf('(sg*d1)')} AS delta, carry*{_PDF}/(spot*v*sqrt(T)) AS gamma, spot*carry*{_PDF}*sqrt(T) AS vega,
 -spot*carry*{_PDF}*v/(2*sqrt(T))+sg*(q_annual*spot*carry*{cdf('(sg*d1)')}-r_annual*strike*exp(-r_annual*T)*{cdf('(sg*(d1-v*sqrt(T)))')}) AS theta,
 {price_sql('spot', 'T', 'r_annual', 'q_annual', 'v', 'strike', 'sg')} AS fair
 FROM (SELECT *, (ln(spot/strike)+(r_annual-q_annual+v*v*0.5e0)*T)/(v*sqrt(T)) AS d1 FROM (SELECT *, implied_vol AS v, exp(-q_annual*T) AS carry, CASE WHEN option_type='C' THEN 1e0 ELSE -1e0 END AS sg FROM iv_quotes))"""
register(
    "option_prices_and_greeks",
    _priced,
    "quote_date option_type n",
    "fair_sum worst_gap sum_delta sum_gamma sum_vega sum_theta",
    f"""SELECT quote_date, option_type, count(*) AS n, sum(fair) AS fair_sum, max(abs(fair-mid)) AS worst_gap, sum(delta) AS sum_delta, sum(gamma) AS sum_gamma, sum(vega) AS sum_vega, sum(theta) AS sum_theta
 FROM ({_GREEK_ROWS}) GROUP BY ALL""",
)


def _reasons(m: Market):
    df = quotes.normalise_raw(m.raw_quotes)
    rate_days = m.rates.select(F.col(RATE_DATE).alias("quote_date"), F.lit(True).alias("_rate"))
    df = df.join(small_side(rate_days), "quote_date", "left")
    df = df.withColumn("t", N.year_fraction("quote_date", "expiration"))
    flags = X.quote_failures("bid_1545", "ask_1545", "trade_volume", "open_interest", "spot", "strike", "t", "option_type", F.col("_rate"), cleaning.Cleaning())
    df = df.select(flags.alias("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("category", X.reason_category("reasons"))


def _rules_text() -> str:
    from .sql import _RULES, FAILURE_RULES, NO_FAILURE

    names = ", ".join(f"CASE WHEN NOT coalesce({r},false) THEN '{n}' END" for n, r in zip(FAILURE_RULES, _RULES))
    return f"coalesce(nullif(concat_ws(';', {names}),''),'{NO_FAILURE}')"


register(
    "failure_reasons",
    _reasons,
    "reasons category n",
    "",
    f"SELECT *, {category('reasons')} AS category FROM (SELECT {_rules_text()} AS reasons, count(*) AS n FROM raw_typed GROUP BY 1)",
)
register(
    "book_predicates",
    lambda m: m.raw_quotes.select(
        "root",
        N.two_sided("bid_1545", "ask_1545").alias("valid"),
        N.relative_spread("bid_1545", "ask_1545").alias("spread"),
    )
    .groupBy("root", "valid")
    .agg(F.count(F.lit(1)).alias("n"), F.avg("spread").alias("mean_spread")),
    "root valid n",
    "mean_spread",
    f"SELECT root, bid_1545>0 AND ask_1545>=bid_1545 AS valid, count(*) AS n, avg({div('ask_1545-bid_1545', '(bid_1545+ask_1545)/2')}) AS mean_spread FROM raw_quotes GROUP BY ALL",
)

# ---------------------------------------------------------------- cleaning

register(
    "cleaning_funnel",
    lambda m: cleaning.funnel(m.flagged),
    "position step rows_before rows_removed rows_after",
    "",
    """SELECT position, step, total-before AS rows_before, removed AS rows_removed, total-before-removed AS rows_after FROM (
 SELECT p.position, p.step, t.total, coalesce(c.n,0) AS removed, CAST(coalesce(sum(coalesce(c.n,0)) OVER (ORDER BY p.position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS before
 FROM (VALUES (1,'basic'),(2,'bad_dates'),(3,'t_window'),(4,'no_rates'),(5,'moneyness'),(6,'spread'),(7,'option_type'),(8,'lower_bound')) p(position,step)
 CROSS JOIN (SELECT count(*) AS total FROM flagged) t LEFT JOIN (SELECT first_fail, count(*) AS n FROM flagged GROUP BY 1) c ON c.first_fail=p.step)""",
)
register(
    "cleaning_conservation",
    lambda m: cleaning.conservation(cleaning.cleaning_counts(m.flagged)),
    "check_name status observed reference",
    "",
    """SELECT 'cleaning_funnel_conservation' AS check_name, 'PASS' AS status, count(*) AS observed, count(*) AS reference FROM flagged
 UNION ALL SELECT 'cleaning_counts_nonnegative', 'PASS', least(min(n),(SELECT count(*) FROM clean)), 0 FROM (SELECT count(*) AS n FROM flagged WHERE first_fail IS NOT NULL GROUP BY first_fail)""",
)
register(
    "clean_quotes",
    lambda m: m.clean,
    "quote_date expiration root option_type trade_volume open_interest",
    "strike bid_1545 ask_1545 spot mid T moneyness r_annual q_annual",
    "clean",
)
register(
    "processed_market",
    lambda m: m.market,
    "quote_date contract_key underlying_symbol root expiration option_type source_observation_count",
    "strike bid ask mid spot moneyness log_moneyness T implied_vol r q trade_volume open_interest",
    "market",
)
register(
    "valid_market",
    lambda m: mapping.valid_market(m.market).groupBy("quote_date", "option_type").agg(F.count(F.lit(1)).alias("n"), F.sum("mid").alias("mid_sum")),
    "quote_date option_type n",
    "mid_sum",
    "SELECT quote_date, option_type, count(*) AS n, sum(mid) AS mid_sum FROM valid_market GROUP BY ALL",
)

# ---------------------------------------------------------------- inversion


def _attempted(m: Market):
    floor = N.price_floor("spot", "strike", "T", "r_annual", "q_annual", F.col("option_type") == "C")
    df = m.flagged.where("quote_date IS NOT NULL AND _has_rate").withColumn("above", F.col("mid") - floor)
    df = df.withColumn(
        "region",
        F.when(F.col("T") <= 0, "expired").when(F.col("above") > 1e-8, "time_value").when(F.col("above") < -1e-8, "below_bound").otherwise("at_bound"),
    )
    return df.where("region <> 'at_bound'")


_ABOVE = "mid-greatest(0e0, CASE WHEN option_type='C' THEN spot*exp(-q_annual*T)-strike*exp(-r_annual*T) ELSE strike*exp(-r_annual*T)-spot*exp(-q_annual*T) END)"
_CEILING = price_sql("spot", "greatest(T,1e-3)", "r_annual", "q_annual", "5e0")
_REGION = f"CASE WHEN T<=0 THEN 'expired' WHEN {_ABOVE}>1e-8 THEN 'time_value' WHEN {_ABOVE}<-1e-8 THEN 'below_bound' ELSE 'at_bound' END"
register(
    "iv_inversion_status",
    lambda m: implied_vol.invert(_attempted(m)).groupBy("region", "iv_status").agg(F.count(F.lit(1)).alias("n")),
    "region iv_status n",
    "",
    f"""SELECT region, iv_status, count(*) AS n FROM (SELECT {_REGION} AS region, CASE WHEN T>0 AND {_ABOVE}>0 AND mid<={_CEILING} THEN 'VALID_IV' ELSE 'SOLVER_FAILURE' END AS iv_status
 FROM flagged WHERE coalesce(first_fail,'')<>'basic' AND quote_date IS NOT NULL AND has_rate) WHERE region<>'at_bound' GROUP BY ALL""",
)


def _inverted(m: Market):
    return implied_vol.invert(m.clean)


def _reprice(m: Market):
    df = N.with_option_price(
        _inverted(m), "again", "spot", "strike", "T", "r_annual", "q_annual", "implied_vol", F.col("option_type") == "C"
    )
    df = N.with_greeks(df, "g_", "spot", "strike", "T", "r_annual", "q_annual", "implied_vol", F.col("option_type") == "C")
    return df.groupBy("quote_date").agg(
        F.count_if(F.col("g_Vega") > 0.01).alias("n_sensitive"),
        F.count_if((F.col("g_Vega") > 0.01) & (F.abs(F.col("again") - F.col("mid")) < 1e-9 * F.col("spot"))).alias("n_repriced"),
        F.avg(F.when(F.col("g_Vega") > 0.01, F.col("implied_vol"))).alias("mean_vol"),
    )


register(
    "iv_inversion_round_trip",
    _reprice,
    "quote_date n_sensitive n_repriced",
    "mean_vol",
    f"SELECT quote_date, count(*) FILTER (vega>0.01e0) AS n_sensitive, count(*) FILTER (vega>0.01e0) AS n_repriced, avg(implied_vol) FILTER (vega>0.01e0) AS mean_vol FROM ({_GREEK_ROWS}) GROUP BY 1",
)
def _counts(m: Market):
    # Stored once, as both the inversion and its count of inputs read it; derived quote columns are what the solver needs.
    inputs = ("quote_date", "expiration", "option_type", "mid", "spot", "strike", "r_annual", "q_annual")
    attempted = cut(_attempted(m).where("region = 'time_value'").select(*inputs))
    return implied_vol.inversion_counts(implied_vol.invert(attempted), attempted)


register(
    "iv_inversion_counts",
    _counts,
    "input valid solver_failure invalid_input",
    "",
    f"SELECT count(*) AS input, count(*) FILTER (mid<={_CEILING}) AS valid, count(*) FILTER (mid>{_CEILING}) AS solver_failure, 0 AS invalid_input FROM flagged WHERE coalesce(first_fail,'')<>'basic' AND quote_date IS NOT NULL AND has_rate AND {_REGION}='time_value'",
)

# ---------------------------------------------------------------- surface

_XS = f"(SELECT i, CASE WHEN i=24 THEN 0.18e0 ELSE -0.22e0+i*{num((0.18 - -0.22) / 24)} END AS x FROM (SELECT unnest(range(25)) AS i))"
_TS = f"(SELECT j, CASE WHEN j=19 THEN 1e0 ELSE 0.08e0+j*{num((1.0 - 0.08) / 19)} END AS t FROM (SELECT unnest(range(20)) AS j))"
_POINTS = "SELECT quote_date, ln(moneyness) AS x, T AS t, implied_vol AS iv FROM iv_quotes WHERE ln(moneyness) BETWEEN -0.22e0 AND 0.18e0 AND T BETWEEN 0.08e0 AND 1e0"
_LOCATIONS = f"SELECT quote_date, x, t, median(iv) AS iv, count(*) AS n FROM ({_POINTS}) GROUP BY ALL"
_DAYS = f"SELECT quote_date, sum(n) AS n_obs_raw, count(*) AS n_obs_unique FROM ({_LOCATIONS}) GROUP BY 1"
_SLICES = f"""SELECT quote_date, t, i, CASE WHEN lo=hi THEN lov ELSE lov+(hiv-lov)*((x-lo)/(hi-lo)) END AS v FROM (
 SELECT p.quote_date, p.t, g.i, g.x, max(p.x) FILTER (p.x<=g.x) AS lo, arg_max(p.iv,p.x) FILTER (p.x<=g.x) AS lov, min(p.x) FILTER (p.x>=g.x) AS hi, arg_min(p.iv,p.x) FILTER (p.x>=g.x) AS hiv
 FROM ({_LOCATIONS}) p JOIN (SELECT quote_date FROM ({_DAYS}) WHERE n_obs_unique>=10) d USING (quote_date) CROSS JOIN {_XS} g GROUP BY ALL) WHERE lo IS NOT NULL AND hi IS NOT NULL"""
SEPARABLE = f"""SELECT quote_date, i, j, CASE WHEN lo=hi THEN lov ELSE lov+(hiv-lov)*((t-lo)/(hi-lo)) END AS iv_grid FROM (
 SELECT s.quote_date, s.i, g.j, g.t, max(s.t) FILTER (s.t<=g.t) AS lo, arg_max(s.v,s.t) FILTER (s.t<=g.t) AS lov, min(s.t) FILTER (s.t>=g.t) AS hi, arg_min(s.v,s.t) FILTER (s.t>=g.t) AS hiv
 FROM ({_SLICES}) s CROSS JOIN {_TS} g GROUP BY ALL) WHERE lo IS NOT NULL AND hi IS NOT NULL"""
SURFACE_NODES = f"""SELECT d.quote_date, printf('iv_x%02d_t%02d',x.i,t.j) AS node, x.i AS x_idx, t.j AS t_idx, x.x AS log_moneyness, t.t AS T, s.iv_grid
 FROM (SELECT quote_date FROM ({_DAYS}) WHERE n_obs_unique>=10) d CROSS JOIN {_XS} x CROSS JOIN {_TS} t LEFT JOIN ({SEPARABLE}) s ON s.quote_date=d.quote_date AND s.i=x.i AND s.j=t.j"""


def _points(m: Market):
    return surface.surface_points(m.iv_quotes)


def _nodes(m: Market):
    return surface.build_surface(m.locations)


register(
    "surface_grid",
    lambda m: surface.on_every_node(_nodes(m), m.iv_quotes.select("quote_date").distinct()).groupBy("node", "x_idx", "t_idx").agg(
        F.max("log_moneyness").alias("log_moneyness"), F.max("T").alias("T"), F.count(F.lit(1)).alias("days")
    ),
    "node x_idx t_idx days",
    "log_moneyness T",
    f"SELECT printf('iv_x%02d_t%02d',i,j) AS node, i AS x_idx, j AS t_idx, x AS log_moneyness, t AS T, (SELECT count(DISTINCT quote_date) FROM iv_quotes) AS days FROM {_XS} CROSS JOIN {_TS}",
    9,
)
register(
    "surface_points",
    lambda m: surface.surface_points(m.iv_quotes.drop("moneyness", "T"))
    .groupBy("quote_date")
    .agg(F.count(F.lit(1)).alias("n"), F.avg("implied_vol").alias("iv"), F.min("log_moneyness").alias("x"), F.max("T").alias("t")),
    "quote_date n",
    "iv x t",
    f"SELECT quote_date, count(*) AS n, avg(iv) AS iv, min(x) AS x, max(t) AS t FROM ({_POINTS}) GROUP BY 1",
)
register(
    "location_medians",
    lambda m: surface.unique_locations(_points(m)),
    "quote_date n_quotes",
    "log_moneyness T implied_vol",
    f"SELECT quote_date, x AS log_moneyness, t AS T, iv AS implied_vol, n AS n_quotes FROM ({_LOCATIONS})",
    8,
)
register("separable_surface", _nodes, "quote_date node x_idx t_idx", "log_moneyness T iv_grid", SURFACE_NODES)
register(
    "surface_from_raw_quotes",
    lambda m: surface.build_surface(cut(surface.unique_locations(cut(surface.surface_points(_inverted(m)))))),
    "quote_date node",
    "iv_grid",
    SURFACE_NODES,
)
register(
    "surface_day_stats",
    lambda m: surface.day_stats(m.locations, _nodes(m)),
    "quote_date n_obs_raw n_obs_unique status interp_used",
    "coverage",
    f"""SELECT d.quote_date, CAST(n_obs_raw AS BIGINT) AS n_obs_raw, n_obs_unique, CASE WHEN n_obs_unique>=10 THEN 'kept' ELSE 'skipped_min_points' END AS status,
 CASE WHEN n_obs_unique>=10 THEN 'separable' ELSE '' END AS interp_used, coalesce(c.n,0)/500e0 AS coverage
 FROM ({_DAYS}) d LEFT JOIN (SELECT quote_date, count(*) AS n FROM ({SEPARABLE}) GROUP BY 1) c USING (quote_date)""",
)
register(
    "surface_summary",
    lambda m: surface.surface_summary(_nodes(m)),
    "grid_dates grid_nodes potential_grid_observations non_missing_grid_observations first_date last_date",
    "coverage_mean coverage_median coverage_min coverage_max",
    f"""SELECT count(*) AS grid_dates, max(c) AS grid_nodes, CAST(sum(c) AS BIGINT) AS potential_grid_observations, CAST(sum(o) AS BIGINT) AS non_missing_grid_observations, min(quote_date) AS first_date,
 max(quote_date) AS last_date, avg(o/c) AS coverage_mean, median(o/c) AS coverage_median, min(o/c) AS coverage_min, max(o/c) AS coverage_max
 FROM (SELECT quote_date, count(*) AS c, count(iv_grid) AS o FROM ({SURFACE_NODES}) GROUP BY 1)""",
)


def _filled(m: Market):
    return surface.build_surface(m.locations, fill=True)


register(
    "surface_nearest_fill",
    _filled,
    "quote_date node",
    "iv_grid",
    f"""SELECT n.quote_date, n.node, coalesce(n.iv_grid, f.iv) AS iv_grid FROM ({SURFACE_NODES}) n LEFT JOIN (
 SELECT quote_date, node, arg_min(iv, {{'d': d, 'x': x, 't': t}}) AS iv FROM (SELECT h.quote_date, h.node, l.iv, l.x, l.t, sqrt(pow(l.x-h.log_moneyness,2e0)+pow(l.t-h.T,2e0)) AS d
  FROM ({SURFACE_NODES}) h JOIN ({_LOCATIONS}) l USING (quote_date) WHERE h.iv_grid IS NULL) GROUP BY 1,2) f ON f.quote_date=n.quote_date AND f.node=n.node""",
)


def _weights(sigma: float) -> str:
    import math

    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return "(VALUES " + ", ".join(f"({k},{num(w / sum(raw))})" for k, w in zip(range(-r, r + 1), raw)) + ") w(k,w)"


def _mirror(i: str, n: int) -> str:
    return f"(CASE WHEN (({i})%{2 * n}+{2 * n})%{2 * n}<{n} THEN (({i})%{2 * n}+{2 * n})%{2 * n} ELSE {2 * n - 1}-(({i})%{2 * n}+{2 * n})%{2 * n} END)"


register(
    "surface_smoothing",
    lambda m: surface.build_surface(m.locations, sigma=1.0),
    "quote_date node",
    "iv_grid",
    f"""SELECT c.quote_date, printf('iv_x%02d_t%02d',c.i,c.j) AS node, CASE WHEN sum(a.w*b.w*m.m)>=1e-6 THEN sum(a.w*b.w*m.v)/sum(a.w*b.w*m.m) END AS iv_grid
 FROM (SELECT quote_date, x_idx AS i, t_idx AS j FROM ({SURFACE_NODES})) c CROSS JOIN {_weights(1.0).replace('w(k,w)', 'a(k,w)')} CROSS JOIN {_weights(1.0).replace('w(k,w)', 'b(k,w)')}
 JOIN (SELECT quote_date, x_idx, t_idx, coalesce(iv_grid,0e0) AS v, CASE WHEN iv_grid IS NULL THEN 0e0 ELSE 1e0 END AS m FROM ({SURFACE_NODES})) m
  ON m.quote_date=c.quote_date AND m.x_idx={_mirror('c.i+a.k', 25)} AND m.t_idx={_mirror('c.j+b.k', 20)} GROUP BY c.quote_date, c.i, c.j""",
)


def _wide_long(m: Market):
    names = [f"iv_x{x:02d}_t{t:02d}" for t in range(GRID.t_points) for x in range(GRID.x_points)]
    wide = surface.to_wide(_nodes(m), names)
    return surface.to_long(wide, names).groupBy("node").agg(
        F.count(F.lit(1)).alias("days"), F.count("iv_grid").alias("observed"), F.sum("iv_grid").alias("total")
    )


register(
    "surface_pivot_round_trip",
    _wide_long,
    "node days observed",
    "total",
    f"SELECT node, count(*) AS days, count(iv_grid) AS observed, sum(iv_grid) AS total FROM ({SURFACE_NODES}) GROUP BY 1",
)


def _partly_identified(m: Market):
    """Quotes of which some lack a symbol, a root or a strike."""
    gap = lambda c, n: F.when(F.col("open_interest") % n != 0, F.col(c)).alias(c)
    rest = [c for c in m.iv_quotes.columns if c not in ("underlying_symbol", "root", "strike")]
    quotes = m.iv_quotes.select(*rest, gap("underlying_symbol", 5), gap("root", 7), gap("strike", 11))
    found = mapping.identified(quotes).groupBy("quote_date").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count_if(F.col("contract_key").isNull()).alias("n_unkeyed"),
        F.countDistinct("contract_key").alias("n_contracts"),
    )
    kept = mapping.market_day(mapping.normalise_market(quotes)).groupBy("quote_date").agg(F.sum("source_observation_count").alias("n_used"))
    return found.join(kept, "quote_date")


register(
    "quotes_without_identity",
    _partly_identified,
    "quote_date n_quotes n_unkeyed n_contracts n_used",
    "",
    f"""SELECT quote_date, count(*) AS n_quotes, count(*) FILTER (gap) AS n_unkeyed, count(DISTINCT CASE WHEN NOT gap THEN k END) AS n_contracts,
 count(*) FILTER (NOT gap) AS n_used
 FROM (SELECT *, {_KEY.format(x='expiration')} AS k, open_interest%5=0 OR open_interest%7=0 OR open_interest%11=0 AS gap FROM iv_quotes) GROUP BY 1""",
)


def _two_layouts(m: Market):
    """The raw archive written as two folders whose files order their columns differently."""
    paths = []
    for part in (0, 1):
        half = m.raw_quotes.where(F.col("open_interest") % 2 == part)
        paths.append(shared_folder(m.spark, f"layout-{part}"))
        half.select(*(half.columns if part == 0 else reversed(half.columns))).write.option("header", True).csv(paths[-1])
    return tables.read_quotes_csv(m.spark, paths).groupBy("root", "option_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("trade_volume").alias("volume"),
        F.sum("open_interest").alias("interest"),
        F.sum("bid_1545").alias("bids"),
        F.sum("ask_1545").alias("asks"),
        F.sum("strike").alias("strikes"),
    )


register(
    "quotes_in_two_layouts",
    _two_layouts,
    "root option_type n volume interest",
    "bids asks strikes",
    """SELECT root, option_type, count(*) AS n, CAST(sum(trade_volume) AS BIGINT) AS volume, CAST(sum(open_interest) AS BIGINT) AS interest,
 sum(bid_1545) AS bids, sum(ask_1545) AS asks, sum(strike) AS strikes FROM raw_quotes GROUP BY ALL""",
    digits=4,
)
