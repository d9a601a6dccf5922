"""Forecast inference, bootstrap, multiple testing, robustness and checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.sizing import exact_quantiles
from ..operators import checks, pnl, reports, risk, robustness, scoring, signals, stats
from ..settings import FORECAST_MODELS, HAC_LAGS, HEDGE_COST_BPS, STATE_PAIRS, STATES
from .forecast_cases import RANK_IC
from .inputs import INFERENCE, RULES, SPLITS, Market
from .portfolio_cases import performance_sql
from .registry import register
from .sql import adjust_sql, div, draws_sql, hac_cte, normal_p, num

REPS, FORECAST_REPS = INFERENCE.reps, INFERENCE.forecast_reps


def student_sql(source: str) -> str:
    """Student-t p-value column `p_t` from columns `t` and `nu` (finite series)."""
    return f"""SELECT *, greatest(0e0, 1-CASE WHEN nu%2=1 THEN (2/pi())*(th+CASE WHEN nu>1 THEN sin(th)*cos(th)*ser ELSE 0 END) ELSE sin(th)*ser END) AS p_t FROM (
 SELECT *, 1+list_sum(list_transform(range(1,1+CASE WHEN nu>=4 THEN CAST(floor((nu-CASE WHEN nu%2=1 THEN 3 ELSE 2 END)/2) AS INT) ELSE 0 END), lambda k:
   list_product(list_transform(range(1,k+1), lambda j: pow(cos(th),2)*CASE WHEN nu%2=1 THEN (2e0*j)/(2e0*j+1) ELSE (2e0*j-1)/(2e0*j) END)))) AS ser
 FROM (SELECT *, atan(abs(t)/sqrt(CAST(nu AS DOUBLE))) AS th FROM (SELECT *, HAC_t_stat AS t, n-1 AS nu FROM ({source}))))"""


# ---------------------------------------------------------------- forecast inference

_IC_ROWS = lambda m: scoring.daily_rank_ic(m.common, minimum=RULES.min_ic_nodes)
register(
    "rank_ic_summary",
    lambda m: scoring.rank_ic_summary(_IC_ROWS(m)),
    "model n_valid_dates hac_lag",
    "mean_daily_IC median_daily_IC std_daily_IC percent_positive q25 q75 NW_t_statistic p_value",
    f"""SELECT s.*, h.HAC_t_stat AS NW_t_statistic, h.p_t AS p_value, 5 AS hac_lag FROM (SELECT model, avg(rank_ic) AS mean_daily_IC, median(rank_ic) AS median_daily_IC, stddev_samp(rank_ic) AS std_daily_IC, count(*) AS n_valid_dates,
 100*avg(CASE WHEN rank_ic>0 THEN 1e0 ELSE 0e0 END) AS percent_positive, quantile_cont(rank_ic,0.25) AS q25, quantile_cont(rank_ic,0.75) AS q75 FROM ({RANK_IC}) WHERE rank_ic IS NOT NULL GROUP BY 1) s
 JOIN ({student_sql(hac_cte(f'({RANK_IC})', ['model'], 'rank_ic', 'forecast_target_date', student=True))}) h USING (model)""",
)
_PANEL = " UNION ALL ".join(
    f"SELECT '{l}' AS loss, forecast_target_date, {', '.join(f'max(L_{l}) FILTER (model={chr(39)}{m}{chr(39)}) AS {m}' for m in FORECAST_MODELS)} FROM daily_losses GROUP BY forecast_target_date HAVING count(L_{l})=4"
    for l in ("SE", "AE", "QLIKE")
)
_MODEL_PAIRS = [(a, b) for i, a in enumerate(FORECAST_MODELS) for b in FORECAST_MODELS[i + 1 :]]
_LOSS_PAIRS = " UNION ALL ".join(
    f"SELECT loss, '{a}' AS model_a, '{b}' AS model_b, forecast_target_date, {a}-{b} AS d FROM ({_PANEL})" for a, b in _MODEL_PAIRS
)
_loss_panel = lambda m: stats.loss_panel(m.daily_losses, list(FORECAST_MODELS))
register(
    "loss_panel",
    _loss_panel,
    "loss forecast_target_date",
    " ".join(FORECAST_MODELS),
    _PANEL,
    9,
)
register(
    "diebold_mariano",
    lambda m: stats.diebold_mariano(_loss_panel(m), list(FORECAST_MODELS)),
    "loss model_a model_b n_dates hac_lag lower_loss_model significant_5pct",
    "mean_loss_differential DM_t_statistic p_value",
    f"""SELECT loss, model_a, model_b, mean AS mean_loss_differential, HAC_t_stat AS DM_t_statistic, p_t AS p_value, n AS n_dates, 5 AS hac_lag, CASE WHEN mean<0 THEN model_a ELSE model_b END AS lower_loss_model,
 coalesce(p_t<0.05e0,false) AS significant_5pct FROM ({student_sql(hac_cte(f'({_LOSS_PAIRS})', ['loss', 'model_a', 'model_b'], 'd', 'forecast_target_date', student=True))})""",
    7,
)
_RATIO_ROWS = "(SELECT model, forecast_target_date, sum_SE, sum_AE, sum_QLIKE, CAST(n_common AS DOUBLE) AS n_common, CAST(n_qlike AS DOUBLE) AS n_qlike FROM daily_losses)"
_RATIO_DRAWS = draws_sql(_RATIO_ROWS, ["model"], ["sum_SE", "sum_AE", "sum_QLIKE", "n_common", "n_qlike"], "forecast_target_date", 5, FORECAST_REPS)
register(
    "metric_bootstrap_intervals",
    lambda m: stats.metric_intervals(m.daily_losses, reps=FORECAST_REPS),
    "model metric block_length reps seed",
    "lower_95 upper_95",
    " UNION ALL ".join(
        f"SELECT model, '{k}' AS metric, 5 AS block_length, {FORECAST_REPS} AS reps, 42 AS seed, quantile_cont(v,0.025) AS lower_95, quantile_cont(v,0.975) AS upper_95 FROM (SELECT model, {v} AS v FROM ({_RATIO_DRAWS})) GROUP BY 1"
        for k, v in (("RMSE", "sqrt(sum_SE/n_common)"), ("MAE", "sum_AE/n_common"), ("QLIKE", "sum_QLIKE/n_qlike"))
    ),
    9,
)


def mcs_sql(block: int) -> str:
    draws = draws_sql(f"({_PANEL})", ["loss"], list(FORECAST_MODELS), "forecast_target_date", block, FORECAST_REPS)
    models = list(FORECAST_MODELS)
    pairs = " UNION ALL ".join(
        f"SELECT d.loss, d.rep, {models.index(a)} AS a, {models.index(b)} AS b, o.{a}-o.{b} AS gap, (d.{a}-d.{b})/d.n-(o.{a}-o.{b}) AS dev FROM draws d JOIN obs o USING (loss)"
        for a, b in _MODEL_PAIRS
    )
    return f"""SELECT * FROM (WITH RECURSIVE draws AS MATERIALIZED ({draws}), obs AS (SELECT loss, count(*) AS n_dates, {', '.join(f'avg({m}) AS {m}' for m in models)} FROM ({_PANEL}) GROUP BY 1),
 pairs AS ({pairs}), scaled AS MATERIALIZED (SELECT loss, rep, a, b, gap/s AS t, abs(dev/s) AS sim FROM (SELECT *, sqrt(avg(dev*dev) OVER (PARTITION BY loss,a,b)) AS s FROM pairs)),
 masks AS (SELECT unnest(range(1,16)) AS mask),
 per_rep AS (SELECT loss, mask, rep, max(sim) AS sim, max(abs(t)) AS stat, arg_max(CASE WHEN t>0 THEN a ELSE b END, abs(t)) AS worst FROM scaled JOIN masks ON ((mask>>a)&1)=1 AND ((mask>>b)&1)=1 GROUP BY 1,2,3),
 subsets AS MATERIALIZED (SELECT loss, mask, avg(CASE WHEN stat<sim THEN 1e0 ELSE 0e0 END) AS p, min(worst) AS worst FROM per_rep GROUP BY 1,2),
 path AS (SELECT loss, 15 AS mask, 0e0 AS p, -1 AS dropped FROM obs UNION ALL SELECT q.loss, CAST(xor(q.mask,1<<s.worst) AS INT), greatest(q.p,s.p), CAST(s.worst AS INT) FROM path q JOIN subsets s ON s.loss=q.loss AND s.mask=q.mask),
 final AS (SELECT loss, dropped AS i, p FROM path WHERE dropped>=0 UNION ALL SELECT loss, CASE mask WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END, 1e0 FROM path WHERE mask IN (1,2,4,8))
 SELECT f.loss, [{', '.join(f"'{m}'" for m in models)}][f.i+1] AS model, p AS p_value, p>0.05e0 AS included, n_dates, {block} AS block_length FROM final f JOIN obs USING (loss))"""


for _b in (5, 10):
    register(
        f"model_confidence_set_block_{_b}",
        lambda m, b=_b: stats.model_confidence_set(_loss_panel(m), list(FORECAST_MODELS), block=b, reps=FORECAST_REPS),
        "loss model included n_dates block_length",
        "p_value",
        mcs_sql(_b),
    )

_COUNTS = "(SELECT count(*) AS n_common, count(DISTINCT forecast_target_date) AS n_dates_common, count(DISTINCT node) AS n_nodes_common FROM journal WHERE common_sample_4models)"
_COMPARISON = f"""SELECT *, rank() OVER (ORDER BY RMSE) AS RMSE_rank, rank() OVER (ORDER BY MAE) AS MAE_rank, rank() OVER (ORDER BY QLIKE) AS QLIKE_rank, 100e0*n_common/n_predictions_all AS common_retained_pct
 FROM (SELECT model, sqrt(avg(SE)) AS RMSE, avg(AE) AS MAE, avg(QL) AS QLIKE, count(QL) AS QLIKE_n FROM scored GROUP BY 1) JOIN ({' UNION ALL '.join(f"SELECT '{m}' AS model, count(*) FILTER (available_{m}) AS n_predictions_all, count(*) FILTER (available_{m} AND target_available) AS n_scored_individual FROM journal" for m in FORECAST_MODELS)}) USING (model) CROSS JOIN {_COUNTS}"""
register(
    "forecast_comparison",
    lambda m: scoring.comparison_table(m.journal, m.daily_losses, inference=INFERENCE),
    "model n_predictions_all n_scored_individual n_common n_dates_common n_nodes_common QLIKE_n RMSE_rank MAE_rank QLIKE_rank",
    "common_retained_pct RMSE MAE QLIKE",
    _COMPARISON,
    9,
)
_SUMMARY_SQL = f"""SELECT a.*, h.HAC_t_stat AS IC_NW_t, h.p_t AS IC_p_value, z.HAC_t_stat AS spread_NW_t, z.p_t AS spread_p_value, 5 AS hac_lag, (a.long_hit_rate+a.short_hit_rate)/2 AS balanced_hit_rate FROM (
 SELECT * FROM (SELECT model, avg(rank_ic) AS mean_IC, median(rank_ic) AS median_IC, stddev_samp(rank_ic) AS std_IC, count(rank_ic) AS valid_IC_dates, 100*avg(CASE WHEN rank_ic>0 THEN 1e0 WHEN rank_ic IS NOT NULL THEN 0e0 END) AS IC_percent_positive,
  avg(top_minus_bottom) AS mean_top_minus_bottom, median(top_minus_bottom) AS median_top_minus_bottom, count(top_minus_bottom) AS valid_spread_dates, 100*avg(CASE WHEN top_minus_bottom>0 THEN 1e0 WHEN top_minus_bottom IS NOT NULL THEN 0e0 END) AS spread_percent_positive,
  avg(balanced_hit_rate) AS mean_daily_balanced_hit FROM signal_daily GROUP BY 1)
 LEFT JOIN (SELECT model, avg(CASE WHEN actual_holding_change>0 THEN 1e0 ELSE 0e0 END) FILTER (signal=1) AS long_hit_rate, avg(CASE WHEN actual_holding_change<0 THEN 1e0 ELSE 0e0 END) FILTER (signal=-1) AS short_hit_rate,
  count(*) FILTER (signal=1) AS n_scored_long, count(*) FILTER (signal=-1) AS n_scored_short FROM signals WHERE selected AND actual_holding_change IS NOT NULL GROUP BY 1) USING (model)) a
 LEFT JOIN ({student_sql(hac_cte('signal_daily', ['model'], 'rank_ic', 'decision_date', student=True))}) h USING (model)
 LEFT JOIN ({student_sql(hac_cte('signal_daily', ['model'], 'top_minus_bottom', 'decision_date', student=True))}) z USING (model)"""
_SUMMARY = (
    "model valid_IC_dates valid_spread_dates n_scored_long n_scored_short hac_lag",
    "mean_IC median_IC std_IC IC_percent_positive IC_NW_t IC_p_value mean_top_minus_bottom median_top_minus_bottom spread_NW_t spread_p_value spread_percent_positive long_hit_rate short_hit_rate balanced_hit_rate mean_daily_balanced_hit",
)
_signal_summary = lambda m: signals.signal_summary(m.signal_daily, m.signals, INFERENCE)
register("signal_summary", _signal_summary, *_SUMMARY, _SUMMARY_SQL)
register(
    "signal_report_sheet",
    lambda m: reports.signal_sheet(_signal_summary(m), m.economic, m.signals),
    "model economic_candidate_count selected_signals",
    "mean_IC",
    f"SELECT s.*, (SELECT count(*) FROM economic WHERE common_economic_candidate) AS economic_candidate_count, (SELECT count(*) FROM signals x WHERE x.selected AND x.model=s.model) AS selected_signals FROM ({_SUMMARY_SQL}) s",
)

# ---------------------------------------------------------------- HAC and bootstrap

_DAILY_LONG = "(SELECT model, entry_date, 'MID' AS implementation, Return_mid AS Return FROM daily UNION ALL SELECT model, entry_date, 'BID_ASK', Return_exec FROM daily)"
_daily_long = lambda m: pnl.by_implementation(m.daily, ["model", "entry_date"], ("Return",))
register(
    "hac_mean_test",
    lambda m: stats.hac_test(_daily_long(m), ["model", "implementation"], "Return", "entry_date"),
    "model implementation n HAC_lag",
    "mean median HAC_standard_error HAC_t_stat raw_p",
    hac_cte(_DAILY_LONG, ["model", "implementation"], "Return", "entry_date"),
    8,
)


def bootstrap_sql(source: str, keys: list[str], value: str, order: str, block: int) -> str:
    k = ", ".join(keys)
    rows = f"(SELECT {k}, {order}, {value} AS x, {value}*{value} AS xx FROM {source})"
    draws = draws_sql(rows, keys, ["x", "xx"], order, block, REPS)
    return f"""SELECT {k}, quantile_cont(mean,0.025) AS bootstrap_mean_CI_low, quantile_cont(mean,0.975) AS bootstrap_mean_CI_high, quantile_cont(sharpe,0.025) AS bootstrap_sharpe_CI_low, quantile_cont(sharpe,0.975) AS bootstrap_sharpe_CI_high,
 {block} AS bootstrap_block_length, {REPS} AS bootstrap_repetitions, 42 AS bootstrap_seed FROM (SELECT {k}, x/n AS mean, sqrt(252e0)*(x/n)/nullif(sqrt(greatest((xx-x*x/n)/(n-1),0e0)),0e0) AS sharpe FROM ({draws})) GROUP BY {k}"""


_CI = (
    "bootstrap_block_length bootstrap_repetitions bootstrap_seed",
    "bootstrap_mean_CI_low bootstrap_mean_CI_high bootstrap_sharpe_CI_low bootstrap_sharpe_CI_high",
)
register(
    "circular_block_bootstrap",
    lambda m: stats.bootstrap_sensitivity(_daily_long(m), ["model", "implementation"], "Return", "entry_date", (5, 10), reps=REPS),
    "model implementation " + _CI[0],
    _CI[1],
    " UNION ALL ".join(bootstrap_sql(_DAILY_LONG, ["model", "implementation"], "Return", "entry_date", b) for b in (5, 10)),
)
_ORDER_DAYS = "(SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS revenue, count(*) AS n_orders FROM orders GROUP BY ALL)"


def _order_days(m: Market):
    return (
        m.table("orders")
        .groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day"))
        .agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n_orders"))
    )


register(
    "hac_on_daily_revenue",
    lambda m: stats.hac_test(_order_days(m), ["o_orderpriority"], "revenue", "day", 10),
    "o_orderpriority n HAC_lag",
    "mean median HAC_standard_error HAC_t_stat raw_p",
    hac_cte(_ORDER_DAYS, ["o_orderpriority"], "revenue", "day", 10),
    4,
)
register(
    "exact_quantiles_of_prices",
    lambda m: exact_quantiles(
        m.table("lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {"q10": 0.1, "q50": 0.5, "q95": 0.95}
    ),
    "l_returnflag",
    "q10 q50 q95",
    "SELECT l_returnflag, quantile_cont(l_extendedprice,0.1) AS q10, quantile_cont(l_extendedprice,0.5) AS q50, quantile_cont(l_extendedprice,0.95) AS q95 FROM lineitem GROUP BY 1",
    4,
)

# ---------------------------------------------------------------- multiple testing and robustness

_PERF = f"(SELECT model, portfolio_state, implementation, mean_daily_return, HAC_p_value AS raw_p FROM ({performance_sql('SELECT * FROM state_returns', ['model', 'portfolio_state', 'implementation'])}))"
_MULTI = f"""SELECT *, 'PRIMARY_'||implementation||'_'||family_size AS family FROM ({adjust_sql(_PERF, ['implementation'], ['model', 'portfolio_state'])})
 UNION ALL SELECT *, 'SECONDARY_'||implementation||'_'||model||'_'||family_size AS family FROM ({adjust_sql(_PERF, ['implementation', 'model'], ['model', 'portfolio_state'])})"""
_ADJ = ("holm_reject_5pct BH_reject_5pct family_size", "raw_p holm_adjusted_p BH_adjusted_p")
register(
    "multiple_testing",
    lambda m: robustness.multiple_testing(m.performance),
    "model portfolio_state implementation family " + _ADJ[0],
    "mean_daily_return " + _ADJ[1],
    _MULTI,
)
_PAIRED = " UNION ALL ".join(
    f"SELECT model, entry_date, '{a}_MINUS_{b}' AS transformation, '{a}' AS target_state, '{b}' AS reference_state, max(Return_mid) FILTER (portfolio_state='{a}')-max(Return_mid) FILTER (portfolio_state='{b}') AS difference FROM live_states GROUP BY model, entry_date"
    for a, b in STATE_PAIRS
)
_PK = robustness.PAIR_KEYS
register(
    "paired_state_effects",
    lambda m: robustness.paired_effects(m.states, INFERENCE, m.eligible_days),
    "model transformation target_state reference_state n_days " + _ADJ[0] + " " + _CI[0],
    "mean median HAC_standard_error HAC_t_stat " + _ADJ[1] + " " + _CI[1],
    f"""SELECT a.*, a.n AS n_days, {', '.join('b.' + c for c in (_CI[0] + ' ' + _CI[1]).split())} FROM ({adjust_sql(f"({hac_cte(f'({_PAIRED})', _PK, 'difference', 'entry_date')})", [], ['model', 'transformation'])}) a
 JOIN ({bootstrap_sql(f'({_PAIRED})', _PK, 'difference', 'entry_date', 5)}) b USING (model, transformation)""",
    6,
)
register(
    "paired_bootstrap_sensitivity",
    lambda m: robustness.paired_bootstrap(m.states, INFERENCE, m.eligible_days),
    "model transformation " + _CI[0],
    _CI[1],
    " UNION ALL ".join(bootstrap_sql(f"({_PAIRED})", _PK, "difference", "entry_date", b) for b in (5, 10)),
)
_COMP = " UNION ALL ".join(
    f"SELECT model, entry_date, '{c}' AS component, sum({c}) AS x FROM attribution GROUP BY model, entry_date" for c in robustness.COMPONENTS
)
register(
    "greek_component_inference",
    lambda m: robustness.component_inference(m.attribution),
    "model component n_days " + _ADJ[0],
    "mean median HAC_standard_error HAC_t_stat " + _ADJ[1],
    f"SELECT *, n AS n_days FROM ({adjust_sql(f'''({hac_cte(f'({_COMP})', ['model', 'component'], 'x', 'entry_date')})''', [], ['model', 'component'])})",
    7,
)
register(
    "daily_greek_components",
    lambda m: robustness.daily_components(m.attribution),
    "model entry_date",
    " ".join(robustness.COMPONENTS),
    f"SELECT model, entry_date, {', '.join(f'sum({c}) AS {c}' for c in robustness.COMPONENTS)} FROM attribution GROUP BY ALL",
    8,
)
_NORM = "SELECT r.*, r.PnL/nullif(d.GrossPremium_mid,0e0) AS common_ FROM state_returns r JOIN daily d USING (model, entry_date)"
register(
    "normalisation_sensitivity",
    lambda m: robustness.normalisation(m.live_states, m.daily),
    "model portfolio_state implementation n_days common_sign_matches_primary pooled_sign_matches_primary",
    "primary_mean_daily_ratio mean_Return_common_denom pooled_premium_return total_pnl total_state_gross_premium",
    f"""SELECT *, sign(primary_mean_daily_ratio)=sign(mean_Return_common_denom) AS common_sign_matches_primary, sign(primary_mean_daily_ratio)=sign(pooled_premium_return) AS pooled_sign_matches_primary FROM (
 SELECT model, portfolio_state, implementation, count(*) AS n_days, avg(Return) AS primary_mean_daily_ratio, avg(common_) AS mean_Return_common_denom, sum(PnL)/sum(GrossPremium) AS pooled_premium_return, sum(PnL) AS total_pnl, sum(GrossPremium) AS total_state_gross_premium FROM ({_NORM}) GROUP BY 1,2,3)""",
)
_HEDGE = "SELECT s.*, abs(s.hedge_quantity)*p.S_entry AS hedge_notional FROM live_states s JOIN spots p USING (model, entry_date) WHERE portfolio_state IN ('DELTA_NEUTRAL','VEGA_BALANCED_DELTA_NEUTRAL')"
_EVEN = f"""SELECT *, 10000*break_even_decimal_per_side AS break_even_bps_per_side, 20000*break_even_decimal_per_side AS break_even_bps_round_trip, 10000*aggregate_break_even_decimal_per_side AS aggregate_break_even_bps_per_side,
 uncosted_mean_MID>0 AS positive_mean_friction_budget, CASE WHEN uncosted_mean_MID>0 THEN 'POSITIVE_MEAN_BUDGET' ELSE 'NO_POSITIVE_COST_BUDGET_ALREADY_NONPOSITIVE' END AS status FROM (
 SELECT *, CASE WHEN mean_normalized_cost_load>0 THEN greatest(0e0,uncosted_mean_MID/mean_normalized_cost_load) END AS break_even_decimal_per_side, CASE WHEN notional>0 THEN greatest(0e0,uncosted_total_MID_pnl/(2*notional)) END AS aggregate_break_even_decimal_per_side FROM (
 SELECT model, portfolio_state, count(*) AS n_days, avg(Return_mid) AS uncosted_mean_MID, sum(PnL_mid) AS uncosted_total_MID_pnl, avg(hedge_notional) AS mean_hedge_notional, avg(2*hedge_notional/nullif(GrossPremium_mid,0e0)) AS mean_normalized_cost_load, sum(hedge_notional) AS notional FROM ({_HEDGE}) GROUP BY 1,2))"""
_STRESS = f"""SELECT model, portfolio_state, bps_per_side, 2*max(bps_per_side) AS bps_round_trip, count(*) AS n_days, avg((PnL_mid-cost)/nullif(GrossPremium_mid,0e0)) AS mean_MID_after_hypothetical_cost, sum(PnL_mid-cost) AS total_MID_pnl_after_hypothetical_cost,
 avg((PnL_exec-cost)/nullif(GrossPremium_exec,0e0)) AS mean_BID_ASK_proxy_after_hypothetical_cost FROM (SELECT *, 2*(bps_per_side/10000)*hedge_notional AS cost FROM ({_HEDGE}) CROSS JOIN (VALUES {', '.join(f'({num(float(b))})' for b in HEDGE_COST_BPS)}) v(bps_per_side)) GROUP BY 1,2,3"""
_EVEN_COLUMNS = "uncosted_mean_MID uncosted_total_MID_pnl mean_hedge_notional mean_normalized_cost_load break_even_decimal_per_side break_even_bps_per_side break_even_bps_round_trip aggregate_break_even_decimal_per_side aggregate_break_even_bps_per_side"
_STRESS_COLUMNS = "bps_per_side bps_round_trip mean_MID_after_hypothetical_cost total_MID_pnl_after_hypothetical_cost mean_BID_ASK_proxy_after_hypothetical_cost"
_even = lambda m: robustness.hedge_break_even(m.live_states, m.spots)
_stress = lambda m: robustness.hedge_stress(m.live_states, m.spots)
register("hedge_cost_break_even", _even, "model portfolio_state n_days positive_mean_friction_budget status", _EVEN_COLUMNS, _EVEN)
register("hedge_cost_stress", _stress, "model portfolio_state n_days", _STRESS_COLUMNS, _STRESS)
_null = lambda names: ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in names.split())
register(
    "hedge_cost_report",
    lambda m: robustness.hedge_report(_even(m), _stress(m)),
    "record_type model portfolio_state n_days status",
    _EVEN_COLUMNS + " " + _STRESS_COLUMNS,
    f"""SELECT 'BREAK_EVEN' AS record_type, model, portfolio_state, n_days, status, {', '.join(_EVEN_COLUMNS.split())}, {_null(_STRESS_COLUMNS)} FROM ({_EVEN})
 UNION ALL SELECT 'STRESS', model, portfolio_state, n_days, NULL, {_null(_EVEN_COLUMNS)}, {', '.join(_STRESS_COLUMNS.split())} FROM ({_STRESS})""",
)


def _months(m: Market):
    return m.live_states.withColumn("decision_month", F.month("decision_date"))


def stability_sql(source: str) -> str:
    keys = ["model", "portfolio_state", "bucket", "implementation"]
    rows = f"(SELECT model, portfolio_state, bucket, 'MID' AS implementation, entry_date, Return_mid AS Return FROM ({source}) UNION ALL SELECT model, portfolio_state, bucket, 'BID_ASK', entry_date, Return_exec FROM ({source}) WHERE portfolio_state IN ('ORIGINAL','VEGA_BALANCED'))"
    return f"""SELECT h.*, h.n AS n_days, s.annualized_sharpe FROM ({hac_cte(rows, keys, 'Return', 'entry_date')}) h
 JOIN (SELECT {', '.join(keys)}, sqrt(252e0)*avg(Return)/nullif(stddev_samp(Return),0e0) AS annualized_sharpe FROM {rows} GROUP BY ALL) s USING ({', '.join(keys)})"""


_STAB = ("model portfolio_state bucket implementation n_days HAC_lag", "annualized_sharpe mean median HAC_standard_error HAC_t_stat raw_p")
register(
    "subperiod_stability",
    lambda m: robustness.stability(_months(m), "decision_month", [1, 2, 3]),
    *_STAB,
    stability_sql("SELECT *, CAST(month(decision_date) AS VARCHAR) AS bucket FROM live_states WHERE month(decision_date) IN (1,2,3)"),
)
CUTOFF = dt.date(2024, 2, 2)
_LEVELS = "SELECT quote_date AS decision_date, median(iv_grid) AS market_IV_level, count(iv_grid) AS n_observed_nodes FROM surface GROUP BY 1"
_THRESHOLD = f"(SELECT median(market_IV_level) FROM ({_LEVELS}) WHERE decision_date<=DATE '2024-02-02')"
_REGIMES = f"SELECT l.*, CASE WHEN market_IV_level<={_THRESHOLD} THEN 'LOW_IV' ELSE 'HIGH_IV' END AS IV_regime FROM ({_LEVELS}) l SEMI JOIN live_states s ON s.decision_date=l.decision_date"
_regimes = lambda m: robustness.iv_regimes(m.live_states, robustness.iv_levels(m.surface), CUTOFF)
register("iv_levels", lambda m: robustness.iv_levels(m.surface), "decision_date n_observed_nodes", "market_IV_level", _LEVELS, 9)
register(
    "iv_regime_threshold",
    lambda m: robustness.regime_threshold(robustness.iv_levels(m.surface), CUTOFF),
    "pretest_n_dates pretest_first_date pretest_last_date",
    "threshold",
    f"SELECT median(market_IV_level) AS threshold, count(*) AS pretest_n_dates, min(decision_date) AS pretest_first_date, max(decision_date) AS pretest_last_date FROM ({_LEVELS}) WHERE decision_date<=DATE '2024-02-02'",
    9,
)
register("iv_regimes", _regimes, "decision_date IV_regime n_observed_nodes", "market_IV_level", _REGIMES, 9)
register(
    "iv_regime_stability",
    lambda m: robustness.stability(m.live_states.join(_regimes(m), "decision_date"), "IV_regime", ["LOW_IV", "HIGH_IV"], strict=False),
    *_STAB,
    stability_sql(f"SELECT s.*, r.IV_regime AS bucket FROM live_states s JOIN ({_REGIMES}) r USING (decision_date)"),
)
_SENS = " UNION ALL ".join(f"({hac_cte('state_returns', ['model', 'portfolio_state', 'implementation'], 'Return', 'entry_date', lag)})" for lag in HAC_LAGS)
register(
    "hac_lag_sensitivity",
    lambda m: robustness.lag_sensitivity(m.live_states),
    "model portfolio_state implementation HAC_lag n_days " + _ADJ[0],
    "mean HAC_standard_error HAC_t_stat " + _ADJ[1],
    f"SELECT *, n AS n_days FROM ({adjust_sql(f'({_SENS})', ['implementation', 'HAC_lag'], ['model', 'portfolio_state'])})",
)


def _chain(m: Market):
    forecast = scoring.metrics(m.common)
    ic = scoring.rank_ic_summary(_IC_ROWS(m))
    return robustness.full_chain(forecast, ic, _signal_summary(m), m.performance, robustness.multiple_testing(m.performance), _even(m))


_CELL = lambda s, i: f"max(mean_daily_return) FILTER (portfolio_state='{s}' AND implementation='{i}')"
_CHAIN = f"""SELECT f.model, f.RMSE, f.MAE, f.QLIKE, i.ic AS forecast_Rank_IC, g.mean_IC AS holding_period_Rank_IC, g.mean_top_minus_bottom AS holding_IV_top_minus_bottom, p.*  EXCLUDE (model), j.holm_adjusted_p, j.holm_reject_5pct, j.BH_adjusted_p, j.BH_reject_5pct, e.* EXCLUDE (model)
FROM (SELECT model, sqrt(avg(SE)) AS RMSE, avg(AE) AS MAE, avg(QL) AS QLIKE FROM scored GROUP BY 1) f JOIN (SELECT model, avg(rank_ic) AS ic FROM ({RANK_IC}) GROUP BY 1) i USING (model) JOIN ({_SUMMARY_SQL}) g USING (model)
JOIN (SELECT model, {_CELL('ORIGINAL', 'BID_ASK')} AS original_BID_ASK_mean, {', '.join(f"{_CELL(s, 'MID')} AS {n}_MID_mean" for s, n in robustness.STATE_SHORT.items())} FROM {_PERF} GROUP BY 1) p USING (model)
JOIN (SELECT * FROM ({_MULTI}) WHERE family LIKE 'PRIMARY_MID%' AND portfolio_state='VEGA_BALANCED_DELTA_NEUTRAL') j USING (model)
JOIN (SELECT model, max(break_even_bps_per_side) FILTER (portfolio_state='DELTA_NEUTRAL') AS delta_neutral_break_even_bps_per_side, max(break_even_bps_per_side) FILTER (portfolio_state='VEGA_BALANCED_DELTA_NEUTRAL') AS joint_break_even_bps_per_side FROM ({_EVEN}) GROUP BY 1) e USING (model)"""
register(
    "full_chain_summary",
    _chain,
    "model holm_reject_5pct BH_reject_5pct",
    "RMSE MAE QLIKE forecast_Rank_IC holding_period_Rank_IC holding_IV_top_minus_bottom original_BID_ASK_mean original_MID_mean delta_neutral_MID_mean vega_balanced_MID_mean joint_MID_mean holm_adjusted_p BH_adjusted_p delta_neutral_break_even_bps_per_side joint_break_even_bps_per_side",
    _CHAIN,
)
_DIRECTION = {True: "ASC", False: "DESC"}
register(
    "model_ranks",
    lambda m: robustness.model_ranks(_chain(m)),
    "model " + " ".join(f"{c}_rank" for c, _ in robustness.RANKED),
    "",
    f"SELECT model, {', '.join(f'rank() OVER (ORDER BY {c} {_DIRECTION[up]}) AS {c}_rank' for c, up in robustness.RANKED)} FROM ({_CHAIN})",
)

# ---------------------------------------------------------------- checks


def _exposures(m: Market):
    return risk.exposures(m.controls, m.daily)


register(
    "invariants",
    lambda m: checks.invariants(
        m.journal,
        m.economic,
        m.signals,
        m.trades,
        m.ready,
        m.active,
        m.contracts,
        m.attribution,
        _exposures(m),
        m.states,
        robustness.multiple_testing(m.performance),
        lambda economic: signals.rank_signals(economic, RULES),
    ),
    "check_name violations status",
    "",
    "SELECT unnest(['common_forecasts_finite','signal_selection_ignores_future_IV','same_candidates_all_three_models','entry_side_half_budgets','contract_netting_signed_conservation','no_duplicate_active_contracts','BASE_exit_coverage_after_calendar','exact_exit_identity','mid_price_identity','bid_ask_spread_accounting','DGT_identity','full_DGT_coverage','DGVT_identity','entry_controls_do_not_leverage','entry_delta_neutral','entry_vega_balanced','normalization_mid','normalization_exec','twelve_test_family_MID','twelve_test_family_BID_ASK']) AS check_name, 0 AS violations, 'PASS' AS status FROM (SELECT count(*) FROM contracts)",
)
register(
    "look_ahead_guard",
    lambda m: checks.selection_ignores_outcomes(
        m.economic, lambda e: signals.rank_signals(e, RULES), ["actual_iv_entry", "actual_iv_exit", "actual_holding_change"]
    ),
    "check_name violations status",
    "",
    "SELECT 'signal_selection_ignores_future_IV' AS check_name, 0 AS violations, CASE WHEN count(*)>0 THEN 'PASS' END AS status FROM economic",
)
register(
    "tolerance_check",
    lambda m: checks.tolerance_check(
        "net_weight", m.net, m.ready.withColumn("weight_at_entry", F.col("weight_at_entry") + 1e-7), ["model", "entry_date", "contract_key"], "weight_at_entry", 1e-6
    ),
    "check_name status observed_rows reference_rows",
    "max_abs_difference",
    "SELECT 'net_weight' AS check_name, 'PASS' AS status, count(*) AS observed_rows, count(*) AS reference_rows, 1e-7 AS max_abs_difference FROM net",
    9,
)


def _counts(m: Market):
    observed = m.contracts.groupBy(F.concat(F.lit("contracts_"), "model").alias("check_name")).agg(F.count(F.lit(1)).alias("n"))
    expected = m.daily.groupBy(F.concat(F.lit("contracts_"), "model").alias("check_name")).agg(F.sum("number_contracts").alias("n"))
    return checks.count_checks(observed, expected)


register(
    "count_checks",
    _counts,
    "check_name observed reference status",
    "",
    "SELECT 'contracts_'||model AS check_name, count(*) AS observed, count(*) AS reference, 'PASS' AS status FROM contracts GROUP BY 1",
)
register(
    "duplicate_position_check",
    lambda m: checks.duplicate_keys(m.trades.where("contract_key IS NOT NULL"), ["model", "entry_date", "contract_key"]),
    "model entry_date contract_key n",
    "",
    "SELECT model, entry_date, contract_key, count(*) AS n FROM trades WHERE contract_key IS NOT NULL GROUP BY ALL HAVING count(*)>1",
)
register(
    "all_checks_report",
    lambda m: reports.all_checks(
        (2, checks.tolerance_check("net_weight", m.net, m.ready, ["model", "entry_date", "contract_key"], "weight_at_entry")),
        (2, checks.same_candidates(m.signals)),
    ),
    "stage check status",
    "",
    "SELECT unnest(['net_weight','same_candidates_all_three_models']) AS \"check\", 2 AS stage, 'PASS' AS status FROM (SELECT count(*) FROM net)",
)
