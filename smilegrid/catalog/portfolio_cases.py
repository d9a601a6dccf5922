"""PnL, risk controls, attribution and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, pnl, reports, risk
from .inputs import INFERENCE, Market
from .registry import register
from .sql import controls_sql, div, hac_cte

_GREEKS = ("Delta", "Gamma", "Vega", "Theta")

register(
    "contract_pnl",
    lambda m: m.contracts,
    "model entry_date exit_date contract_key exit_quote_source",
    "signed_weight pnl_mid pnl_exec entry_spread_cost exit_spread_cost cost_wedge_pnl relative_entry_spread relative_exit_spread",
    "contracts",
    8,
)
register(
    "daily_pnl",
    lambda m: m.daily,
    "model entry_date decision_date exit_date number_contracts number_raw_recovered_exits number_processed_exits number_unique_mapped_contracts number_mapped_nodes number_selected_nodes",
    "PnL_mid PnL_exec GrossPremium_mid GrossPremium_exec Return_mid Return_exec cost_wedge_pnl cost_wedge_return net_gross_weight net_signed_weight gross_pre_net_signal_weight entry_spread_cost exit_spread_cost",
    "SELECT * REPLACE (CAST(number_mapped_nodes AS BIGINT) AS number_mapped_nodes) FROM daily",
    8,
)
register(
    "eligible_gross_weight",
    lambda m: pnl.eligible_gross(m.eligible),
    "model entry_date",
    "gross_weight",
    "SELECT model, entry_date, sum(node_gross_weight) AS gross_weight FROM eligible GROUP BY ALL",
    9,
)
_DAILY_RETURNS = """SELECT model, entry_date, 'MID' AS implementation, Return_mid AS Return, PnL_mid AS PnL, number_contracts FROM daily
 UNION ALL SELECT model, entry_date, 'BID_ASK', Return_exec, PnL_exec, number_contracts FROM daily"""


def performance_sql(source: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x}=h.{x}" for x in keys)
    hac = hac_cte(f"({source})", keys, "Return", "entry_date")
    return f"""SELECT a.*, 252*a.mean_ AS annualized_mean, sqrt(252e0)*a.daily_vol AS annualized_vol, sqrt(252e0)*{div('a.mean_', 'a.daily_vol')} AS annualized_sharpe,
 h.mean AS mean_daily_return, h.HAC_standard_error, h.HAC_t_stat, h.raw_p AS HAC_p_value
FROM (SELECT {k}, count(*) AS n_days, CAST(sum(number_contracts) AS BIGINT) AS n_contracts, avg(Return) AS mean_, median(Return) AS median_daily_return, stddev_samp(Return) AS daily_vol,
  sum(Return) AS cumulative_normalized_return, 100*avg(CASE WHEN Return>0 THEN 1e0 ELSE 0e0 END) AS positive_day_pct, min(Return) AS worst_daily_return, max(Return) AS best_daily_return,
  sum(PnL) AS total_pnl, min(dd) AS max_drawdown, CASE WHEN min(w) IS NOT NULL THEN arg_max(w,entry_date)-1 END AS compounded_normalized_return,
  CASE WHEN min(w) IS NOT NULL THEN 'MATHEMATICALLY_ADMISSIBLE_PREMIUM_EXPOSURE_INDEX' ELSE 'INVALID_RETURN_LE_MINUS_ONE_OR_NONFINITE' END AS wealth_index_status
  FROM (SELECT *, w/greatest(1e0, max(w) OVER (PARTITION BY {k} ORDER BY entry_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))-1 AS dd FROM (
   SELECT *, CASE WHEN min(Return) OVER (PARTITION BY {k})>-1 THEN exp(sum(ln(greatest(1+Return,1e-300))) OVER (PARTITION BY {k} ORDER BY entry_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS w
   FROM ({source}))) GROUP BY {k}) a JOIN ({hac}) h ON {on}"""


def guarded_sql(source: str, columns: str) -> str:
    """Statistics only where the sample has seven days."""
    blank = ", ".join(f"CASE WHEN n_days>=7 THEN {c} END AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({blank}), CASE WHEN n_days>=7 THEN 'OK' ELSE 'UNAVAILABLE_INFERENCE' END AS status FROM ({source})"


_PERFORMANCE = (
    "n_days n_contracts wealth_index_status",
    "median_daily_return daily_vol annualized_mean annualized_vol annualized_sharpe cumulative_normalized_return compounded_normalized_return positive_day_pct max_drawdown worst_daily_return best_daily_return total_pnl mean_daily_return HAC_standard_error HAC_t_stat HAC_p_value",
)
register(
    "original_performance",
    lambda m: pnl.performance(m.daily, ["model"], INFERENCE, m.contracts, with_bootstrap=False),
    "model implementation n_distinct_contract_keys " + _PERFORMANCE[0],
    _PERFORMANCE[1],
    f"SELECT p.*, c.n_distinct_contract_keys FROM ({performance_sql(_DAILY_RETURNS, ['model', 'implementation'])}) p JOIN (SELECT model, count(DISTINCT contract_key) AS n_distinct_contract_keys FROM contracts GROUP BY 1) c USING (model)",
)
register(
    "state_performance",
    lambda m: m.performance,
    "model portfolio_state implementation status " + _PERFORMANCE[0],
    _PERFORMANCE[1] + " unavailable_day_pct",
    f"SELECT p.*, 100e0*(1-p.n_days/d.days) AS unavailable_day_pct FROM ({guarded_sql(performance_sql('SELECT * FROM state_returns', ['model', 'portfolio_state', 'implementation']), _PERFORMANCE[1])}) p"
    " JOIN (SELECT model, portfolio_state, count(*) AS days FROM states GROUP BY ALL) d USING (model, portfolio_state)",
)


def _paths(m: Market):
    from ..operators import stats

    return stats.return_paths(m.daily, ["model"], "Return_mid", "entry_date")


register(
    "wealth_and_drawdown",
    _paths,
    "model entry_date",
    "cumulative_arithmetic wealth drawdown",
    """SELECT *, wealth/greatest(1e0, max(wealth) OVER (PARTITION BY model ORDER BY entry_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))-1 AS drawdown FROM (
 SELECT model, entry_date, sum(Return_mid) OVER w AS cumulative_arithmetic, CASE WHEN min(Return_mid) OVER (PARTITION BY model)>-1 THEN exp(sum(ln(greatest(1+Return_mid,1e-300))) OVER w) END AS wealth
 FROM daily WINDOW w AS (PARTITION BY model ORDER BY entry_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    8,
)
_PAIRS = " UNION ALL ".join(
    f"""SELECT '{a}' AS model_A, '{b}' AS model_B, '{i}' AS implementation, x.entry_date, x.{r}-y.{r} AS d FROM daily x JOIN daily y ON y.entry_date=x.entry_date AND x.model='{a}' AND y.model='{b}'"""
    for i, r in (("MID", "Return_mid"), ("BID_ASK", "Return_exec"))
    for a, b in (("arima", "ridge"), ("arima", "xgboost"), ("ridge", "xgboost"))
)
register(
    "pairwise_returns",
    lambda m: pnl.pairwise_returns(m.daily),
    "model_A model_B implementation n_inference_dates HAC_lag",
    "mean_difference HAC_standard_error HAC_t_stat HAC_p_value",
    f"SELECT *, mean AS mean_difference, n AS n_inference_dates, raw_p AS HAC_p_value FROM ({hac_cte(f'({_PAIRS})', ['model_A', 'model_B', 'implementation'], 'd', 'entry_date')})",
    8,
)
register(
    "cost_wedge",
    lambda m: pnl.cost_wedge(m.daily),
    "model n_days midpoint_loss_fraction_status",
    "mean_pnl_wedge median_pnl_wedge cumulative_pnl_wedge mean_return_wedge median_return_wedge cumulative_arithmetic_return_wedge total_mid_pnl total_exec_pnl fraction_midpoint_economic_value_lost entry_spread_contribution exit_spread_contribution entry_cost_fraction",
    """SELECT *, CASE WHEN total_mid_pnl>0 THEN cumulative_pnl_wedge/total_mid_pnl END AS fraction_midpoint_economic_value_lost,
 CASE WHEN total_mid_pnl>0 THEN 'POSITIVE_AGGREGATE_MID_PNL' ELSE 'UNDEFINED_NONPOSITIVE_AGGREGATE_MID_PNL' END AS midpoint_loss_fraction_status,
 entry_spread_contribution/(entry_spread_contribution+exit_spread_contribution) AS entry_cost_fraction FROM (SELECT model, count(*) AS n_days, avg(cost_wedge_pnl) AS mean_pnl_wedge, median(cost_wedge_pnl) AS median_pnl_wedge,
 sum(cost_wedge_pnl) AS cumulative_pnl_wedge, avg(cost_wedge_return) AS mean_return_wedge, median(cost_wedge_return) AS median_return_wedge, sum(cost_wedge_return) AS cumulative_arithmetic_return_wedge,
 sum(PnL_mid) AS total_mid_pnl, sum(PnL_exec) AS total_exec_pnl, sum(entry_spread_cost) AS entry_spread_contribution, sum(exit_spread_cost) AS exit_spread_contribution FROM daily GROUP BY 1)""",
)
_CONTRIB = (
    "model bucket n_contracts",
    "contract_share_pct pnl_mid pnl_exec pnl_mid_share_of_total pnl_exec_share_of_total entry_spread_cost exit_spread_cost",
)


def _contribution_sql(buckets: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT model, '{name}' AS bucket, count(*) FILTER ({flag}) AS n_contracts, 100e0*count(*) FILTER ({flag})/count(*) AS contract_share_pct, coalesce(sum(pnl_mid) FILTER ({flag}),0e0) AS pnl_mid,
 coalesce(sum(pnl_exec) FILTER ({flag}),0e0) AS pnl_exec, coalesce(sum(pnl_mid) FILTER ({flag}),0e0)/nullif(sum(pnl_mid),0e0) AS pnl_mid_share_of_total,
 coalesce(sum(pnl_exec) FILTER ({flag}),0e0)/nullif(sum(pnl_exec),0e0) AS pnl_exec_share_of_total, coalesce(sum(entry_spread_cost) FILTER ({flag}),0e0) AS entry_spread_cost,
 coalesce(sum(exit_spread_cost) FILTER ({flag}),0e0) AS exit_spread_cost FROM contracts GROUP BY model"""
        for name, flag in buckets.items()
    )


register(
    "quote_source_contribution",
    lambda m: pnl.contribution(m.contracts),
    *_CONTRIB,
    _contribution_sql({s: f"exit_quote_source='{s}'" for s in ("PROCESSED_1545", "RAW_1545_RECOVERED")}),
)
register(
    "quote_quality_contribution",
    lambda m: pnl.contribution(m.contracts, quality=True),
    *_CONTRIB,
    _contribution_sql(
        {
            "spread_le_10": "relative_exit_spread<=0.1e0",
            "spread_10_to_20": "relative_exit_spread>0.1e0 AND relative_exit_spread<=0.2e0",
            "spread_gt_20": "relative_exit_spread>0.2e0",
            "zero_volume_raw_recovered": "exit_quote_source='RAW_1545_RECOVERED' AND rvol=0",
            "positive_volume_chosen_quote": "exit_quote_trade_volume>0",
            "STRICT_20": "STRICT_20",
            "STRICT_10": "STRICT_10",
            "POSITIVE_VOLUME": "POSITIVE_VOLUME",
        }
    ),
)


def _corr_sql(source: str, keys: str, x: str, y: str, head: str) -> str:
    part = f"PARTITION BY {keys}"
    ranked = lambda c: f"rank() OVER ({part} ORDER BY {c})+(count(*) OVER ({part}, {c})-1)/2e0"
    return f"""SELECT {keys}, {head}, count(*) AS n_dates, CASE WHEN min({x})<max({x}) AND min({y})<max({y}) THEN corr({x},{y}) END AS pearson,
 CASE WHEN min({x})<max({x}) AND min({y})<max({y}) THEN corr(rx,ry) END AS spearman FROM (SELECT *, {ranked(x)} AS rx, {ranked(y)} AS ry FROM ({source}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys}"""


register(
    "signal_pnl_correlations",
    lambda m: pnl.signal_correlations(m.diagnostics),
    "model variable_A variable_B n_dates",
    "pearson spearman",
    " UNION ALL ".join(
        _corr_sql("SELECT * FROM diagnostics", "model", a, b, f"'{a}' AS variable_A, '{b}' AS variable_B") for a, b in pnl.SIGNAL_PAIRS
    ),
)

# ---------------------------------------------------------------- risk

_CONTROLS = (
    "model entry_date vega_balance_available vega_balance_status",
    "LongVega ShortVegaMagnitude B a_L a_S VegaImbalance hedge_quantity "
    + " ".join(f"Net{g} GrossAbs{g}" for g in _GREEKS),
)
register("entry_controls", lambda m: m.controls, *_CONTROLS, "controls")
register(
    "vega_weights",
    lambda m: risk.vega_weights(m.contracts, m.controls),
    "model entry_date contract_key vega_balance_available",
    "leg_scale w_vega",
    "SELECT c.model, c.entry_date, c.contract_key, k.vega_balance_available, CASE WHEN w>0 THEN a_L ELSE a_S END AS leg_scale, w*CASE WHEN w>0 THEN a_L ELSE a_S END AS w_vega FROM contracts c JOIN controls k USING (model, entry_date)",
    8,
)
register(
    "vega_balanced_ledger",
    lambda m: risk.vega_ledger(m.contracts, m.controls),
    "model entry_date contract_key",
    "vb_pnl_mid vb_pnl_exec vb_gross_entry_premium_mid_component vb_gross_entry_premium_exec_component",
    """SELECT c.model, c.entry_date, c.contract_key, s.vb_mid AS vb_pnl_mid, s.vb_exec AS vb_pnl_exec, s.vb_prem_mid AS vb_gross_entry_premium_mid_component, s.vb_prem_exec AS vb_gross_entry_premium_exec_component
 FROM contracts c LEFT JOIN scaled s USING (model, entry_date, contract_key)""",
    8,
)
register(
    "spot_consistency_by_day",
    lambda m: m.spots,
    "model entry_date decision_date exit_date entry_spot_valid exit_spot_valid spot_valid",
    "entry_spot_min entry_spot_max entry_spot_dispersion exit_spot_min exit_spot_max exit_spot_dispersion S_entry S_exit dS",
    "spots",
)
register(
    "spot_consistency_by_underlying",
    lambda m: risk.spot_by_underlying(m.contracts),
    "underlying_symbol date count valid",
    "min max dispersion",
    """SELECT underlying_symbol, date, count(spot) AS count, min(spot) AS min, max(spot) AS max, max(spot)-min(spot) AS dispersion, coalesce(min(spot)>0 AND max(spot)-min(spot)<=1e-8,false) AS valid FROM (
 SELECT underlying_symbol, entry_date AS date, entry_spot AS spot FROM contracts UNION ALL SELECT underlying_symbol, exit_date, exit_spot FROM contracts) GROUP BY 1,2""",
)
register(
    "greek_quality",
    lambda m: risk.greek_quality_summary(risk.greek_quality(m.contracts.drop("all_entry_greeks_finite"))),
    "model n_contracts n_invalid_vega n_invalid_delta n_implausible_gamma",
    "all_finite_pct quality_valid_pct " + " ".join(f"{g}_finite_pct {g}_recomputed_max_abs_error" for g in _GREEKS),
    "SELECT model, count(*) AS n_contracts, count(*) FILTER (NOT entry_Vega>0) AS n_invalid_vega, count(*) FILTER (abs(entry_Delta)>exp(-entry_q*entry_T)+1e-10) AS n_invalid_delta, count(*) FILTER (NOT entry_Gamma>0) AS n_implausible_gamma, 100e0 AS all_finite_pct, 100e0*count(*) FILTER (entry_Vega>0 AND entry_Gamma>0)/count(*) AS quality_valid_pct, "
    + ", ".join(f"100e0 AS {g}_finite_pct, 0e0 AS {g}_recomputed_max_abs_error" for g in _GREEKS)
    + " FROM contracts GROUP BY 1",
)
register(
    "pnl_attribution",
    lambda m: m.attribution,
    "model entry_date contract_key DGT_available DGVT_available",
    "Delta_component Gamma_component Theta_component DGT_residual Vega_component DGVT_residual dIV_exact_contract dt_years",
    "attribution",
    8,
)


def _attribution_sql(subset: bool) -> str:
    parts = ["Delta_component", "Gamma_component", "Vega_component", "Theta_component", "DGVT_residual"] if subset else [
        "Delta_component", "Gamma_component", "Theta_component", "DGT_residual"]
    flag, scope = ("DGVT_available", "EXACT_IV_DIAGNOSTIC_SUBSET") if subset else ("DGT_available", "PRIMARY_DGT")
    total = "+".join(f"abs(sum({p}) FILTER ({flag}))" for p in parts)
    rows = " UNION ALL ".join(
        f"""SELECT a.*, d.n_days, d.total_component, d.mean_daily_component, d.median_daily_component, '{p}' AS component, CASE WHEN abs(total_mid_pnl)>1e-12 THEN d.total_component/total_mid_pnl END AS signed_share_of_mid_pnl,
 abs(d.total_component)/nullif(absolute,0e0) AS absolute_aggregate_component_share FROM a JOIN (SELECT model, count(*) AS n_days, sum(x) AS total_component, avg(x) AS mean_daily_component, median(x) AS median_daily_component
 FROM (SELECT model, entry_date, sum({p}) AS x FROM attribution WHERE {flag} GROUP BY 1,2) GROUP BY 1) d USING (model)"""
        for p in parts
    )
    return f"""SELECT * FROM (WITH a AS (SELECT model, '{scope}' AS scope, count(*) FILTER ({flag}) AS n_contracts, 100e0*count(*) FILTER ({flag})/count(*) AS coverage_pct, sum(pnl_mid) FILTER ({flag}) AS total_mid_pnl,
 count(*) FILTER ({flag} AND exit_quote_source='PROCESSED_1545') AS n_processed, count(*) FILTER ({flag} AND exit_quote_source='RAW_1545_RECOVERED') AS n_raw_recovered, {total} AS absolute FROM attribution GROUP BY 1) {rows})"""


for _subset, _name in ((False, "attribution_summary"), (True, "exact_vega_attribution_summary")):
    register(
        _name,
        lambda m, s=_subset: risk.attribution_summary(m.attribution, s),
        "model scope component n_contracts n_days n_processed n_raw_recovered",
        "coverage_pct total_mid_pnl total_component mean_daily_component median_daily_component signed_share_of_mid_pnl absolute_aggregate_component_share",
        _attribution_sql(_subset),
    )
_EXPOSURE = f"""SELECT c.*, d.GrossPremium_mid, {', '.join(f'c.{x}/nullif(d.GrossPremium_mid,0e0) AS {x}_per_gross_premium' for x in risk.EXPOSURES)} FROM controls c JOIN daily d USING (model, entry_date)"""
register(
    "exposure_summary",
    lambda m: risk.exposure_summary(risk.exposures(m.controls, m.daily)),
    "model exposure n_days",
    "mean median std p05 p25 p75 p95 mean_absolute",
    " UNION ALL ".join(
        f"SELECT model, '{x}' AS exposure, count({x}) AS n_days, avg({x}) AS mean, median({x}) AS median, stddev_samp({x}) AS std, quantile_cont({x},0.05) AS p05, quantile_cont({x},0.25) AS p25, quantile_cont({x},0.75) AS p75, quantile_cont({x},0.95) AS p95, avg(abs({x})) AS mean_absolute FROM ({_EXPOSURE}) GROUP BY 1"
        for x in [*risk.EXPOSURES, "VegaImbalance", *[f"{e}_per_gross_premium" for e in risk.EXPOSURES]]
    ),
)
register(
    "vega_balance_diagnostics",
    lambda m: risk.balance_diagnostics(risk.exposures(m.controls, m.daily)),
    "model n_days n_available",
    "mean_a_L mean_a_S min_a_L min_a_S original_mean_abs_NetDelta original_mean_abs_NetVega unavailable_day_pct",
    """SELECT model, count(*) AS n_days, count(*) FILTER (vega_balance_available) AS n_available, avg(a_L) AS mean_a_L, avg(a_S) AS mean_a_S, min(a_L) AS min_a_L, min(a_S) AS min_a_S, avg(abs(NetDelta)) AS original_mean_abs_NetDelta,
 avg(abs(NetVega)) AS original_mean_abs_NetVega, 100*(1-count(*) FILTER (vega_balance_available)/count(*)) AS unavailable_day_pct FROM controls GROUP BY 1""",
)
_STATE = (
    "model entry_date decision_date exit_date portfolio_state available number_contracts",
    "PnL_mid PnL_exec GrossPremium_mid GrossPremium_exec Return_mid Return_exec PnL_underlying hedge_quantity option_NetDelta NetDelta NetGamma NetVega NetTheta",
)
register("portfolio_states", lambda m: m.states, *_STATE, "states", 7)
register(
    "exposure_reduction",
    lambda m: risk.exposure_reduction(m.states),
    "model before_state after_state greek n_common_days",
    "before_mean_abs after_mean_abs before_p95_abs after_p95_abs mean_abs_reduction_pct p95_abs_reduction_pct",
    " UNION ALL ".join(
        f"""SELECT *, CASE WHEN before_mean_abs>1e-12 THEN 100*(1-after_mean_abs/before_mean_abs) END AS mean_abs_reduction_pct, CASE WHEN before_p95_abs>1e-12 THEN 100*(1-after_p95_abs/before_p95_abs) END AS p95_abs_reduction_pct FROM (
 SELECT a.model, '{b}' AS before_state, '{a}' AS after_state, '{g}' AS greek, count(*) AS n_common_days, avg(abs(a.Net{g})) AS before_mean_abs, avg(abs(z.Net{g})) AS after_mean_abs, quantile_cont(abs(a.Net{g}),0.95) AS before_p95_abs,
 quantile_cont(abs(z.Net{g}),0.95) AS after_p95_abs FROM states a JOIN states z ON z.model=a.model AND z.entry_date=a.entry_date AND a.portfolio_state='{b}' AND z.portfolio_state='{a}' AND a.available AND z.available GROUP BY 1)"""
        for b, a, g in risk.REDUCTIONS
    ),
    5,
)
_ALIGN = """SELECT s.model, s.entry_date, s.portfolio_state, s.Return_mid, x.top_minus_bottom, x.predicted_cross_sectional_dispersion FROM states s JOIN diagnostics x USING (model, entry_date)
 SEMI JOIN (SELECT model, entry_date FROM states GROUP BY ALL HAVING count(Return_mid)=4) w ON w.model=s.model AND w.entry_date=s.entry_date"""
register(
    "signal_alignment",
    lambda m: risk.signal_alignment(m.states, m.diagnostics),
    "model portfolio_state signal n_common_dates",
    "pearson spearman",
    "SELECT *, n_dates AS n_common_dates FROM ("
    + " UNION ALL ".join(
        _corr_sql(_ALIGN, "model, portfolio_state", s, "Return_mid", f"'{s}' AS signal")
        for s in ("top_minus_bottom", "predicted_cross_sectional_dispersion")
    )
    + ")",
)
register(
    "implementation_summary",
    lambda m: reports.implementation_summary(m.signals, m.trades, m.ready, m.contracts, m.audit),
    "model evaluated_contract_rows processed_exits raw_recovered_exits trading_days selected_signals entry_mapped unique_net_contract_rows active_net_contract_rows calendar_excluded_decision_days calendar_excluded_entry_days calendar_excluded_exit_days",
    "final_exit_coverage",
    """SELECT c.*, s.selected_signals, t.entry_mapped, r.unique_net_contract_rows, r.active_net_contract_rows, a.calendar_excluded_decision_days, a.calendar_excluded_entry_days, a.calendar_excluded_exit_days
 FROM (SELECT model, count(*) AS evaluated_contract_rows, count(*) FILTER (exit_quote_source='PROCESSED_1545') AS processed_exits, count(*) FILTER (exit_quote_source='RAW_1545_RECOVERED') AS raw_recovered_exits, 1e0 AS final_exit_coverage, count(DISTINCT entry_date) AS trading_days FROM contracts GROUP BY 1) c
 JOIN (SELECT model, count(*) FILTER (selected) AS selected_signals FROM signals GROUP BY 1) s USING (model) JOIN (SELECT model, count(*) FILTER (entry_mapping_status='MAPPED') AS entry_mapped FROM trades GROUP BY 1) t USING (model)
 JOIN (SELECT model, count(*) AS unique_net_contract_rows, count(*) FILTER (nonzero_net_position) AS active_net_contract_rows FROM ready GROUP BY 1) r USING (model)
 JOIN (SELECT model, count(*) FILTER (NOT economic_calendar_eligible) AS calendar_excluded_decision_days, count(*) FILTER (NOT entry_snapshot_session) AS calendar_excluded_entry_days, count(*) FILTER (NOT exit_snapshot_session) AS calendar_excluded_exit_days FROM audit GROUP BY 1) a USING (model)""",
)
