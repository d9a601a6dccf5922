"""Calendar, features, scoring, signals, mapping and exit quotes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import calendar as cal
from ..operators import archive, checks, features, mapping, quotes, scoring, signals
from ..plans.lineage import shared_folder
from ..settings import FORECAST_MODELS, RATE_DATE
from .inputs import RULES, SPLITS, Market
from .registry import register

# ---------------------------------------------------------------- calendar

register(
    "calendar_targets",
    lambda m: cal.with_targets(m.calendar),
    "session session_no is_1545_open target_h1 target_h2",
    "dow_h1 dow_h2",
    """SELECT session, session_no, is_1545_open, next1 AS target_h1, next2 AS target_h2, isodow(next1)-1 AS dow_h1, isodow(next2)-1 AS dow_h2 FROM calendar""",
)
register(
    "snapshot_guard",
    lambda m: cal.snapshot_guard(
        m.table("orders").select(F.date_sub(F.to_date("o_orderdate"), 9862).alias("day"), "o_orderstatus"), "day", m.calendar
    )
    .groupBy("o_orderstatus", "calendar_guard_pass")
    .agg(F.count(F.lit(1)).alias("n")),
    "o_orderstatus calendar_guard_pass n",
    "",
    """SELECT o_orderstatus, coalesce(c.is_1545_open,false) AS calendar_guard_pass, count(*) AS n FROM (SELECT o_orderstatus, CAST(o_orderdate AS DATE)-9862 AS day FROM orders) o
 LEFT JOIN calendar c ON c.session=o.day GROUP BY ALL""",
)
register(
    "chronology_audit",
    lambda m: m.audit,
    "model decision_date entry_date intended_exit_date number_selected_nodes decision_session entry_snapshot_session exit_snapshot_session economic_calendar_eligible n_mapped_contracts n_active_contracts",
    "",
    "audit",
)

# ---------------------------------------------------------------- panel and features

register("session_panel", lambda m: m.panel, "quote_date node session_no", "iv_grid", "panel", 9)
register(
    "lag_features",
    lambda m: m.lagged(1),
    "quote_date node target_date",
    "lag_1 lag_2 lag_3 lag_5 lag_10 roll_mean_5 roll_std_5 dow label",
    "lagged",
    8,
)
_SPLIT = """SELECT *, coalesce({t}<=DATE '2024-02-02',false) AND {y} IS NOT NULL AS is_train,
 coalesce({t}>DATE '2024-02-02' AND {t}<=DATE '2024-02-23' AND quote_date>=DATE '2024-02-02',false) AND {y} IS NOT NULL AS is_validation,
 coalesce({t}<=DATE '2024-02-23',false) AND {y} IS NOT NULL AS is_final FROM lagged"""
for _h, _t, _y in ((1, "next1", "label"), (2, "next2", "label_h2")):
    register(
        f"split_masks_h{_h}",
        lambda m, h=_h: features.split_masks(m.lagged(h), SPLITS),
        "quote_date node is_train is_validation is_final",
        "",
        f"SELECT quote_date, node, is_train, is_validation, is_final FROM ({_SPLIT.format(t=_t, y=_y)})",
    )
register(
    "history_gate",
    lambda m: features.history_status(features.split_masks(m.lagged(1), SPLITS), SPLITS),
    "node n_train n_validation n_final train_label_max final_label_max status",
    "",
    f"""SELECT node, n_train, n_validation, n_final, train_label_max, final_label_max, CASE WHEN n_train>=10 AND n_validation>=5 THEN 'OK' ELSE 'INSUFFICIENT_HISTORICAL_LABELS' END AS status FROM (
 SELECT node, count(*) FILTER (is_train) AS n_train, count(*) FILTER (is_validation) AS n_validation, count(*) FILTER (is_final) AS n_final,
  max(next1) FILTER (is_train) AS train_label_max, max(next1) FILTER (is_final) AS final_label_max FROM ({_SPLIT.format(t='next1', y='label')}) GROUP BY node)""",
)
register("surface_regions", lambda m: features.regions(m.nodes), "node moneyness_region maturity_region", "log_moneyness T", "regions")

# ---------------------------------------------------------------- scoring

_JOURNAL = " ".join(f"available_{m}" for m in FORECAST_MODELS)
register(
    "forecast_journal",
    lambda m: m.journal,
    f"forecast_origin_date forecast_target_date node moneyness_region maturity_region target_available common_sample_4models common_sample_qlike {_JOURNAL}",
    "log_moneyness T observed_iv_at_origin actual_iv_at_target forecast_persistence forecast_arima forecast_ridge forecast_xgboost",
    "journal",
    9,
)
_METRICS = "count(*) AS n, sqrt(avg(SE)) AS RMSE, avg(AE) AS MAE, avg(QL) AS QLIKE, count(QL) AS QLIKE_n"
register("forecast_metrics", lambda m: scoring.metrics(m.common), "model n QLIKE_n", "RMSE MAE QLIKE", f"SELECT model, {_METRICS} FROM scored GROUP BY 1", 9)
register(
    "forecast_metrics_by_region",
    lambda m: scoring.metrics_by_region(m.common),
    "region_type region model n QLIKE_n",
    "RMSE MAE QLIKE",
    f"""SELECT 'moneyness_region' AS region_type, moneyness_region AS region, model, {_METRICS} FROM scored GROUP BY ALL
 UNION ALL SELECT 'maturity_region', maturity_region, model, {_METRICS} FROM scored GROUP BY ALL""",
    9,
)
register(
    "daily_losses",
    lambda m: m.daily_losses,
    "forecast_target_date model n_common n_qlike",
    "L_SE L_AE L_QLIKE sum_SE sum_AE sum_QLIKE",
    "daily_losses",
    9,
)
RANK_IC = """SELECT forecast_target_date, model, count(*) AS n_common, CASE WHEN count(*)>=10 AND min(rp)<max(rp) AND min(rr)<max(rr) THEN corr(rp,rr) END AS rank_ic,
 CASE WHEN count(*)<10 THEN 'TOO_FEW_NODES' WHEN min(rp)=max(rp) OR min(rr)=max(rr) THEN 'CONSTANT_CROSS_SECTION' ELSE 'OK' END AS status FROM (
 SELECT *, rank() OVER (PARTITION BY forecast_target_date,model ORDER BY p)+(count(*) OVER (PARTITION BY forecast_target_date,model,p)-1)/2e0 AS rp,
  rank() OVER (PARTITION BY forecast_target_date,model ORDER BY r)+(count(*) OVER (PARTITION BY forecast_target_date,model,r)-1)/2e0 AS rr
 FROM (SELECT *, forecast-observed_iv_at_origin AS p, actual_iv_at_target-observed_iv_at_origin AS r FROM scored)) GROUP BY 1,2"""
_IC = lambda m: scoring.daily_rank_ic(m.common, minimum=RULES.min_ic_nodes)
register("daily_rank_ic", _IC, "forecast_target_date model n_common status", "rank_ic", RANK_IC)
register(
    "rolling_loss",
    lambda m: scoring.rolling_mean(m.daily_losses, ["model"], "L_SE", "forecast_target_date", root=True),
    "model forecast_target_date",
    "rolling_L_SE",
    """SELECT model, forecast_target_date, CASE WHEN count(L_SE) OVER w>=10 THEN sqrt(avg(L_SE) OVER w) END AS rolling_L_SE FROM daily_losses
 WINDOW w AS (PARTITION BY model ORDER BY forecast_target_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    9,
)
register(
    "rolling_rank_ic",
    lambda m: scoring.rolling_mean(_IC(m), ["model"], "rank_ic", "forecast_target_date"),
    "model forecast_target_date",
    "rolling_rank_ic",
    f"""SELECT model, forecast_target_date, CASE WHEN count(rank_ic) OVER w>=10 THEN avg(rank_ic) OVER w END AS rolling_rank_ic FROM ({RANK_IC})
 WINDOW w AS (PARTITION BY model ORDER BY forecast_target_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
register(
    "cumulative_loss_gap",
    lambda m: scoring.cumulative_loss_gap(m.daily_losses, "L_AE"),
    "model forecast_target_date",
    "cumulative_gap",
    """SELECT a.model, a.forecast_target_date, sum(a.L_AE-b.L_AE) OVER (PARTITION BY a.model ORDER BY a.forecast_target_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_gap
 FROM daily_losses a JOIN daily_losses b ON b.forecast_target_date=a.forecast_target_date AND b.model='persistence' WHERE a.model<>'persistence'""",
    9,
)

# ---------------------------------------------------------------- signals

register(
    "economic_candidates",
    lambda m: m.economic,
    "decision_date entry_date intended_exit_date node common_economic_candidate",
    "actual_iv_entry actual_iv_exit actual_holding_change",
    "economic",
    9,
)
register(
    "candidate_counts",
    lambda m: signals.candidate_counts(m.economic),
    "decision_date n_common_candidates",
    "",
    "SELECT decision_date, count(*) FILTER (common_economic_candidate) AS n_common_candidates FROM economic GROUP BY 1",
)
register(
    "signal_selection",
    lambda m: m.signals,
    "model decision_date entry_date intended_exit_date node common_economic_candidate selection_rank selected signal",
    "raw_signal z_score",
    "signals",
    8,
)
_SIGNAL_DAILY = (
    "model decision_date n_common_candidates n_scored_nodes n_selected_long n_selected_short n_scored_long n_scored_short",
    "long_mean_change short_mean_change top_minus_bottom long_hit_rate short_hit_rate balanced_hit_rate rank_ic",
)
register("signal_diagnostics_daily", lambda m: m.signal_daily, *_SIGNAL_DAILY, "signal_daily", 8)

# ---------------------------------------------------------------- mapping and netting

register(
    "entry_mapping",
    lambda m: m.trades,
    "model decision_date entry_date node signal entry_mapping_status entry_weight_status contract_key",
    "mapping_distance weight_at_entry entry_bid entry_ask entry_spot entry_T entry_log_moneyness",
    "trades",
)
register(
    "entry_greeks",
    lambda m: m.trades.where("contract_key IS NOT NULL"),
    "model entry_date node contract_key",
    "entry_Delta entry_Gamma entry_Vega entry_Theta",
    "SELECT * FROM trades WHERE contract_key IS NOT NULL",
)
register(
    "netted_contracts",
    lambda m: m.net,
    "model entry_date contract_key n_mapped_nodes mapped_nodes opposing_signals nonzero_net_position net_signal netting_status",
    "weight_at_entry node_gross_weight",
    "net",
    9,
)
register(
    "mapping_collisions",
    lambda m: signals.collisions(m.trades, m.net),
    "model entry_date selected_nodes entry_mapped_nodes unique_mapped_contracts duplicated_mappings max_nodes_one_contract contracts_receiving_both_signals active_net_contracts",
    "collision_rate gross_weight_before_netting net_signed_weight gross_weight_after_netting",
    """SELECT t.*, coalesce(u,0) AS unique_mapped_contracts, entry_mapped_nodes-coalesce(u,0) AS duplicated_mappings, (entry_mapped_nodes-coalesce(u,0))/nullif(CAST(entry_mapped_nodes AS DOUBLE),0e0) AS collision_rate,
 coalesce(mx,0) AS max_nodes_one_contract, coalesce(b,0) AS contracts_receiving_both_signals, coalesce(sw,0e0) AS net_signed_weight, coalesce(gw,0e0) AS gross_weight_after_netting, coalesce(ac,0) AS active_net_contracts
 FROM (SELECT model, entry_date, count(*) AS selected_nodes, count(*) FILTER (weight_at_entry<>0) AS entry_mapped_nodes, coalesce(sum(abs(weight_at_entry)),0e0) AS gross_weight_before_netting FROM trades GROUP BY ALL) t
 LEFT JOIN (SELECT model, entry_date, count(*) AS u, max(n_mapped_nodes) AS mx, count(*) FILTER (opposing_signals) AS b, sum(weight_at_entry) AS sw, sum(abs(weight_at_entry)) AS gw,
  count(*) FILTER (nonzero_net_position) AS ac FROM net GROUP BY ALL) n USING (model, entry_date)""",
    9,
)

# ---------------------------------------------------------------- exit quotes

register("required_exit_pairs", lambda m: m.required, "intended_exit_date contract_key", "", "required")
register(
    "processed_exit_pairs",
    lambda m: m.processed,
    "quote_date contract_key source_observation_count",
    "bid ask implied_vol",
    "processed",
)
register(
    "absent_exit_pairs",
    lambda m: quotes.absent_pairs(m.required, m.processed),
    "intended_exit_date contract_key",
    "",
    "SELECT r.* FROM required r ANTI JOIN processed p ON p.quote_date=r.intended_exit_date AND p.contract_key=r.contract_key",
)
register(
    "raw_recovery",
    lambda m: m.recovered,
    "quote_date contract_key source_observation_count observable_failure_reasons",
    "bid_1545 ask_1545 mid spot trade_volume open_interest",
    "recovered",
)


def _archive_recovery(m: Market):
    path = shared_folder(m.spark, "quote-archive")
    archive.write_archive(m.raw_quotes, path)
    return archive.recover(m.spark, path, quotes.absent_pairs(m.required, m.processed), m.rates)


register(
    "archive_recovery",
    _archive_recovery,
    "quote_date contract_key source_observation_count observable_failure_reasons",
    "bid_1545 ask_1545 mid spot trade_volume open_interest",
    "recovered",
)
register(
    "exit_quote_choice",
    lambda m: m.exit_quotes,
    "intended_exit_date contract_key exit_quote_source BASE STRICT_20 STRICT_10 POSITIVE_VOLUME processed_valid raw_valid calendar_guard_pass zero_volume_flag zero_open_interest_flag recovery_reason_category",
    "exit_bid exit_ask exit_mid relative_spread exit_quote_trade_volume",
    "exit_quotes",
)
register(
    "exit_attachment",
    lambda m: m.ready,
    "model entry_date intended_exit_date contract_key netting_status exit_quote_source BASE",
    "weight_at_entry entry_bid entry_ask exit_bid exit_ask exit_spot",
    "ready",
    8,
)
register(
    "exit_coverage",
    lambda m: quotes.coverage(m.ready),
    "model entered_active_net_contracts processed_valid_exits raw_additional_recovered_exits total_valid_BASE_exits remaining_missing STRICT_20_valid_exits STRICT_10_valid_exits POSITIVE_VOLUME_valid_exits",
    "processed_only_coverage_pct BASE_coverage_pct remaining_missing_pct STRICT_20_coverage_pct STRICT_10_coverage_pct POSITIVE_VOLUME_coverage_pct recovered_zero_volume_pct recovered_nonpositive_volume_only_pct",
    """SELECT model, count(*) AS entered_active_net_contracts, count(*) FILTER (exit_quote_source='PROCESSED_1545') AS processed_valid_exits, count(*) FILTER (exit_quote_source='RAW_1545_RECOVERED') AS raw_additional_recovered_exits,
 count(*) FILTER (BASE) AS total_valid_BASE_exits, count(*) FILTER (NOT BASE) AS remaining_missing, count(*) FILTER (STRICT_20) AS STRICT_20_valid_exits, count(*) FILTER (STRICT_10) AS STRICT_10_valid_exits,
 count(*) FILTER (POSITIVE_VOLUME) AS POSITIVE_VOLUME_valid_exits, 100e0*count(*) FILTER (exit_quote_source='PROCESSED_1545')/count(*) AS processed_only_coverage_pct, 100e0*count(*) FILTER (BASE)/count(*) AS BASE_coverage_pct,
 100e0*count(*) FILTER (NOT BASE)/count(*) AS remaining_missing_pct, 100e0*count(*) FILTER (STRICT_20)/count(*) AS STRICT_20_coverage_pct, 100e0*count(*) FILTER (STRICT_10)/count(*) AS STRICT_10_coverage_pct,
 100e0*count(*) FILTER (POSITIVE_VOLUME)/count(*) AS POSITIVE_VOLUME_coverage_pct,
 100e0*count(*) FILTER (exit_quote_source='RAW_1545_RECOVERED' AND zero_volume_flag)/nullif(count(*) FILTER (exit_quote_source='RAW_1545_RECOVERED'),0) AS recovered_zero_volume_pct,
 100e0*count(*) FILTER (exit_quote_source='RAW_1545_RECOVERED' AND recovery_reason_category='NONPOSITIVE_VOLUME_ONLY')/nullif(count(*) FILTER (exit_quote_source='RAW_1545_RECOVERED'),0) AS recovered_nonpositive_volume_only_pct
 FROM ready WHERE nonzero_net_position GROUP BY 1""",
)
_LEVELS = "SELECT 'unique_required_pairs' AS level, 'ALL' AS model, exit_quote_source, relative_spread, rvol, zero_volume_flag, zero_open_interest_flag, calendar_guard_pass, recovery_reason_category FROM exit_quotes UNION ALL SELECT 'active_net_contracts', model, exit_quote_source, relative_spread, rvol, zero_volume_flag, zero_open_interest_flag, calendar_guard_pass, recovery_reason_category FROM ready WHERE nonzero_net_position"
from ..functions.text import REASON_CATEGORIES  # noqa: E402

register(
    "recovery_reasons",
    lambda m: quotes.recovery_reasons(m.exit_quotes, m.ready),
    "level model category count n_recovered",
    "percent",
    f"""SELECT l.level, l.model, c.category, count(*) FILTER (r.recovery_reason_category=c.category) AS count, count(r.level) AS n_recovered,
 100e0*count(*) FILTER (r.recovery_reason_category=c.category)/nullif(count(r.level),0) AS percent
 FROM (SELECT DISTINCT level, model FROM ({_LEVELS})) l CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in REASON_CATEGORIES)}) c(category)
 LEFT JOIN (SELECT * FROM ({_LEVELS}) WHERE exit_quote_source='RAW_1545_RECOVERED') r ON r.level=l.level AND r.model=l.model GROUP BY 1,2,3""",
)
register(
    "quote_quality",
    lambda m: quotes.quote_quality(m.exit_quotes, m.ready),
    "level model source n n_spread_gt_20 n_spread_gt_10 n_raw_volume_observed n_raw_zero_volume n_raw_zero_OI n_calendar_rejected",
    "mean_relative_spread median_relative_spread q90_relative_spread max_relative_spread",
    f"""SELECT l.level, l.model, s.source, count(r.level) AS n, count(*) FILTER (relative_spread>0.2e0) AS n_spread_gt_20, count(*) FILTER (relative_spread>0.1e0) AS n_spread_gt_10, count(rvol) AS n_raw_volume_observed,
 count(*) FILTER (zero_volume_flag) AS n_raw_zero_volume, count(*) FILTER (zero_open_interest_flag) AS n_raw_zero_OI, count(*) FILTER (NOT calendar_guard_pass) AS n_calendar_rejected,
 avg(relative_spread) AS mean_relative_spread, median(relative_spread) AS median_relative_spread, quantile_cont(relative_spread,0.9) AS q90_relative_spread, max(relative_spread) AS max_relative_spread
 FROM (SELECT DISTINCT level, model FROM ({_LEVELS})) l CROSS JOIN (VALUES ('PROCESSED_1545'),('RAW_1545_RECOVERED'),('NO_VALID_1545_QUOTE')) s(source)
 LEFT JOIN ({_LEVELS}) r ON r.level=l.level AND r.model=l.model AND r.exit_quote_source=s.source GROUP BY 1,2,3""",
)
_DIMS = {
    "model": "model",
    "side": "CASE WHEN net_signal>0 THEN 'LONG' ELSE 'SHORT' END",
    "option_type": "option_type",
    "maturity_tercile": "CASE WHEN entry_T<={a} THEN 'short' WHEN entry_T<={b} THEN 'medium' ELSE 'long' END".format(
        a=repr(0.08 + 6 * ((1.0 - 0.08) / 19)) + "e0", b=repr(0.08 + 13 * ((1.0 - 0.08) / 19)) + "e0"
    ),
    "moneyness_tercile": "CASE WHEN entry_log_moneyness<={a} THEN 'lower' WHEN entry_log_moneyness<={b} THEN 'central' ELSE 'upper' END".format(
        a=repr(-0.22 + 8 * ((0.18 - -0.22) / 24)) + "e0", b=repr(-0.22 + 16 * ((0.18 - -0.22) / 24)) + "e0"
    ),
    "year_month": "strftime(intended_exit_date,'%Y-%m')",
}
register(
    "exit_missingness",
    lambda m: quotes.missingness(m.ready, features_grid()),
    "model dimension bucket n_active n_processed n_raw_recovered n_remaining_missing",
    "raw_recovery_pct remaining_missing_pct BASE_coverage_pct",
    " UNION ALL ".join(
        f"""SELECT model, '{d}' AS dimension, {x} AS bucket, count(*) AS n_active, count(*) FILTER (processed_valid) AS n_processed, count(*) FILTER (exit_quote_source='RAW_1545_RECOVERED') AS n_raw_recovered,
 count(*) FILTER (NOT BASE) AS n_remaining_missing, 100e0*count(*) FILTER (exit_quote_source='RAW_1545_RECOVERED')/count(*) AS raw_recovery_pct, 100e0*count(*) FILTER (NOT BASE)/count(*) AS remaining_missing_pct,
 100e0*count(*) FILTER (BASE)/count(*) AS BASE_coverage_pct FROM ready WHERE nonzero_net_position GROUP BY ALL"""
        for d, x in _DIMS.items()
    ),
)


def features_grid():
    from .inputs import GRID

    return GRID


# ---------------------------------------------------------------- joins with guards

register(
    "validated_join",
    lambda m: checks.validated_join(
        m.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        m.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"),
        ["o_custkey"],
        "inner",
        "many_to_one",
    )
    .groupBy("c_mktsegment")
    .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")),
    "c_mktsegment n",
    "total",
    "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1",
    2,
)
register(
    "duplicate_contract_rows",
    lambda m: checks.duplicate_keys(m.iv_quotes, ["quote_date", "root", "expiration", "strike", "option_type"]),
    "quote_date root expiration option_type n",
    "strike",
    "SELECT quote_date, root, expiration, option_type, strike, count(*) AS n FROM clean GROUP BY ALL HAVING count(*)>1",
)
