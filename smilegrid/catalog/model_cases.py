"""Forecast models, triangulated surfaces and streaming: invariants and row checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import delaunay, features, models, surface
from .inputs import GRID, SPLITS, Market
from .quotes_cases import _DAYS, _LOCATIONS, _TS, _XS
from .registry import register


def _masked(m: Market, horizon: int = 1):
    return features.split_masks(m.lagged(horizon), SPLITS)


register(
    "persistence_forecast",
    lambda m: models.persistence(m.lagged(1)),
    "node quote_date target_date",
    "forecast",
    "SELECT node, quote_date, target_date, lag_1 AS forecast FROM lagged",
    9,
)
register(
    "ar1_coefficients",
    lambda m: models.ar1_coefficients(m.panel, SPLITS.fit_end),
    "node n_pairs",
    "phi",
    "SELECT node, count(*) AS n_pairs, sum(iv_grid*lag_2)/nullif(sum(lag_2*lag_2),0e0) AS phi FROM lagged WHERE quote_date<=DATE '2024-02-23' AND iv_grid IS NOT NULL AND lag_2 IS NOT NULL GROUP BY 1",
    8,
)


def _selection(m: Market, rule: str):
    """Three smoothing candidates per node, chosen on the validation rows."""
    f = _masked(m).where("is_validation AND lag_1 IS NOT NULL AND roll_mean_5 IS NOT NULL")
    mixes = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(str(i)).alias("candidate"), F.lit(w).alias("w")) for i, w in enumerate((1.0, 0.5, 0.0))])
    rows = f.select("node", "label", "lag_1", "roll_mean_5", F.inline(mixes))
    rows = rows.withColumn("prediction", F.col("w") * F.col("lag_1") + (1 - F.col("w")) * F.col("roll_mean_5"))
    return models.select_candidate(models.validation_losses(rows, ["node", "position", "candidate"]), ["node"], rule)


_TRIALS = " UNION ALL ".join(
    f"SELECT node, {i} AS position, '{i}' AS candidate, sqrt(avg(pow({w}*lag_1+(1-{w})*roll_mean_5-label,2))) AS rmse, avg(abs({w}*lag_1+(1-{w})*roll_mean_5-label)) AS mae FROM v GROUP BY node"
    for i, w in enumerate(("1e0", "0.5e0", "0e0"))
)
_VALID = "SELECT * FROM lagged WHERE next1>DATE '2024-02-02' AND next1<=DATE '2024-02-23' AND quote_date>=DATE '2024-02-02' AND label IS NOT NULL AND lag_1 IS NOT NULL AND roll_mean_5 IS NOT NULL"
register(
    "candidate_selection",
    lambda m: _selection(m, "lexicographic"),
    "node candidate position",
    "rmse mae",
    f"SELECT * FROM (WITH v AS ({_VALID}), t AS ({_TRIALS}) SELECT node, arg_min(candidate, {{'a': round(rmse,14), 'b': round(mae,14), 'c': position}}) AS candidate, arg_min(position, {{'a': round(rmse,14), 'b': round(mae,14), 'c': position}}) AS position, min(rmse) AS rmse, arg_min(mae, {{'a': round(rmse,14), 'b': round(mae,14), 'c': position}}) AS mae FROM t GROUP BY node)",
    8,
)
_near = lambda a, b: f"({a}.rmse<{b}.rmse OR (abs({a}.rmse-{b}.rmse)<=1e-12+1e-5*abs({b}.rmse) AND {a}.mae<{b}.mae))"
register(
    "candidate_selection_near_tie",
    lambda m: _selection(m, "near_tie"),
    "node candidate position",
    "rmse mae",
    f"""SELECT * FROM (WITH v AS ({_VALID}), t AS ({_TRIALS}), s1 AS (SELECT a.node, CASE WHEN {_near('b', 'a')} THEN b ELSE a END AS w FROM (SELECT * FROM t WHERE position=0) a JOIN (SELECT * FROM t WHERE position=1) b USING (node)),
 s2 AS (SELECT s1.node, CASE WHEN (c.rmse<s1.w.rmse OR (abs(c.rmse-s1.w.rmse)<=1e-12+1e-5*abs(s1.w.rmse) AND c.mae<s1.w.mae)) THEN c ELSE s1.w END AS w FROM s1 JOIN (SELECT * FROM t WHERE position=2) c USING (node))
 SELECT node, w.candidate AS candidate, w.position AS position, w.rmse AS rmse, w.mae AS mae FROM s2)""",
    8,
)


def _ridge_one_feature(m: Market):
    """Ridge fits satisfy their normal equations: the residual moment of every
    standardised feature equals the penalty times its coefficient."""
    rows = _masked(m).where("is_final")
    fits = models.ridge_fits(rows, (0.1, 10.0))
    kept = fits.select("node", "candidate", *[F.col(c).alias("_" + c) for c in ("median", "mean", "scale", "coef")])
    scored = models.ridge_predict(rows.select("node", "label", *features.FEATURES), fits.drop("position").withColumn("pen", F.col("candidate")))
    scored = scored.join(kept, ["node", "candidate"]).withColumn("r", F.col("label") - F.col("prediction"))
    gaps, n = [], len(features.FEATURES)
    for i, name in enumerate(features.FEATURES):
        x = N.finite_or_null(name)
        for j, v in ((i, F.coalesce(x, F.col("_median")[i])), (i + n, x.isNull().cast("double"))):
            moment = F.sum((v - F.col("_mean")[j]) / F.col("_scale")[j] * F.col("r"))
            gaps.append(F.abs(moment - F.first(F.col("pen").cast("double") * F.col("_coef")[j])))
    return scored.groupBy("node", "pen").agg(
        F.count(F.lit(1)).alias("n_fit"),
        (F.abs(F.sum("r")) < 1e-9).alias("centred"),
        (F.greatest(*gaps) < 1e-9).alias("balanced"),
        (F.max(F.aggregate("_coef", F.lit(0.0), lambda a, c: a + F.abs(c))) > 0).alias("moved"),
    )


register(
    "ridge_fit_invariants",
    _ridge_one_feature,
    "node n_fit centred balanced moved",
    "pen",
    "SELECT node, n AS n_fit, true AS centred, true AS balanced, n>1 AS moved, unnest([0.1e0,10e0]) AS pen FROM (SELECT node, count(*) AS n FROM lagged WHERE next1<=DATE '2024-02-23' AND label IS NOT NULL GROUP BY 1)",
)
_GATE = """SELECT l.node, l.quote_date, l.target_date, CASE WHEN g.tr>=10 AND g.va>=5 THEN 'OK' ELSE 'INSUFFICIENT_HISTORICAL_LABELS' END AS status FROM lagged l JOIN (
 SELECT node, count(*) FILTER (next1<=DATE '2024-02-02' AND label IS NOT NULL) AS tr, count(*) FILTER (next1>DATE '2024-02-02' AND next1<=DATE '2024-02-23' AND quote_date>=DATE '2024-02-02' AND label IS NOT NULL) AS va FROM lagged GROUP BY 1) g USING (node)"""
register(
    "ridge_forecast_gate",
    lambda m: models.ridge_forecast(_masked(m), SPLITS).withColumn("has_forecast", F.col("forecast").isNotNull()),
    "node quote_date target_date status has_forecast",
    "",
    f"SELECT *, status='OK' AS has_forecast FROM ({_GATE})",
)
for _h in (1, 2):
    register(f"ridge_forecast_h{_h}", lambda m, h=_h: models.ridge_forecast(_masked(m, h), SPLITS), "node quote_date status", "forecast")
    register(f"arma_forecast_h{_h}", lambda m, h=_h: models.arma_forecast(m.panel, SPLITS, h), "node quote_date candidate status", "forecast")
for _h, _name in ((1, "boosted_forecast"), (2, "boosted_forecast_h2")):
    register(
        _name,
        lambda m, h=_h: models.boosted_forecast(_masked(m, h), SPLITS, configs=models.BOOST_CONFIGS),
        "node quote_date status candidate",
        "forecast",
    )


def _tilted(m: Market):
    """A plane over all quoted locations must come back exactly."""
    return m.locations.withColumn("implied_vol", 0.3 + 0.2 * F.col("log_moneyness") - 0.1 * F.col("T"))


# A node lies in the hull of a day's locations if it is between the hull's least and greatest log-moneyness
# at its maturity; these are reached between two observed maturities.
_HULL = f"""WITH ends AS (SELECT p.quote_date, p.t, min(p.x) AS lo, max(p.x) AS hi FROM ({_LOCATIONS}) p
 JOIN (SELECT quote_date FROM ({_DAYS}) WHERE n_obs_unique>=10) d USING (quote_date) GROUP BY ALL),
 chords AS (SELECT a.quote_date, g.t, CASE WHEN a.t=b.t THEN 0 ELSE (g.t-a.t)/(b.t-a.t) END AS w, a.lo AS alo, b.lo AS blo, a.hi AS ahi, b.hi AS bhi
  FROM ends a JOIN ends b ON a.quote_date=b.quote_date AND a.t<=b.t JOIN {_TS} g ON g.t BETWEEN a.t AND b.t),
 hull AS (SELECT quote_date, t, min(alo+w*(blo-alo)) AS lo, max(ahi+w*(bhi-ahi)) AS hi FROM chords GROUP BY ALL)
 SELECT d.quote_date, coalesce(n.nodes,0) AS nodes, 0 AS violations FROM (SELECT quote_date FROM ({_DAYS}) WHERE n_obs_unique>=10) d
 LEFT JOIN (SELECT h.quote_date, count(*) AS nodes FROM hull h CROSS JOIN {_XS} x WHERE x.x BETWEEN h.lo-1e-9 AND h.hi+1e-9 GROUP BY ALL) n USING (quote_date)"""


def _plane_check(m: Market, method: str = "delaunay"):
    nodes = surface.build_surface(_tilted(m), method=method)
    truth = 0.3 + 0.2 * F.col("log_moneyness") - 0.1 * F.col("T")
    return nodes.groupBy("quote_date").agg(
        F.count("iv_grid").alias("nodes"), F.count_if(F.abs(F.col("iv_grid") - truth) > 1e-9).alias("violations")
    )


register(
    "delaunay_plane_reproduction",
    _plane_check,
    "quote_date nodes violations",
    "",
    _HULL,
)
register(
    "delaunay_surface",
    lambda m: surface.build_surface(m.locations, method="delaunay"),
    "quote_date node",
    "iv_grid",
)
register(
    "cubic_plane_reproduction",
    lambda m: _plane_check(m, "cubic"),
    "quote_date nodes violations",
    "",
    _HULL,
)
register(
    "cubic_surface",
    lambda m: surface.build_surface(m.locations, method="cubic"),
    "quote_date node",
    "iv_grid",
)


def _write_deliveries(quotes, path: str) -> int:
    """Append quotes as files, at least four and as many as the quotes have parts, so no task's share grows with them.
    Returns the number of files under the path."""
    from ..sources.tables import spread

    spread(quotes, 4).write.mode("append").parquet(path)
    return len(quotes.sparkSession.read.parquet(path).inputFiles())


def _streamed_days(m: Market):
    """Two deliveries: quotes up to February, then the others with the last week of the first sent again."""
    from ..functions.text import lenient_date
    from ..plans.lineage import shared_folder
    from ..streaming import cleaning as stream
    from ..streaming import events

    folder = shared_folder(m.spark, "dated-stream")
    day = lenient_date("quote_date")
    for kept in (day < "2024-03-01", (day >= "2024-02-26") | day.isNull()):
        _write_deliveries(m.raw_quotes.where(kept), f"{folder}/in")
        events.write_daily_counts(stream.quote_stream(m.spark, f"{folder}/in", "parquet"), m.rates, f"{folder}/out").awaitTermination()
    return events.closed_days(m.spark, f"{folder}/out")


register(
    "streamed_daily_counts",
    _streamed_days,
    "quote_date outcome n",
    "",
    """SELECT quote_date, outcome, count(*) AS n FROM (SELECT DISTINCT quote_date, coalesce(first_fail,'kept') AS outcome, root, expiration, strike, option_type, trade_volume, open_interest,
 bid_1545, ask_1545, underlying_bid_1545, underlying_ask_1545 FROM flagged) WHERE quote_date <= (SELECT max(quote_date) FROM flagged) - 5 GROUP BY ALL""",
)


def _streamed(m: Market):
    from ..plans.lineage import shared_folder
    from ..streaming import cleaning as stream

    folder = shared_folder(m.spark, "quote-stream")
    files = _write_deliveries(m.raw_quotes, f"{folder}/in")
    quotes = stream.quote_stream(m.spark, f"{folder}/in", "parquet", files_per_batch=-(-files // 2))
    stream.clean_stream(quotes, m.rates, f"{folder}/out").awaitTermination()
    return stream.total_counts(m.spark, f"{folder}/out")


_DROPPED = ("basic", "bad_dates", "t_window", "no_rates", "moneyness", "spread", "option_type", "lower_bound")
register(
    "streamed_cleaning_counts",
    _streamed,
    "input kept_basic " + " ".join("dropped_" + d for d in _DROPPED),
    "",
    "SELECT count(*) AS input, count(*) FILTER (first_fail IS NULL) AS kept_basic, "
    + ", ".join(f"count(*) FILTER (first_fail='{d}') AS dropped_{d}" for d in _DROPPED)
    + " FROM flagged",
)
