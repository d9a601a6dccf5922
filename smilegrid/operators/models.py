"""Forecast models per grid node: ridge, ARMA family, boosted trees, selection.

Kernels run once per node on that node's history, which the calendar bounds to
one row per session. Everything around them (medians, masks, scoring,
validation losses, selection) is plain DataFrame work.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..settings import ARMA_ORDERS, RIDGE_PENALTIES, Splits
from . import arma, boosting
from .features import FEATURES, history_status

DAY = "quote_date"


def persistence(features: DataFrame) -> DataFrame:
    """The origin's own value is the forecast."""
    return features.select("node", DAY, "target_date", F.col("lag_1").alias("forecast"))


def by_node(rows: DataFrame):
    """Rows grouped by node, nodes dealt to as many tasks as shuffles have: a fit costs far more
    than its rows weigh, so partitions must not be merged for being small."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "node").groupBy("node")


# ------------------------------------------------------------------ selection


def validation_losses(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE and MAE of each candidate over its validation rows; a missing prediction
    makes both infinite, so such a candidate cannot win."""
    error = F.col("prediction") - F.col("label")
    broken = F.count_if(~N.finite("prediction")) > 0
    return predicted.groupBy(*keys).agg(
        F.when(broken, F.lit(float("inf"))).otherwise(F.sqrt(F.avg(error * error))).alias("rmse"),
        F.when(broken, F.lit(float("inf"))).otherwise(F.avg(F.abs(error))).alias("mae"),
        F.count(F.lit(1)).alias("n_validation"),
    )


def select_candidate(losses: DataFrame, keys: list[str], rule: str = "lexicographic") -> DataFrame:
    """The winning candidate per key; `losses` has candidate, position, rmse, mae.

    `lexicographic`: least (rmse, mae), earlier position on a tie. `near_tie`:
    walk the candidates in order and move to a later one if its rmse is smaller,
    or equal within a relative 1e-5 with a smaller mae.
    """
    usable = losses.where(N.finite("rmse"))
    if rule == "lexicographic":
        best = usable.groupBy(*keys).agg(F.min(F.struct("rmse", "mae", "position", "candidate")).alias("b"))
        return best.select(*keys, "b.candidate", "b.position", "b.rmse", "b.mae")
    # A handful of candidates per key, so the ordered list stays short.
    walk = usable.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("position", "rmse", "mae", "candidate"))).alias("_c")
    )

    def better(best, c):
        near = F.abs(c["rmse"] - best["rmse"]) <= 1e-12 + 1e-5 * F.abs(best["rmse"])
        return F.when((c["rmse"] < best["rmse"]) | (near & (c["mae"] < best["mae"])), c).otherwise(best)

    best = F.aggregate(F.slice("_c", 2, F.size("_c")), F.element_at("_c", 1), better)
    return walk.select(*keys, best.alias("b")).select(*keys, "b.candidate", "b.position", "b.rmse", "b.mae")


# ------------------------------------------------------------------ ridge

_RIDGE_FIT = "node string, position int, candidate double, median array<double>, mean array<double>, scale array<double>, coef array<double>, intercept double, n_fit int"


_RIDGE_SUMS = "node string, median array<double>, middle double, sums array<double>"


def ridge_moments(rows: DataFrame) -> DataFrame:
    """(node, median, middle, sums): what a ridge fit needs of a node's rows; a node has a row per task and batch that held any.

    The variables are a 1, the features less their medians (0 where missing), the missing-indicators, and the label
    less its own median. `sums` holds the sums of the products of each two of them, i <= j, row by row, so
    the width is fixed and rows of one node add up.
    """
    known = rows.select("node", F.col("label").cast("double").alias("label"), *[N.finite_or_null(f).cast("double").alias(f) for f in FEATURES])
    medians = known.groupBy("node").agg(
        F.array(*[F.coalesce(F.median(f), F.lit(0.0)) for f in FEATURES]).alias("median"), F.median("label").alias("middle")
    )

    def add_up(batches):
        for pdf in batches:
            pdf = pdf.sort_values("node", kind="stable")
            if not len(pdf):
                continue
            raw, median, middle = pdf[FEATURES].to_numpy(dtype=float, na_value=np.nan), np.stack(pdf["median"]), pdf["middle"].to_numpy(dtype=float)
            gone = np.isnan(raw)
            v = np.column_stack([np.ones(len(pdf)), np.where(gone, 0.0, raw - median), gone, pdf["label"].to_numpy(dtype=float) - middle])
            i, j = np.triu_indices(v.shape[1])
            node = pdf["node"].to_numpy()
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            sums = np.add.reduceat(v[:, i] * v[:, j], first, axis=0)
            yield pd.DataFrame({"node": node[first], "median": list(median[first]), "middle": middle[first], "sums": list(sums)})

    return known.join(medians, "node").mapInPandas(add_up, _RIDGE_SUMS)


def ridge_fits(rows: DataFrame, penalties=RIDGE_PENALTIES) -> DataFrame:
    """One fit per node and penalty from the given (already masked) rows: median imputation with
    missing-indicators, standardisation, closed-form solve.

    Rows are summed where they are; only sums of products meet by node, and one
    eigendecomposition serves all penalties.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        median, middle = np.asarray(pdf["median"].iloc[0], float), float(pdf["middle"].iloc[0])
        width = 2 + 2 * len(FEATURES)
        products = np.zeros((width, width))
        products[np.triu_indices(width)] = np.stack(pdf["sums"]).sum(axis=0)
        products += np.triu(products, 1).T
        n, sums = products[0, 0], products[0, 1:]
        spread = products[1:, 1:] - np.outer(sums, sums) / n
        scale = np.sqrt(np.maximum(np.diag(spread)[:-1], 0.0) / n)
        scale[scale < 1e-14] = 1.0
        mean = sums[:-1] / n
        mean[: len(median)] += median
        values, vectors = np.linalg.eigh(spread[:-1, :-1] / np.outer(scale, scale))
        turned = vectors.T @ (spread[:-1, -1] / scale)
        out = []
        for position, penalty in enumerate(penalties):
            coef = vectors @ (turned / (np.maximum(values, 0.0) + penalty))
            out.append((pdf["node"].iloc[0], position, float(penalty), median, mean, scale, coef, float(middle + sums[-1] / n), int(n)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _RIDGE_FIT.split(", ")])

    return ridge_moments(rows).groupBy("node").applyInPandas(solve, _RIDGE_FIT)


def ridge_predict(features: DataFrame, fits: DataFrame) -> DataFrame:
    """Score features against per-node fits as a joined dot product."""
    value = F.col("intercept")
    for i, name in enumerate(FEATURES):
        x = N.finite_or_null(name)
        for j, v in ((i, F.coalesce(x, F.col("median")[i])), (i + len(FEATURES), x.isNull().cast("double"))):
            value = value + F.col("coef")[j] * (v - F.col("mean")[j]) / F.col("scale")[j]
    joined = features.join(fits, "node")
    return joined.withColumn("prediction", value).drop("median", "mean", "scale", "coef", "intercept", "n_fit")


def ridge_forecast(masked: DataFrame, splits: Splits = Splits(), penalties=RIDGE_PENALTIES) -> DataFrame:
    """Choose the penalty on the validation rows, refit on all historical labels and
    forecast every origin; nodes with too little history get NULL and a status."""
    status = history_status(masked, splits).select("node", "status")
    enough = status.where("status = 'OK'").select("node")
    train = masked.where("is_train").join(enough, "node", "left_semi")
    trial = ridge_predict(masked.where("is_validation").select("node", "label", *FEATURES), ridge_fits(train, penalties))
    best = select_candidate(validation_losses(trial, ["node", "position", "candidate"]), ["node"])
    final = masked.where("is_final").join(enough, "node", "left_semi")
    fitted = ridge_fits(final, penalties).join(best.select("node", "position"), ["node", "position"], "left_semi")
    predicted = ridge_predict(masked.select("node", DAY, *FEATURES), fitted).select("node", DAY, "candidate", F.col("prediction").alias("forecast"))
    origins = masked.select("node", DAY, "target_date").join(status, "node")
    return origins.join(predicted, ["node", DAY], "left")


# ------------------------------------------------------------------ ARMA family

_ARMA_LOSS = "node string, position int, candidate string, status string, rmse double, mae double"
_ARMA_FORECAST = "node string, quote_date date, candidate string, status string, forecast double"


#: Series that are fitted together.
TOGETHER = 256


def _together(panel: DataFrame, *more: str) -> DataFrame:
    """The panel's rows with a group of at most about TOGETHER nodes each, and as many groups as shuffles have tasks."""
    tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = panel.select("node").distinct().count()
    groups = max(tasks, -(-nodes // TOGETHER))
    return panel.select("node", DAY, "iv_grid", *more).withColumn("_group", F.pmod(F.xxhash64("node"), F.lit(groups))).repartition(groups, "_group")


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Nodes, days and the values of a dense panel, one row per node."""
    wide = pdf.pivot(index="node", columns=DAY, values="iv_grid").sort_index(axis=1)
    return list(wide.index), pd.to_datetime(wide.columns).to_numpy(), wide.to_numpy(dtype=float, na_value=np.nan)


def arma_losses(panel: DataFrame, splits: Splits = Splits(), horizon: int = 1, orders=ARMA_ORDERS) -> DataFrame:
    """Validation RMSE and MAE of each order, fitted by likelihood on the training history only.

    `panel` is dense: node, quote_date, iv_grid.
    """
    train_end, fit_end = np.datetime64(pd.Timestamp(splits.train_end)), np.datetime64(pd.Timestamp(splits.fit_end))

    def trial(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, day, x = _matrix(pdf)
        x, day = x[:, day <= fit_end], day[day <= fit_end]
        history = x[:, day <= train_end]
        origin = np.arange(max(0, len(day) - horizon))
        target = origin + horizon
        check = ((day[target] > train_end) & (day[origin] >= train_end))[None] & np.isfinite(x[:, target])
        enough = (np.isfinite(history).sum(axis=1) >= splits.min_arma_train) & (check.sum(axis=1) >= splits.min_validation)
        rows = []
        for position, order in enumerate(orders):
            name, found = "%d%d%d" % tuple(order), {}
            some = np.flatnonzero(enough)
            if len(some):
                params, _, fitted = arma.fit(history[some], order)
                made = arma.run(x[some], params, order, horizon)[1]
                for i, node in enumerate(some):
                    error = (made[i, origin] - x[node, target])[check[node]]
                    if fitted[i] and np.isfinite(error).all():
                        found[node] = ("OK", float(np.sqrt(np.mean(error**2))), float(np.mean(np.abs(error))))
            for i, node in enumerate(nodes):
                status = "NOT_ESTIMABLE" if enough[i] else "INSUFFICIENT_HISTORICAL_LABELS"
                rows.append((node, position, name, *found.get(i, (status, None, None))))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _ARMA_LOSS.split(", ")])

    return _together(panel).groupBy("_group").applyInPandas(trial, _ARMA_LOSS)


def arma_forecast(panel: DataFrame, splits: Splits = Splits(), horizon: int = 1, orders=ARMA_ORDERS) -> DataFrame:
    """Forecasts at every origin from the order chosen on the validation window,
    re-estimated on the history up to the fit date."""
    losses = arma_losses(panel, splits, horizon, orders)
    best = select_candidate(losses.where("status = 'OK'"), ["node"])
    reason = losses.groupBy("node").agg(
        F.when(F.bool_or(F.col("status") == "INSUFFICIENT_HISTORICAL_LABELS"), "INSUFFICIENT_HISTORICAL_LABELS")
        .otherwise("NO_CONVERGED_CANDIDATE")
        .alias("_reason")
    )
    chosen = _together(panel).join(best.select("node", "candidate"), "node", "left").join(reason, "node", "left")
    fit_end = np.datetime64(pd.Timestamp(splits.fit_end))

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, day, x = _matrix(pdf)
        own = pdf.drop_duplicates("node").set_index("node").loc[nodes]
        made, status = np.full(x.shape, np.nan), own["_reason"].to_numpy(dtype=object)
        for name in own["candidate"].dropna().unique():
            some = np.flatnonzero((own["candidate"] == name).to_numpy())
            order = tuple(int(c) for c in name)
            params, _, fitted = arma.fit(x[some][:, day <= fit_end], order)
            made[some[fitted]] = arma.run(x[some[fitted]], params[fitted], order, horizon)[1]
            status[some] = np.where(fitted, "OK", "FINAL_NOT_ESTIMABLE")
        out = pd.DataFrame({"node": np.repeat(nodes, len(day)), DAY: np.tile(day, len(nodes)), "candidate": np.repeat(own["candidate"].to_numpy(dtype=object), len(day))})
        out[DAY] = out[DAY].dt.date
        return out.assign(status=np.repeat(status, len(day)), forecast=made.ravel())

    done = chosen.groupBy("_group").applyInPandas(final, _ARMA_FORECAST)
    return done.withColumn("forecast", N.finite_or_null("forecast"))


def ar1_coefficients(panel: DataFrame, cutoff) -> DataFrame:
    """First-order coefficient without constant as plain aggregates: the Spark-only
    route for the simplest order, and a check on the kernel."""
    before = Window.partitionBy("node").orderBy(DAY)
    pairs = panel.where(F.col(DAY) <= F.lit(cutoff)).withColumn("_x", F.lag("iv_grid").over(before))
    whole = pairs.where(F.col("iv_grid").isNotNull() & F.col("_x").isNotNull())
    return whole.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_pairs"), N.div(F.sum(F.col("iv_grid") * F.col("_x")), F.sum(F.col("_x") * F.col("_x"))).alias("phi")
    )


# ------------------------------------------------------------------ boosted trees

# --- fixed values: the two published boosting configurations ---
BOOST_CONFIGS = (
    {"maxIter": 200, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"},
    {"maxIter": 300, "maxDepth": 2, "stepSize": 0.03, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"},
)
# --- end of fixed values ---


_BOOST_LOSS = "node string, position int, candidate string, rmse double, mae double"
_BOOST_FORECAST = "node string, quote_date date, candidate string, forecast double"


def _boosted(rows: pd.DataFrame, config: dict, seed: int) -> boosting.Trees:
    """A model of one node's rows; its samples depend on the seed, the node and the configuration."""
    return boosting.fit(
        rows[FEATURES].to_numpy(dtype=float, na_value=np.nan),
        rows["label"].to_numpy(dtype=float),
        config["maxIter"],
        config["maxDepth"],
        config["stepSize"],
        config["subsamplingRate"],
        float(config["featureSubsetStrategy"]),
        [seed, zlib.crc32(rows["node"].iloc[0].encode()), config["maxIter"], config["maxDepth"]],
    )


def boosted_losses(masked: DataFrame, configs=BOOST_CONFIGS, seed: int = 42) -> DataFrame:
    """Validation RMSE and MAE of each configuration per node, fitted on the node's training rows.
    A node without training or validation rows has none."""

    def trial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DAY)
        train, check = pdf[pdf["is_train"]], pdf[pdf["is_validation"]]
        out = []
        for position, config in enumerate(configs if len(train) and len(check) else ()):
            made = _boosted(train, config, seed).predict(check[FEATURES].to_numpy(dtype=float, na_value=np.nan))
            error = made - check["label"].to_numpy(dtype=float)
            out.append((pdf["node"].iloc[0], position, str(position), float(np.sqrt(np.mean(error**2))), float(np.mean(np.abs(error)))))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _BOOST_LOSS.split(", ")])

    rows = masked.where("is_train OR is_validation").select("node", DAY, "label", "is_train", "is_validation", *FEATURES)
    return by_node(rows).applyInPandas(trial, _BOOST_LOSS)


def boosted_forecast(masked: DataFrame, splits: Splits = Splits(), configs=BOOST_CONFIGS, seed: int = 42) -> DataFrame:
    """One boosted model per node: the configuration is chosen on the validation rows, refitted on all
    historical labels, and every origin is forecast. Missing features stay missing.

    A task fits one node at a time, on at most one row per session.
    """
    status = history_status(masked, splits).select("node", "status")
    eligible = masked.join(status.where("status = 'OK'").select("node"), "node", "left_semi")
    best = select_candidate(boosted_losses(eligible, configs, seed), ["node"], rule="near_tie").select("node", "position")

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DAY)
        position = int(pdf["position"].iloc[0])
        made = _boosted(pdf[pdf["is_final"]], configs[position], seed).predict(pdf[FEATURES].to_numpy(dtype=float, na_value=np.nan))
        return pd.DataFrame({"node": pdf["node"], DAY: pdf[DAY], "candidate": str(position), "forecast": made})

    rows = eligible.select("node", DAY, "label", "is_final", *FEATURES).join(best, "node")
    predicted = by_node(rows).applyInPandas(final, _BOOST_FORECAST)
    origins = masked.select("node", DAY, "target_date").join(status, "node")
    return origins.join(predicted, ["node", DAY], "left")
