"""Implied-volatility inversion as an Arrow-batched job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as N
from ..functions import text as X
from ..functions.numeric import HART_BOTTOM, HART_SPLIT, HART_TOP, SQRT_TWO_PI
from ..functions.sizing import small_side
from ..settings import DIVIDEND, RATE_DATE

LOWEST, HIGHEST = 1e-4, 5.0


def _cdf(x: np.ndarray) -> np.ndarray:
    a = np.minimum(np.abs(x), 38.0)
    tail = np.exp(-a * a / 2)
    centre = tail * np.polyval(HART_TOP, a) / np.polyval(HART_BOTTOM, a)
    if (a >= HART_SPLIT).any():
        fraction = a + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            fraction = a + k / fraction
        centre = np.where(a < HART_SPLIT, centre, tail / fraction / SQRT_TWO_PI)
    upper = np.where(a > 37, 0.0, centre)
    return np.where(x > 0, 1 - upper, upper)


def _solve(price, spot, strike, t, r, q, call) -> np.ndarray:
    """Bracketed Newton on whole Arrow batches; NaN where no sign change exists."""
    sign = np.where(call, 1.0, -1.0)
    forward, bond = spot * np.exp(-q * t), strike * np.exp(-r * t)
    root = np.sqrt(t)
    base = (np.log(spot / strike) + (r - q) * t) / root

    def excess(rows, vol):
        sg, rt = sign[rows], root[rows]
        d1 = base[rows] / vol + 0.5 * vol * rt
        value = sg * (forward[rows] * _cdf(sg * d1) - bond[rows] * _cdf(sg * (d1 - vol * rt)))
        return value - price[rows], d1

    every = np.arange(len(price))
    low, high = np.full_like(price, LOWEST), np.full_like(price, HIGHEST)
    f_low, f_high = excess(every, low)[0], excess(every, high)[0]
    vol = np.full_like(price, np.nan)
    rows = every[f_low * f_high <= 0]
    guess = np.clip(np.sqrt(2 * np.abs(base[rows] / root[rows])) + 0.05, 0.1, 2.0)
    low, high = low[rows], high[rows]
    for _ in range(100):
        gap, d1 = excess(rows, guess)
        low, high = np.where(gap < 0, guess, low), np.where(gap < 0, high, guess)
        vega = forward[rows] * np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi) * root[rows]
        step = np.divide(gap, vega, out=np.full_like(gap, np.inf), where=vega > 1e-300)
        newton = guess - step
        moved = np.where((newton > low) & (newton < high), newton, (low + high) / 2)
        open_rows = np.abs(moved - guess) > 1e-13
        vol[rows] = moved
        if not open_rows.any():
            break
        # Only the rows still moving are evaluated again.
        rows, guess, low, high = rows[open_rows], moved[open_rows], low[open_rows], high[open_rows]
    return np.where(f_low == 0, LOWEST, vol)


@F.pandas_udf(T.DoubleType())
def _implied_vol(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    for price, spot, strike, t, r, q, call in batches:
        columns = [s.to_numpy(dtype=float, na_value=np.nan) for s in (price, spot, strike, t, r, q)]
        usable = np.isfinite(np.column_stack(columns)).all(axis=1)
        for k in range(4):
            usable &= columns[k] > 0
        out = np.full(len(price), np.nan)
        if usable.any():
            with np.errstate(all="ignore"):
                out[usable] = _solve(*[c[usable] for c in columns], call.to_numpy(dtype=bool)[usable])
        yield pd.Series(out)


def invert(quotes: DataFrame) -> DataFrame:
    """Add `implied_vol` (NULL when unsolvable) and `iv_status`.

    Rows without a parseable date or with a missing pricing input are dropped,
    as they cannot be attempted. The solver is row-local: no shuffle.
    """
    kinds = dict(quotes.dtypes)
    inputs = ["mid", "spot", "strike", "r_annual", "q_annual"]
    df = quotes.withColumns(
        {
            **{c: X.as_date(quotes, c) for c in ("quote_date", "expiration") if kinds[c] != "date"},
            **{c: F.col(c).try_cast("double") for c in inputs if kinds[c] != "double"},
            "option_type": X.label("option_type"),
        }
    )
    df = df.withColumn("T", N.year_fraction("quote_date", "expiration"))
    # The sum is missing when any input is: one short predicate for all of them.
    total = F.col("T")
    for c in inputs:
        total = total + F.col(c)
    df = df.where(N.holds(~F.isnan(total)))
    df = df.withColumn(
        "implied_vol",
        N.finite_or_null(
            _implied_vol("mid", "spot", "strike", "T", "r_annual", "q_annual", F.col("option_type") == "C")
        ),
    )
    status = F.when(N.holds(F.col("implied_vol") > 0), "VALID_IV").otherwise("SOLVER_FAILURE")
    return df.withColumn("iv_status", status)


def with_market_inputs(quotes: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Derive spot, mid and annual rates where the source lacks them."""
    have = set(quotes.columns)
    df = quotes
    if "spot" not in have:
        df = df.withColumn("spot", N.midpoint("underlying_bid_1545", "underlying_ask_1545"))
    if "mid" not in have:
        df = df.withColumn("mid", N.midpoint("bid_1545", "ask_1545"))
    if {"r_annual", "q_annual"} <= have:
        return df
    if rates is None:
        raise ValueError("r_annual and q_annual are absent and no rate table was given")
    df = df.withColumns({c: X.as_date(df, c) for c in ("quote_date", "expiration")})
    df = df.withColumn("T", N.year_fraction("quote_date", "expiration"))
    side = small_side(rates)
    df = df.join(side, df.quote_date == side[RATE_DATE], "inner")
    return df.withColumns(
        {"r_annual": N.annualised(N.tenor_rate("T")), "q_annual": N.annualised(F.col(f"`{DIVIDEND}`"))}
    )


def inversion_counts(inverted: DataFrame, attempted: DataFrame | None = None) -> DataFrame:
    """Counter row: valid and failed inversions, and rows that could not be attempted."""
    zero = F.lit(0).cast("long")
    counts = inverted.agg(
        zero.alias("input") if attempted is not None else F.count(F.lit(1)).alias("input"),
        F.count_if(F.col("iv_status") == "VALID_IV").alias("valid"),
        F.count_if(F.col("iv_status") == "SOLVER_FAILURE").alias("solver_failure"),
    )
    if attempted is not None:
        total = attempted.agg(F.count(F.lit(1)).alias("input"), zero.alias("valid"), zero.alias("solver_failure"))
        counts = counts.unionByName(total).agg(
            *[F.sum(c).alias(c) for c in ("input", "valid", "solver_failure")]
        )
    return counts.withColumn("invalid_input", F.col("input") - F.col("valid") - F.col("solver_failure"))
