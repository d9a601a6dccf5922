"""Closed-form numeric Column expressions (all stay inside whole-stage codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import TENOR_COLUMNS, TENOR_MONTHS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """TRUE only for a present, non-NaN, non-infinite number; never NULL."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(c) -> Column:
    """NaN and infinities become NULL, so SQL comparisons treat them as missing."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def holds(predicate: Column) -> Column:
    """A predicate whose missing case counts as failed."""
    return F.coalesce(predicate, F.lit(False))


def fails(predicate: Column) -> Column:
    return ~holds(predicate)


def number(c) -> Column:
    """Lenient numeric coercion: text that is no number becomes NULL."""
    return finite_or_null(col(c).try_cast("double"))


def midpoint(bid, ask) -> Column:
    return (col(bid) + col(ask)) / 2


def relative_spread(bid, ask) -> Column:
    return div(col(ask) - col(bid), midpoint(bid, ask))


def spread_at_most(spread, limit: float) -> Column:
    """A relative spread up to the limit. The spread of a mean book carries the noise of its summation order (some
    1e-15), so a spread that equals the limit is judged by its first twelve decimals and not by that noise."""
    return F.round(col(spread), 12) <= F.lit(float(limit))


def two_sided(bid, ask) -> Column:
    """A usable book: both sides finite and 0 < bid <= ask."""
    bid, ask = col(bid), col(ask)
    return finite(bid) & finite(ask) & holds(bid > 0) & holds(ask >= bid)


def year_fraction(start, end, days_per_year: float = 365.0) -> Column:
    return F.datediff(col(end), col(start)) / F.lit(float(days_per_year))


def log_moneyness(k_over_s) -> Column:
    k = col(k_over_s)
    return F.when(k > 0, F.ln(k))


def annualised(daily, periods: float = 252.0) -> Column:
    return F.pow(1 + col(daily), F.lit(periods)) - 1


def tenor_rate(t, columns=TENOR_COLUMNS, months=TENOR_MONTHS) -> Column:
    """Piecewise-linear rate over the tenor columns, flat outside the first and last."""
    t = col(t)
    knots = [m / 12.0 for m in months]
    out = F.when(t < knots[0], F.col(columns[0]))
    for i in range(len(knots) - 1):
        lo, hi = F.col(columns[i]), F.col(columns[i + 1])
        weight = (t - knots[i]) / (knots[i + 1] - knots[i])
        out = out.when(t < knots[i + 1], lo + (hi - lo) * weight)
    return out.otherwise(F.col(columns[-1]))


def price_floor(spot, strike, t, r, q, is_call: Column) -> Column:
    """European no-arbitrage lower bound."""
    forward = col(spot) * F.exp(-col(q) * col(t))
    bond = col(strike) * F.exp(-col(r) * col(t))
    return F.greatest(F.lit(0.0), F.when(is_call, 1.0).otherwise(-1.0) * (forward - bond))


# --- fixed values: coefficients of Hart's rational normal-tail approximation,
# as tabulated in West (2005), "Better approximations to cumulative normal functions"
HART_TOP = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
HART_BOTTOM = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
HART_SPLIT = 7.07106781186547
SQRT_TWO_PI = 2.506628274631
# --- end of fixed values ---


def _horner(coefficients, x):
    acc = coefficients[0]
    for c in coefficients[1:]:
        acc = acc * x + c
    return acc


def norm_cdf(x) -> Column:
    """Standard normal distribution function, absolute error below 1e-15."""
    x = col(x)
    a = F.abs(x)
    tail = F.exp(-a * a / 2)
    centre = tail * _horner([F.lit(c) for c in HART_TOP], a) / _horner([F.lit(c) for c in HART_BOTTOM], a)
    fraction = a + 0.65
    for k in (4, 3, 2, 1):
        fraction = a + F.lit(float(k)) / fraction
    upper = F.when(a > 37, F.lit(0.0)).when(a < HART_SPLIT, centre).otherwise(tail / fraction / SQRT_TWO_PI)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def norm_pdf(x) -> Column:
    x = col(x)
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def two_sided_normal_p(statistic) -> Column:
    return 2 * norm_cdf(-F.abs(col(statistic)))


_TERMS = ("_spot", "_strike", "_t", "_r", "_q", "_vol", "_sign", "_root", "_d1", "_x1", "_x2", "_n1", "_n2")


def _with_option_terms(df: DataFrame, spot, strike, t, r, q, vol, is_call: Column) -> DataFrame:
    """Shared pricing terms as staged columns. Staging keeps each generated
    expression small: inlined, the distribution function would repeat its whole
    argument some twenty times."""
    df = df.withColumns(
        {
            "_spot": col(spot),
            "_strike": col(strike),
            "_t": col(t),
            "_r": col(r),
            "_q": col(q),
            "_vol": col(vol),
            "_sign": F.when(is_call, 1.0).otherwise(-1.0),
            "_root": F.sqrt(col(t)),
        }
    )
    c = F.col
    drift = c("_r") - c("_q") + c("_vol") * c("_vol") * 0.5
    df = df.withColumn("_d1", div(F.ln(div("_spot", "_strike")) + drift * c("_t"), c("_vol") * c("_root")))
    df = df.withColumns({"_x1": c("_sign") * c("_d1"), "_x2": c("_sign") * (c("_d1") - c("_vol") * c("_root"))})
    return df.withColumns({"_n1": norm_cdf("_x1"), "_n2": norm_cdf("_x2")})


def with_option_price(df: DataFrame, name: str, spot, strike, t, r, q, vol, is_call: Column) -> DataFrame:
    """Add the discounted European price; intrinsic value once time or volatility
    is used up."""
    df = _with_option_terms(df, spot, strike, t, r, q, vol, is_call)
    c = F.col
    live = c("_sign") * (
        c("_spot") * F.exp(-c("_q") * c("_t")) * c("_n1") - c("_strike") * F.exp(-c("_r") * c("_t")) * c("_n2")
    )
    intrinsic = F.greatest(F.lit(0.0), c("_sign") * (c("_spot") - c("_strike")))
    price = F.when((c("_t") <= 0) | (c("_vol") <= 0), intrinsic).otherwise(live)
    return df.withColumn(name, price).drop(*_TERMS)


def with_greeks(df: DataFrame, prefix: str, spot, strike, t, r, q, vol, is_call: Column) -> DataFrame:
    """Add Delta, Gamma, Vega (per 1.00 of volatility) and Theta (per year).

    NULL unless all six inputs are finite and spot, strike, time and volatility
    are positive.
    """
    df = _with_option_terms(df, spot, strike, t, r, q, vol, is_call)
    c = F.col
    usable = finite("_r") & finite("_q")
    for name in ("_spot", "_strike", "_t", "_vol"):
        usable = usable & finite(name) & holds(c(name) > 0)
    df = df.withColumns(
        {
            "_usable": usable,
            "_carry": F.exp(-c("_q") * c("_t")),
            "_discount": F.exp(-c("_r") * c("_t")),
            "_density": norm_pdf("_d1"),
        }
    )
    decay = div(-c("_spot") * c("_carry") * c("_density") * c("_vol"), 2 * c("_root"))
    income = c("_sign") * (
        c("_q") * c("_spot") * c("_carry") * c("_n1") - c("_r") * c("_strike") * c("_discount") * c("_n2")
    )
    values = {
        "Delta": c("_sign") * c("_carry") * c("_n1"),
        "Gamma": div(c("_carry") * c("_density"), c("_spot") * c("_vol") * c("_root")),
        "Vega": c("_spot") * c("_carry") * c("_density") * c("_root"),
        "Theta": decay + income,
    }
    df = df.withColumns({prefix + name: F.when(c("_usable"), value) for name, value in values.items()})
    return df.drop(*_TERMS, "_usable", "_carry", "_discount", "_density")


def qlike(actual, predicted) -> Column:
    actual, predicted = col(actual), col(predicted)
    ratio = (actual * actual) / (predicted * predicted)
    usable = finite(actual) & finite(predicted) & holds(actual > 0) & holds(predicted > 0)
    return F.when(usable, ratio - F.ln(ratio) - 1)


def side_label(weight) -> Column:
    return F.when(col(weight) > 0, "LONG").otherwise("SHORT")


def div(top, bottom) -> Column:
    """Division with NULL, not an error, for a zero denominator."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def student_p(statistic, dof) -> Column:
    """Two-sided Student-t p-value for whole degrees of freedom.

    Finite trigonometric series (Abramowitz and Stegun 26.7.3 and 26.7.4), summed
    with an array fold; meant for report rows.
    """
    t, nu = F.abs(col(statistic)), col(dof).cast("int")
    theta = F.atan2(t, F.sqrt(nu.cast("double")))
    cos2 = F.pow(F.cos(theta), F.lit(2.0))
    odd = nu % 2 == 1
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    steps = F.when(nu >= 4, F.sequence(F.lit(1), ((nu - F.when(odd, 3).otherwise(2)) / 2).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )

    def fold(acc, k):
        grow = F.when(odd, (2.0 * k) / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        term = acc["term"] * grow * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(steps, start, fold, lambda acc: acc["total"])
    inside_odd = (2 / math.pi) * (theta + F.when(nu > 1, F.sin(theta) * F.cos(theta) * series).otherwise(0.0))
    inside_even = F.sin(theta) * series
    return F.greatest(F.lit(0.0), 1 - F.when(odd, inside_odd).otherwise(inside_even))
