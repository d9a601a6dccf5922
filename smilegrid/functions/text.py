"""Date parsing, contract identity and reason-list Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col, fails

# --- fixed values: labels and their order are part of the published tables ---
FAILURE_RULES = (
    "NONPOSITIVE_BID",
    "ASK_NOT_ABOVE_BID",
    "NONPOSITIVE_VOLUME",
    "NONPOSITIVE_OPEN_INTEREST",
    "INVALID_SPOT_OR_STRIKE",
    "T_OUTSIDE_DEFAULT_WINDOW",
    "MONEYNESS_OUTSIDE_DEFAULT_WINDOW",
    "SPREAD_ABOVE_DEFAULT_MAX",
    "INVALID_OPTION_TYPE",
    "NO_EXACT_RATE_DATE",
)
NO_FAILURE = "NO_OBSERVABLE_DEFAULT_FAILURE_REASON"
REASON_CATEGORIES = (
    "NONPOSITIVE_VOLUME_ONLY",
    "SPREAD_FILTER_ONLY",
    "RATE_OR_IV_INPUT_RELATED",
    "MONEYNESS_OR_T_FILTER",
    "MULTIPLE_REASONS",
    "NO_OBSERVABLE_REASON",
    "NONPOSITIVE_OPEN_INTEREST_ONLY",
    "OTHER_OBSERVABLE_REASON",
)
CATEGORY_OF_RULE = {
    "NONPOSITIVE_VOLUME": "NONPOSITIVE_VOLUME_ONLY",
    "SPREAD_ABOVE_DEFAULT_MAX": "SPREAD_FILTER_ONLY",
    "NO_EXACT_RATE_DATE": "RATE_OR_IV_INPUT_RELATED",
    "INVALID_SPOT_OR_STRIKE": "RATE_OR_IV_INPUT_RELATED",
    "MONEYNESS_OUTSIDE_DEFAULT_WINDOW": "MONEYNESS_OR_T_FILTER",
    "T_OUTSIDE_DEFAULT_WINDOW": "MONEYNESS_OR_T_FILTER",
    "NONPOSITIVE_OPEN_INTEREST": "NONPOSITIVE_OPEN_INTEREST_ONLY",
}
# --- end of fixed values ---

# Shapes rewritten to ISO before one cast. Trying parsers in turn would raise and
# swallow an exception per row for every format that does not fit.
DAY_FIRST = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?:[ T].*)?$"
YEAR_FIRST = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?:[ T].*)?$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T].*)?$"
WITH_MONTH_NAME = r"^\d{1,2} [A-Za-z]{3} \d{4}$"


def normalise_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})


def lenient_date(c) -> Column:
    """Mixed-format date parse, day first; a month above 12 is read month first, and
    anything unreadable becomes NULL."""
    text = F.trim(col(c).cast("string"))
    at = lambda start, length=1: F.substring(text, start, length)
    ten = F.length(text) == 10
    plain_iso = ten & (at(5) == "-") & (at(8) == "-")
    plain_day_first = ten & (at(3) == "/") & (at(6) == "/")
    iso = (
        F.when(plain_iso, text)
        .when(plain_day_first, F.concat(at(7, 4), F.lit("-"), at(4, 2), F.lit("-"), at(1, 2)))
        .otherwise(F.lit(None).cast("string"))
    )
    # The other shapes are rare. Inside an array function they stay out of the
    # generated code of the whole stage, which must stay small to be compiled well.
    rare = F.element_at(F.transform(F.array(text), _rare_date), 1)
    return F.coalesce(iso.try_cast("date"), F.when(~plain_iso & (text != ""), rare))


def _rare_date(text: Column) -> Column:
    swapped = lambda pattern, order: F.regexp_replace(text, pattern, order).try_cast("date")
    return (
        F.when(text.rlike(ISO), text.try_cast("date"))
        .when(text.rlike(DAY_FIRST), F.coalesce(swapped(DAY_FIRST, "$3-$2-$1"), swapped(DAY_FIRST, "$3-$1-$2")))
        .when(text.rlike(YEAR_FIRST), swapped(YEAR_FIRST, "$1-$2-$3"))
        .when(text.rlike(COMPACT), swapped(COMPACT, "$1-$2-$3"))
        .when(text.rlike(WITH_MONTH_NAME), F.try_to_date(text, "d MMM yyyy"))
    )


def as_date(df: DataFrame, name: str) -> Column:
    """The column as a date: typed columns pass through, text is parsed leniently."""
    kind = dict(df.dtypes)[name]
    if kind == "date":
        return F.col(name)
    if kind.startswith("timestamp"):
        return F.to_date(F.col(name))
    return lenient_date(name)


def strict_date(c) -> Column:
    """ISO date; a malformed value raises under ANSI mode."""
    return F.to_date(col(c).cast("string"), "yyyy-MM-dd")


def iso_date(c) -> Column:
    """ISO date; anything else is NULL."""
    text = F.trim(col(c).cast("string"))
    shaped = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    return F.when(shaped, text.try_cast("date"))


def label(c) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def option_side(c) -> Column:
    return F.substring(label(c), 1, 1)


def rounded_strike(c) -> Column:
    """Strike rounded half-even to six decimals, the precision of the contract key.
    The scaled product is rounded, as array libraries do, not the decimal text."""
    return F.rint(col(c).cast("double") * 1e6) / F.lit(1e6)


def contract_key(symbol, root, expiration, strike, option_type) -> Column:
    """Identity of a contract; NULL when any part is missing, so that two contracts
    with different gaps never share a key."""
    bar = F.lit("|")
    return F.concat(
        label(symbol),
        bar,
        label(root),
        bar,
        F.date_format(col(expiration), "yyyy-MM-dd"),
        bar,
        # Through a decimal: the same text as "%.6f" without a formatter call per row.
        rounded_strike(strike).try_cast("decimal(20,6)").cast("string"),
        bar,
        option_side(option_type),
    )


def joined_flags(rules: dict[str, Column], otherwise: str) -> Column:
    """Names of the rules that hold, `;`-joined in the given order, or a sentinel."""
    names = F.filter(
        F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull()
    )
    text = F.array_join(names, ";")
    return F.when(text == "", F.lit(otherwise)).otherwise(text)


def quote_failures(
    bid, ask, volume, open_interest, spot, strike, t, option_type, has_rate: Column, rules
) -> Column:
    """Which default cleaning rules a raw quote breaks (missing values break a rule)."""
    bid, ask, spot, strike, t = (col(c) for c in (bid, ask, spot, strike, t))
    moneyness = strike / F.nullif(spot, F.lit(0.0))
    spread = (ask - bid) / F.nullif((bid + ask) / 2, F.lit(0.0))
    checks = (
        fails(bid > 0),
        fails(ask > bid),
        fails(col(volume) > 0),
        fails(col(open_interest) > 0),
        fails(spot > 0) | fails(strike > 0),
        fails(t.between(rules.t_min_days / rules.days_per_year, rules.t_max_years)),
        fails(moneyness.between(rules.moneyness_min, rules.moneyness_max)),
        fails(spread <= rules.spread_rel_max),
        fails(col(option_type).isin("C", "P")),
        fails(has_rate),
    )
    return joined_flags(dict(zip(FAILURE_RULES, checks)), NO_FAILURE)


def reason_category(reasons) -> Column:
    """Collapse a `;`-joined reason list to one reporting category."""
    parts = F.array_distinct(F.split(F.coalesce(col(reasons), F.lit("")), ";"))
    named = F.array_except(parts, F.array(F.lit(NO_FAILURE), F.lit("")))
    single = F.element_at(named, 1)
    mapped = F.lit(None).cast("string")
    for rule, category in CATEGORY_OF_RULE.items():
        mapped = F.when(single == rule, category).otherwise(mapped)
    family = F.when(single.rlike("RATE|IV_INPUT|INVALID_SPOT"), "RATE_OR_IV_INPUT_RELATED")
    return (
        F.when(F.size(named) == 0, "NO_OBSERVABLE_REASON")
        .when(F.size(named) > 1, "MULTIPLE_REASONS")
        .otherwise(F.coalesce(mapped, family, F.lit("OTHER_OBSERVABLE_REASON")))
    )
