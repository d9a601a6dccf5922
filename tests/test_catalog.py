"""Every registered query against its SQL.

The smallest data has too few complete trading days for the inference operators,
which refuse such samples, so the middle size is used.
"""

import contextlib
import io
import math
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from smilegrid.plans.lineage import cut

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test data not available")


@pytest.fixture(scope="module")
def database():
    return compare.database(DATA)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 8


def test_sql_belongs_to_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, database, name):
    text, ok = compare.compare(spark, database, entry.queries()[name], entry.oracle_sql().get(name), DATA)
    assert ok and text != "rows-only n=0", text


def test_quotes_are_priced_once_per_contract_and_session(spark, tmp_path, monkeypatch):
    """The stage that writes raw quotes must stay small enough to be compiled, and no quote may get lost or change its price."""
    from smilegrid.catalog import inputs

    lines = [(k, 1 + k % 4, 7 * k, k % 13, 5.0, 0.01 * (k % 7), 0.08) for k in range(400)]
    lines += [(60, 2, None, 3, 5.0, 0.02, 0.0), (60, None, 5, None, 5.0, 0.02, 0.0), (59, 1, 5, 4, 5.0, 0.02, 0.0), (-7, 1, -5, -4, 5.0, 0.02, 0.0), (None, 1, 5, 4, 5.0, 0.02, 0.0)]
    frame = spark.createDataFrame(lines * 3, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double")
    frame.write.parquet(str(tmp_path / "lineitem.parquet"))
    stored = []
    monkeypatch.setattr(inputs, "cut", lambda df, name="stage": stored.append(df) or cut(df, name))
    market = inputs.Market(spark, str(tmp_path))
    raw = market.raw_quotes
    ahead = [(k, a) for k, *_ in lines if k is not None for a in (0, 1) if int(math.fmod(k, 60)) + a < 60]
    assert raw.count() == 3 * len(ahead)
    keys = raw.select("quote_date", "expiration", "strike", "option_type", "root", "trade_volume", "open_interest")
    copies = raw.groupBy(*raw.columns).count().where(F.col("count") % 3 != 0)
    assert copies.isEmpty() and keys.where("strike IS NULL").count() == 6 and keys.where("expiration IS NULL").count() == 12
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            stored[-1].select("*").explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", text.getvalue())]
    assert sizes and max(sizes) < 8000


def test_quotes_are_read_and_stored_no_oftener_than_needed(spark, monkeypatch):
    """Lines are read for the contracts' prices and for the raw quotes only, volatilities of quotes are not stored a second
    time, and the inversion's counts read the raw archive once."""
    from smilegrid.catalog import inputs, quotes_cases

    stored = []
    monkeypatch.setattr(inputs, "cut", lambda df, name="stage": stored.append(df) or cut(df, name))
    market = inputs.Market(spark, DATA)
    assert market.iv_quotes.count() == market.clean.count()
    assert sum(any("lineitem" in f for f in df.inputFiles()) for df in stored) == 2
    assert not any("implied_vol" in df.columns for df in stored)
    assert not set(quotes_cases._counts(market).inputFiles()) & set(market.raw_quotes.inputFiles())


def test_raw_quotes_are_derived_by_their_readers_and_a_date_text_is_parsed_once(spark, monkeypatch):
    """No copy of all raw quotes is stored, a reader of few columns reads few of the lines, and dates are parsed after counting."""
    import contextlib
    import io

    from smilegrid.catalog import QUERIES, inputs

    stored = []
    monkeypatch.setattr(inputs, "cut", lambda df, name="stage": stored.append(df) or cut(df, name))
    monkeypatch.setattr(inputs, "_markets", {})
    frame = QUERIES["lenient_dates"](spark, DATA)
    assert not any("bid_1545" in df.columns for df in stored)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    parsed = [line for line in text.getvalue().splitlines() if "parsed" in line]
    assert parsed and "l_discount" not in text.getvalue()
    counts = {r.quote_date: (r.parsed, r.n) for r in frame.collect()}
    market = inputs.Market(spark, DATA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = io.StringIO()
        with contextlib.redirect_stdout(code):
            market.flagged.select("*").explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", code.getvalue())) < 8000
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey >= 0")
    assert sum(n for _, n in counts.values()) == lines.count() + lines.where("l_orderkey % 60 <> 59").count()
    assert counts["n/a"][0] is None and all(p is not None for q, (p, _) in counts.items() if q != "n/a")
