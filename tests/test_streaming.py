"""Event-time counts: late and repeated rows against the batch result."""

import datetime as dt
import os

import pytest

from smilegrid.settings import DIVIDEND, RATE_DATE, TENOR_COLUMNS
from smilegrid.sources.tables import QUOTE_SCHEMA
from smilegrid.streaming import events
from smilegrid.streaming.cleaning import quote_stream


def day(n):
    return dt.date(2024, 3, 1) + dt.timedelta(days=n)


def quote(n, strike, bid=5.0, symbol="SPX"):
    """One quote of day n; a bid above the ask fails the first rule."""
    return (symbol, day(n).isoformat(), "SPX", day(n + 60).isoformat(), strike, "C", 10, 10, bid, 5.4, 99.0, 101.0, bid, 5.4)


@pytest.fixture
def rates(spark):
    names = [RATE_DATE, DIVIDEND, *TENOR_COLUMNS]
    schema = ", ".join(f"`{n}` {'date' if n == RATE_DATE else 'double'}" for n in names)
    return spark.createDataFrame([(day(n), 1.0, *[2.0] * 6) for n in range(40) if n != 3], schema)


def add_file(spark, folder, number, rows):
    """One more file of the folder, later than all others."""
    frame = spark.createDataFrame(rows, QUOTE_SCHEMA).toPandas()
    path = f"{folder}/part-{number:02d}.parquet"
    frame.to_parquet(path, index=False)
    os.utime(path, (1_700_000_000 + 100 * number,) * 2)


def run(spark, source, out, rates):
    query = events.write_daily_counts(quote_stream(spark, source, "parquet", files_per_batch=1), rates, out)
    query.awaitTermination()
    return query


def found(df):
    return sorted((r.quote_date, r.outcome, r.n) for r in df.collect())


def batch(spark, rows, rates, closed):
    df = events.daily_counts(spark.createDataFrame(rows, QUOTE_SCHEMA), rates)
    df = df.selectExpr("to_date(event_time) AS quote_date", "outcome", "n")
    return found(df.where(df.quote_date <= closed))


def test_late_and_repeated_rows(spark, rates, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(source)
    first = [quote(n, 100.0 + k, bid=6.0 if k == 4 else 5.0) for n in (0, 1, 2) for k in range(6)]
    second = [quote(n, 100.0 + k) for n in (2, 3) for k in range(4, 9)]
    third = [quote(n, 100.0) for n in (8, 9)] + [quote(8, 100.0, symbol=None)]
    on_time = [quote(7, 101.0), quote(9, 102.0)]
    late = [quote(1, 300.0), quote(4, 301.0)]
    fifth = [quote(19, 100.0)]
    add_file(spark, source, 1, first + first[:5])  # repeats in the same file
    add_file(spark, source, 2, second + first[12:])  # and of an earlier one
    add_file(spark, source, 3, third + third[-1:])
    add_file(spark, source, 4, on_time + third)  # closes days up to 4
    add_file(spark, source, 5, third[:1] + late)
    add_file(spark, source, 6, fifth + [("SPX", "no date", *quote(0, 1.0)[2:])])
    query = run(spark, source, out, rates)

    kept = [*first, *second, *third, *on_time, *fifth]
    assert found(events.closed_days(spark, out)) == batch(spark, kept, rates, day(14))
    assert events.late_rows(query) == len(late)

    # The next run goes on: it closes day 19, and nothing is written twice.
    add_file(spark, source, 7, [quote(19, 100.0), quote(19, 101.0), quote(30, 100.0)])
    run(spark, source, out, rates)
    kept += [quote(19, 101.0), quote(30, 100.0)]
    assert found(events.closed_days(spark, out)) == batch(spark, kept, rates, day(25))


def test_batch_counts_of_nulls_repeats_and_empty_tables(spark, rates):
    rows = [quote(0, 100.0), quote(0, 100.0), quote(0, 100.0, symbol=None), quote(0, None), ("SPX", "01/03/2024", *quote(0, 100.0)[2:]), (None,) * len(QUOTE_SCHEMA)]
    counts = events.daily_counts(spark.createDataFrame(rows, QUOTE_SCHEMA), rates).collect()
    assert {(r.outcome, r.n) for r in counts} == {("kept", 2), ("basic", 1)}
    assert events.daily_counts(spark.createDataFrame([], QUOTE_SCHEMA), rates).isEmpty()


def test_deliveries_are_written_in_as_many_files_as_the_quotes_have_parts(spark, tmp_path):
    from smilegrid.catalog.model_cases import _write_deliveries

    quotes = spark.range(100)
    assert _write_deliveries(quotes.repartition(11), str(tmp_path / "many")) == 11
    assert _write_deliveries(quotes.coalesce(1), str(tmp_path / "few")) == 4
    assert spark.read.parquet(str(tmp_path / "many")).count() == spark.read.parquet(str(tmp_path / "few")).count() == 100


def test_only_the_outcome_is_shuffled_to_find_repeats(spark, rates):
    rows = [quote(n, 100.0 + k, bid=6.0 if k == 4 else 5.0) for n in (0, 1) for k in range(6)]
    counted = events.daily_counts(spark.createDataFrame(rows + rows, QUOTE_SCHEMA), rates)
    plan = counted._jdf.queryExecution().sparkPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Aggregate(key=[_digest" in line]
    assert shuffled and not any("underlying_bid_1545" in line for line in shuffled), plan
    assert sum(r.n for r in counted.collect()) == len(rows)
