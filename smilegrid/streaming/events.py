"""Daily cleaning counts over snapshots that arrive late or more than once.

Event time is the quote date. A watermark of some days decides when a day is closed: the
batch after the one that moved the watermark writes the day's counts, once, and still counts
what it brings for that day; rows of later batches are dropped. A quote that was sent again
while its day was open is counted once. State is one row per open day and rule, and one key
per quote of the open days; both leave the state when their day closes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import cleaning
from ..settings import Cleaning
from ..sources.tables import QUOTE_SCHEMA

EVENT = "event_time"
#: A repeated snapshot is equal in its date, however written, and all other quote columns.
IDENTITY = (EVENT, *[c for c in QUOTE_SCHEMA.names if c != "quote_date"])


def with_event_time(quotes: DataFrame) -> DataFrame:
    """Quotes with a readable date, and that date as event time.

    A quote without one belongs to no day; `streaming.cleaning` counts it.
    """
    return quotes.withColumn(EVENT, X.as_date(quotes, "quote_date").cast("timestamp")).where(F.col(EVENT).isNotNull())


def without_repeats(quotes: DataFrame, lateness: str) -> DataFrame:
    """Each quote once, by a digest of its date and all other columns, nulls included.

    On a stream the digests are kept for `lateness` behind the newest event; a batch of the
    same rows gives the same quotes.
    """
    return _each_once(_with_digest(quotes), lateness).drop("_digest")


def _with_digest(quotes: DataFrame) -> DataFrame:
    text = F.to_json(F.struct(*[F.col(c) for c in IDENTITY]), {"ignoreNullFields": "false"})
    return quotes.withColumn("_digest", F.sha2(text, 256))


def _each_once(keyed: DataFrame, lateness: str) -> DataFrame:
    if keyed.isStreaming:
        return keyed.withWatermark(EVENT, lateness).dropDuplicatesWithinWatermark(["_digest"])
    return keyed.dropDuplicates(["_digest"])


def daily_counts(quotes: DataFrame, rates: DataFrame, rules: Cleaning = Cleaning(), lateness: str = "5 days") -> DataFrame:
    """Quotes per day and first broken rule (`kept` for none): (event_time, outcome, n).

    The same plan for a batch and for a stream. The rate table is a batch table: it is read
    again by every micro-batch. Equal quotes break the same rule, so the rule is found first
    and only it travels with the digest.
    """
    flagged = cleaning.with_first_failure(_with_digest(with_event_time(quotes)), rates, rules)
    outcomes = flagged.select(EVENT, "_digest", F.coalesce("first_fail", F.lit("kept")).alias("outcome"))
    return _each_once(outcomes, lateness).groupBy(EVENT, "outcome").agg(F.count(F.lit(1)).alias("n"))


def write_daily_counts(
    stream: DataFrame, rates: DataFrame, folder: str, rules: Cleaning = Cleaning(), lateness: str = "5 days"
) -> StreamingQuery:
    """Process everything available, append the counts of the days that closed, then stop.

    The next call goes on with the open days. The file sink and the progress log make a
    retried batch write its rows once.
    """
    return (
        daily_counts(stream, rates, rules, lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/days")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


def closed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the closed days so far: (quote_date, outcome, n)."""
    return spark.read.parquet(f"{folder}/days").select(F.to_date(EVENT).alias("quote_date"), "outcome", "n")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their day was closed, over the run's batches that Spark still reports (the last 100)."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
