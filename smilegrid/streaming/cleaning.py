"""Quote cleaning over an archive that grows file by file.

Every rule looks at one quote and the rate table, so cleaning is stateless: a
micro-batch is cleaned exactly like a batch, and its counters are observed while
its rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cleaning
from ..settings import Cleaning
from ..sources.tables import QUOTE_SCHEMA


def quote_stream(spark: SparkSession, folder: str, fmt: str = "csv", files_per_batch: int = 1000) -> DataFrame:
    """New quote files of a folder as a stream."""
    reader = spark.readStream.schema(QUOTE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(folder)


def clean_stream(stream: DataFrame, rates: DataFrame, folder: str, rules: Cleaning = Cleaning()) -> StreamingQuery:
    """Clean everything available, then stop.

    Kept quotes go to `clean/batch=N` and counters to `counts/batch=N` under the
    folder. A batch that is retried overwrites its own output, so each quote is
    kept and counted once.
    """

    def write(batch: DataFrame, number: int) -> None:
        counters = Observation(f"cleaning-{number}")
        failed = F.col("first_fail")
        flagged = cleaning.with_first_failure(batch, rates, rules).observe(
            counters,
            F.count(F.lit(1)).alias("input"),
            *[F.count_if(failed == name).alias("dropped_" + name) for name, _ in cleaning.FUNNEL],
            F.count_if(failed.isNull()).alias("kept_basic"),
        )
        cleaning.kept(flagged).write.mode("overwrite").parquet(f"{folder}/clean/batch={number}")
        totals = batch.sparkSession.createDataFrame([counters.get])  # one row of counters
        totals.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


def total_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counters summed over all batches so far, in funnel order."""
    names = ["input", *["dropped_" + name for name, _ in cleaning.FUNNEL], "kept_basic"]
    return spark.read.parquet(f"{folder}/counts").agg(*[F.sum(n).alias(n) for n in names])


def running_funnel(stream: DataFrame, rates: DataFrame, rules: Cleaning = Cleaning()) -> DataFrame:
    """Streaming count per first failing rule (nine groups of state)."""
    return cleaning.with_first_failure(stream, rates, rules).groupBy("first_fail").agg(F.count(F.lit(1)).alias("n"))
