"""Readers and writers for quotes, rates, calendars and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import number
from ..functions.sizing import small_side
from ..functions.text import lenient_date, normalise_headers
from ..settings import DIVIDEND, RATE_DATE, TENOR_COLUMNS

QUOTE_SCHEMA = T.StructType(
    [
        T.StructField("underlying_symbol", T.StringType()),
        T.StructField("quote_date", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("expiration", T.StringType()),
        T.StructField("strike", T.DoubleType()),
        T.StructField("option_type", T.StringType()),
        T.StructField("trade_volume", T.LongType()),
        T.StructField("open_interest", T.LongType()),
        T.StructField("bid_1545", T.DoubleType()),
        T.StructField("ask_1545", T.DoubleType()),
        T.StructField("underlying_bid_1545", T.DoubleType()),
        T.StructField("underlying_ask_1545", T.DoubleType()),
        T.StructField("bid_eod", T.DoubleType()),
        T.StructField("ask_eod", T.DoubleType()),
    ]
)


class MissingColumns(ValueError):
    """A source table lacks columns the study needs."""


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumns("missing columns: " + ", ".join(missing))
    return df


def read_quotes_csv(spark: SparkSession, path, schema: T.StructType = QUOTE_SCHEMA) -> DataFrame:
    """Header CSV of end-of-day quotes; columns are matched by header name.

    The explicit schema avoids an inference pass over the whole archive. `path` is
    one path or a list of them; the files of a path share one header, which is read
    first, and different paths may order or extend the columns in different ways. A
    file whose header differs from its path's is an error, never read by position.
    """
    if not isinstance(path, str) and isinstance(path, (list, tuple)):
        return reduce(DataFrame.unionByName, [read_quotes_csv(spark, p, schema) for p in path])
    path = str(path)
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in schema.fields}
    require_columns(spark.createDataFrame([], T.StructType([T.StructField(h.strip(), T.StringType()) for h in header])), known)
    full = T.StructType(
        [T.StructField(h, known[h.strip()].dataType if h.strip() in known else T.StringType()) for h in header]
    )
    named = spark.read.schema(full).option("header", True).option("enforceSchema", False)
    return normalise_headers(named.csv(path)).select(*schema.names)


def read_rates_csv(spark: SparkSession, path) -> DataFrame:
    """Daily dividend yield and tenor rates as text columns turned into typed ones."""
    return typed_rates(spark.read.option("header", True).csv(path))


def typed_rates(df: DataFrame) -> DataFrame:
    df = require_columns(normalise_headers(df), (RATE_DATE, DIVIDEND, *TENOR_COLUMNS))
    return df.select(
        lenient_date(RATE_DATE).alias(RATE_DATE),
        *[number(F.col(f"`{c}`")).alias(c) for c in (DIVIDEND, *TENOR_COLUMNS)],
    ).where(F.col(RATE_DATE).isNotNull())


def csv_row_count(spark: SparkSession, path) -> DataFrame:
    """Data rows of a header CSV, as one row."""
    return spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("rows"))


def read_table(spark: SparkSession, path, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path, sort=(), mode: str = "overwrite") -> None:
    """Compressed Parquet; an optional order inside each file helps min/max skipping."""
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.mode(mode).option("compression", "zstd").parquet(path)


def write_by_date(df: DataFrame, path, date: str = "quote_date", rows_per_file: int = 2_000_000, mode="overwrite") -> None:
    """`date=` folders, so a later read of a few dates touches only those folders.

    Rows are spread by date and a salt: a date has as many writers as its counted
    rows need, and no task opens a file for every date. Reads `df` twice, so it
    should be a table.
    """
    sizes = df.groupBy(F.col(date).alias("_day")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("_files"))
    (
        df.join(F.broadcast(sizes), df[date].eqNullSafe(sizes["_day"]))  # one row per calendar day
        .withColumn("date", F.col(date))
        .withColumn("_salt", salt)
        .drop("_day", "_files")
        .repartition("date", "_salt")
        .drop("_salt")
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("date")
        .parquet(path)
    )


def read_dates(spark: SparkSession, path, dates: DataFrame, date: str = "date") -> DataFrame:
    """Only the partitions of the wanted dates (dynamic partition pruning).

    `dates` is a one-column frame; it is broadcast only when its counted size is
    small, and an absent date gives no rows.
    """
    wanted = small_side(dates.select(F.col(dates.columns[0]).alias(date)).distinct())
    return spark.read.parquet(path).join(wanted, date, "left_semi")


def write_report(df: DataFrame, path, fmt: str = "csv", order=(), files: int | None = 1) -> None:
    """A report table in one file, computed once and written as it streams past.

    Report tables hold a row per model, state and test. For a large table give
    `files=None`: every task then writes its own file, in the given order.
    """
    out = df.orderBy(*order) if order else df
    writer = (out.coalesce(files) if files else out).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def expected_tables(spark: SparkSession, expected_path, actual_path) -> tuple[DataFrame, DataFrame]:
    """A stored expected report and the new one, read as text so that the key
    comparison sees exactly what was written."""
    read = spark.read.option("header", True)
    return read.csv(expected_path), read.csv(actual_path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Give a scan that arrived in too few splits enough tasks.

    Only for frames that are a plain scan and projection; a large archive
    already has more splits than this and is left alone.
    """
    spark = df.sparkSession
    wanted = partitions or spark.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
