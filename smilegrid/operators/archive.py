"""A raw-quote archive laid out for point lookups: written once, then opened only where a wanted pair can lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import small_side
from ..plans.lineage import cut
from ..settings import Cleaning
from .quotes import QUOTE_KEY, as_quote_key, normalise_raw, recover_raw

ROWS_PER_PART = 500_000


def _part(buckets: Column) -> Column:
    bucket = F.pmod(F.xxhash64("contract_key"), buckets)
    return F.concat(F.date_format("quote_date", "yyyy-MM-dd"), F.lit("_"), bucket.cast("string"))


def write_archive(raw: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """Store every raw row, as it is, in parts of a date and a bucket of its contracts.

    A date has as many buckets as its counted rows need, so a part is one file of bounded size, with rows sorted by
    `contract_key` and a Bloom filter on it for lookups with literal keys. A part that repeated rows of one contract
    make larger is written by several tasks. Rows without a usable date or identity can never be looked up; they are
    kept in a part of their own. `layout` beside the parts says how many buckets each date has, `columns` what the rows look like. Reads `raw` three
    times, so it should be a table; columns named `contract_key`, `part` or starting with `_archive_` are taken.
    """
    spark = raw.sparkSession
    rows = normalise_raw(raw.withColumn("_archive_row", F.struct(*raw.columns))).select(*QUOTE_KEY, "_archive_row")
    findable = F.col("quote_date").isNotNull() & F.col("contract_key").isNotNull()
    days = rows.where(findable).groupBy("quote_date").agg(F.ceil(F.count(F.lit(1)) / rows_per_part).alias("_archive_buckets"))
    days.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")  # a row per date
    layout = spark.read.schema(days.schema).parquet(f"{path}/layout")
    raw.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # so that an archive without rows can be read
    placed = rows.join(small_side(layout), "quote_date", "left").withColumn(
        "part", F.when(findable, _part(F.col("_archive_buckets"))).otherwise("none")
    )
    sizes = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / (2 * rows_per_part)).alias("_archive_writers"))
    writer = F.pmod(F.xxhash64("_archive_row"), F.col("_archive_writers"))
    (
        placed.join(small_side(sizes), "part")
        .select("_archive_row.*", "contract_key", "part", F.when(F.col("_archive_writers") > 1, writer).otherwise(0).alias("_archive_writer"))
        .repartition("part", "_archive_writer")
        .drop("_archive_writer")
        .sortWithinPartitions("part", "contract_key")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#contract_key", "true")
        .option("parquet.bloom.filter.expected.ndv#contract_key", str(rows_per_part))
        .partitionBy("part")
        .parquet(f"{path}/parts")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows, with `contract_key` and `part`."""
    schema = spark.read.parquet(f"{path}/columns").schema.add("contract_key", "string").add("part", "string")
    return spark.read.schema(schema).parquet(f"{path}/parts")


def lookup(spark: SparkSession, path: str, pairs: DataFrame) -> DataFrame:
    """The raw rows of the wanted (quote_date, contract_key) pairs, in the archive's columns.

    The pairs name their parts, and partition pruning at run time opens no other part, so bytes read follow the
    pairs and not the archive. Beyond the broadcast bound the join shuffles and reads the archive once.
    """
    layout = spark.read.schema("quote_date date, _archive_buckets long").parquet(f"{path}/layout")
    wanted = (
        pairs.select(*QUOTE_KEY)
        .distinct()
        .join(small_side(layout), "quote_date")
        .select("contract_key", _part(F.col("_archive_buckets")).alias("part"))
    )
    # Run-time pruning asks for a filter on the other side; on a stored table it stays one.
    wanted = small_side(cut(wanted).where(F.col("part") > ""))
    found = read_archive(spark, path).join(wanted, ["part", "contract_key"], "left_semi")
    return found.drop("part", "contract_key")


def recover(spark: SparkSession, path: str, missing: DataFrame, rates: DataFrame, rules: Cleaning = Cleaning()) -> DataFrame:
    """`recover_raw`, opening only the parts of the archive that can hold a missing pair."""
    return recover_raw(lookup(spark, path, as_quote_key(missing)), missing, rates, rules)
