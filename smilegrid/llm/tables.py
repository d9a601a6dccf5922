"""Small helpers shared by the operators: stored stages, checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smilegrid.plans.lineage import cut

__all__ = ["broadcast_below", "components", "cut", "load", "numbered"]

#: Most rows of a side of a few fixed-width columns that is sent to every executor.
BROADCAST_ROWS = 1_000_000
#: Columns that `numbered` uses on its way.
NUMBERING = ("_range", "_at", "_rows", "_start")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_below(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a stored table of fixed-width rows if it has at most `most`
    rows; beyond that the planner joins by shuffle and adaptive execution splits skew."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Every round takes the smallest label among neighbours and then the label of
    that label, so a chain shortens geometrically. Each round is a stored table;
    nothing but one changed-or-not count reaches the driver.
    """
    edges = cut(
        links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        .unionByName(links.select(F.col(b).alias("src"), F.col(a).alias("dst")))
        .distinct(),
        "edges",
    )
    labels = cut(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["dst"] == labels["node"]).select(F.col("src").alias("node"), "label")
        best = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        moved = cut(
            best.join(onward, "label", "left")
            .join(labels.withColumnRenamed("label", "before"), "node")
            .select("node", F.least("label", F.coalesce("onward", "label")).alias("label"), "before"),
            "labels",
        )
        settled = moved.where("label <> before").isEmpty()
        labels = moved.select("node", "label")
        if settled:
            return labels


def numbered(table: DataFrame, index: str, order: list[Column] | None = None) -> DataFrame:
    """A stored copy of `table` with a column `index` that counts its rows from 0 without gaps.

    With `order`, rows are dealt by ranges of it and sorted within, so the numbers follow it
    and no task holds more than a range; equal rows share a range. The names in NUMBERING and
    `index` must be free.
    """
    if order:
        table = table.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    stored = cut(table.withColumns({"_range": F.shiftright(place, 33), "_at": place.bitwiseAND((1 << 33) - 1)}), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that wrote the table
    starts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return stored.join(F.broadcast(starts), "_range").withColumn(index, F.col("_start") + F.col("_at")).drop(*NUMBERING)
