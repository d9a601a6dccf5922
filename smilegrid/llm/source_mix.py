"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents by a digest of their id and repeats them in
epochs. A document's virtual finish time is its source's running token total
divided by the source's target, so each source advances at its own rate. The
queue of all sources in order of finish time is cut where the budget is spent.

Nothing runs over a whole source or the whole queue in one task: running totals
are taken inside digest ranges of a source, with the ranges' sums before them;
the queue is cut into ranges of finish time, and only the range in which the
budget ends is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, load

#: Documents of one source range or one range of finish times, about.
RANGE_ROWS = 5_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def place(doc_id: Column, size: Column) -> Column:
    """Where a document stands in its source's queue; equal documents share a place."""
    return F.struct(_digest(doc_id).alias("key"), doc_id.isNotNull().alias("known"), doc_id.alias("doc_id"), size.alias("size"))


def reached(mixed: DataFrame, cap: int = 2) -> DataFrame:
    """(source, source_size, target, last): per source of a mix the place of the last document taken at least 1, 2, ... `cap` times.

    A source's documents are taken in the order of their places, so these tell what the
    mix takes of any of them without a join by document.
    """
    here = place(F.col("doc_id"), F.col("size"))
    last = [F.max(F.when(F.col("taken") >= F.col("size") * times, here)) for times in range(1, cap + 1)]
    return mixed.where("taken > 0").groupBy("source").agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.array(*last).alias("last")
    )


def targets(sized: DataFrame, weights: tuple[int, ...], percent: int, cap: int) -> DataFrame:
    """(source, source_size, target): one row per source.

    Weights repeat over the sources in code point order, null last. Shares of the
    budget stop at `cap` times the source's size, and what is left is reshared by
    weight: in order of cap per weight, a source is capped if its share of what
    the earlier ones leave exceeds its cap, and the others share the remainder.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    repeated = F.array(*[F.lit(w).cast("long") for w in weights])
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("weight", repeated[(F.row_number().over(by_name) - 1) % len(weights)])
    everything = Window.partitionBy()
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    budget = F.sum("source_size").over(everything) * percent / 100.0
    limit = F.col("source_size") * cap
    left = budget - F.coalesce(F.sum(limit).over(by_room), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_room), F.lit(0))
    rows = rows.select("*", limit.alias("limit"), budget.alias("budget"), (limit * left_weight <= F.col("weight") * left).alias("capped"))
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(everything), F.lit(0))
    open_weight = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    rate = (F.col("budget") - used) / open_weight
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(F.col("weight") * rate).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    percent: int = 150,
    cap: int = 2,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs`.

    `size` counts the words of the whole text, `taken` the words that the mix
    takes of it: 0, its size, or up to `cap` times its size. The queue ends before
    the first document that would pass the budget of `percent` of all sizes.

    Null and empty texts have size 0 and take no place in the queue; a null source
    is a source; null ids and rows with equal ids are documents of their own. An
    empty table gives an empty result. Other columns are not read.
    """
    sized = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _digest(F.col(id_col)).alias("key")
        ),
        "sized",
    )
    sources = cut(targets(sized, weights, percent, cap), "targets")
    rows, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()

    digits = max(1, math.ceil(math.log(max(rows, 1) / RANGE_ROWS, 16)))
    ranged = sized.withColumn("range", F.substring("key", 1, digits))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    sums = sums.select("source", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    running = ranged.withColumn("running", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    same = running["source"].eqNullSafe(sums["source"]) & (running["range"] == sums["range"])
    placed = running.join(sums, same).select(running["doc_id"], running["source"], "size", (F.col("before") + F.col("running")).alias("end"))
    named = placed.join(sources, placed["source"].eqNullSafe(sources["source"]))
    timed = cut(named.select("doc_id", placed["source"], "size", "source_size", "target", "end"), "queue")

    # One entry per epoch; nothing is stored or shuffled for them but sums per range of time.
    ranges = max(1, 2 * rows // RANGE_ROWS)
    entries = timed.where("size > 0").select(
        "source", "size", F.explode(F.array(*[_finish(epoch) for epoch in range(cap)])).alias("finish")
    ).withColumn("span", F.floor(F.col("finish") * ranges))
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = entries.groupBy("span").agg(F.sum("size").alias("sum"))
    spans = spans.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    passes = (F.col("before") + F.col("sum")) * 100 > F.lit(total * percent)
    last = spans.where(passes).orderBy("span").limit(1).first()
    end = None
    if last is not None:
        order = Window.partitionBy("span").orderBy("finish", F.col("source").asc_nulls_last())
        queue = entries.where(F.col("span") == last["span"]).withColumn("spent", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        passed = (F.lit(last["before"]) + F.col("spent")) * 100 > F.lit(total * percent)
        end = queue.where(passed).orderBy("finish", F.col("source").asc_nulls_last()).first()

    taken = F.lit(0).cast("long")
    for epoch in range(cap):
        taken = taken + F.when(_before(_finish(epoch), end), F.col("size")).otherwise(F.lit(0))
    return timed.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"))


def _finish(epoch: int) -> Column:
    """Virtual time at which the source has spent up to this document's end in this epoch."""
    return F.when(F.col("target") > 0, (F.col("end") + F.lit(epoch) * F.col("source_size")).cast("double") / F.col("target"))


def _before(finish: Column, end) -> Column:
    """Does a document that finishes then stand before the first one left out?"""
    if end is None:
        return finish.isNotNull()
    tie = F.lit(False) if end["source"] is None else F.coalesce(F.col("source") < F.lit(end["source"]), F.lit(False))
    if end["source"] is None:
        tie = F.col("source").isNotNull()
    return (finish < F.lit(end["finish"])) | ((finish == F.lit(end["finish"])) & tie)


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight
  FROM sized GROUP BY source),
room AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 150 / CAST(100 AS DOUBLE) AS budget,
         coalesce(sum(2 * source_size) OVER o, 0) AS caps_before, coalesce(sum(weight) OVER o, 0) AS weight_before,
         sum(weight) OVER () AS weights
  FROM sources
  WINDOW o AS (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, cap * (weights - weight_before) <= weight * (budget - caps_before) AS capped FROM room),
targets AS (
  SELECT source, source_size, budget,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE weight * ((budget - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0))
                             / CAST(sum(weight) FILTER (WHERE NOT capped) OVER () AS DOUBLE)) END AS target
  FROM judged),
placed AS (
  SELECT s.doc_id, s.source, s.size, s.key, t.source_size, t.target, t.budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ending
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS spent
  FROM (SELECT p.*, CAST(ending + epoch * source_size AS DOUBLE) / target AS finish
        FROM placed p, (VALUES (0), (1)) AS e(epoch) WHERE size > 0)),
counted AS (SELECT doc_id, source, size, key, ending, sum(size) AS taken FROM queue WHERE spent <= budget GROUP BY ALL)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target, CAST(coalesce(c.taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN counted c
  ON p.doc_id IS NOT DISTINCT FROM c.doc_id AND p.source IS NOT DISTINCT FROM c.source AND p.size = c.size AND p.ending = c.ending
"""
