"""Line deduplication that returns compressed keep bitmaps instead of texts.

Hashes of lines are range-partitioned with a secondary sort by document and
position, so each range streams past once: the first document of a hash (the
largest id, as ids are sorted downwards) keeps its lines and the later ones lose
theirs. A hash held by very many lines would fill one range; such hashes, of
which there can be only a few, are counted with partial sums instead and never
meet in one task. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, load

WHITE = " \t\n\x0b\f\r"
#: A hash on more lines than this, or than one in `SHARE` of all, is not streamed.
HOT_LINES = 5_000
SHARE = 20_000
_BUCKETS = 65_536


def line_key(line: Column) -> Column:
    """What makes two lines equal: no white space at either end, A-Z folded."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(WHITE)), upper, upper.lower())


def text_id(text: Column) -> Column:
    """Tells rows of the same id apart; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """(doc_id, text_id, n_dropped, keep) of the documents that lose lines.

    `keep` is the document's keep bitmap as its runs of ones: (first line, number
    of lines), lines numbered from 0. Documents that are not returned keep all.

    Lines whose key has at least `min_chars` code points and is found in at least
    `min_docs` documents are dropped except in the largest id that holds the key.
    A null or empty text is one empty line. Rows with equal ids are one document
    for counting, and each keeps or loses its own lines; a null id counts as one
    document, smaller than all others. Other columns are not read.
    """
    split = docs.select(F.col(id_col).alias("doc_id"), text_id(F.col(text_col)).alias("text_id"), _lines(F.col(text_col)).alias("lines"))
    exploded = split.select("doc_id", "text_id", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    keyed = exploded.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    lines = cut(
        keyed.select("doc_id", "text_id", "n", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines"
    )
    hot = cut(_hot_hashes(lines), "hot")

    # At most SHARE hashes can be hot, so they may go to every executor.
    dropped = _dropped_hot(lines, F.broadcast(hot), min_docs).unionByName(
        _dropped_streaming(lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti"), min_docs)
    )
    lost = dropped.groupBy("doc_id", "text_id", "n").agg(F.array_sort(F.collect_set("pos")).alias("lost"))
    return lost.select("doc_id", "text_id", F.size("lost").cast("long").alias("n_dropped"), keep_runs(F.col("lost"), F.col("n")).alias("keep"))


def _hot_hashes(lines: DataFrame) -> DataFrame:
    """(h1, h2) on more lines than the limit; a hash can only be one if its bucket is."""
    total = lines.count()
    limit = max(HOT_LINES, total // SHARE)
    bucket = F.pmod("h1", F.lit(_BUCKETS))
    full = lines.groupBy(bucket.alias("bucket")).count().where(F.col("count") > limit).select("bucket")
    return (
        lines.withColumn("bucket", bucket)
        .join(F.broadcast(full), "bucket", "left_semi")
        .groupBy("h1", "h2")
        .count()
        .where(F.col("count") > limit)
        .select("h1", "h2")
    )


def _dropped_hot(lines: DataFrame, hot: DataFrame, min_docs: int) -> DataFrame:
    of_hot = lines.join(hot, ["h1", "h2"])
    kept = (
        of_hot.select("h1", "h2", "doc_id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("first"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "first")
    )
    # One row per hot hash, so no more rows than `hot` has.
    return of_hot.join(F.broadcast(kept), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text_id", "n", "pos")


def _dropped_streaming(lines: DataFrame, min_docs: int) -> DataFrame:
    by_document = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    ranged = lines.repartitionByRange("h1", "h2").sortWithinPartitions(*by_document, "pos")
    same = Window.partitionBy("h1", "h2")
    place = F.dense_rank().over(same.orderBy(by_document[2]))
    ranked = ranged.select("h1", "h2", "doc_id", "text_id", "n", "pos", place.alias("place"))
    held = F.max("place").over(same.orderBy(by_document[2]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("held", held).where((F.col("held") >= min_docs) & (F.col("place") > 1)).select("doc_id", "text_id", "n", "pos")


def keep_runs(lost: Column, n: Column) -> Column:
    """Runs of kept lines between the sorted numbers of lost ones."""
    edges = F.concat(F.array(F.lit(-1)), lost, F.array(n))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(lost) + 1),
        lambda i: F.struct(
            (F.element_at(edges, i) + 1).alias("first"), (F.element_at(edges, i + 1) - F.element_at(edges, i) - 1).alias("lines")
        ),
    )
    return F.filter(runs, lambda r: r["lines"] > 0)


def apply_keep(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `docs` with (n_lines, n_dropped, kept_text) after them.

    `kept_text` joins the lines that the bitmaps keep by line feeds; a null text is
    an empty one. Columns of `docs` that have one of these names are replaced.
    """
    names = ("n_lines", "n_dropped", "kept_text")
    same = docs[id_col].eqNullSafe(bitmaps["doc_id"]) & (text_id(docs[text_col]) == bitmaps["text_id"])
    lines = _lines(docs[text_col])
    runs = F.flatten(F.transform(bitmaps["keep"], lambda r: F.slice(lines, r["first"] + 1, r["lines"])))
    kept = F.when(bitmaps["keep"].isNull(), F.coalesce(docs[text_col], F.lit(""))).otherwise(F.array_join(runs, "\n"))
    return docs.join(bitmaps, same, "left").select(
        *[docs[c] for c in docs.columns if c not in names],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(bitmaps["n_dropped"], F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_keep(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
held AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN held USING (key)
GROUP BY doc_id
"""
