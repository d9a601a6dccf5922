"""The corpus pipeline: from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept. All but the last return the columns of `documents`; the last adds how many
words the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smilegrid.llm import decontaminate, line_dedup, ngram_join, quality_knn, source_mix
from smilegrid.llm.tables import NUMBERING, broadcast_below, cut, load, numbered
from smilegrid.plans.lineage import passing_stages


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns that have one of the names renamed, and what brings them back."""
    taken, back = {*docs.columns, *names}, {}
    for name in names:
        if name in docs.columns:
            new = name
            while new in taken:
                new = "own_" + new
            taken.add(new)
            back[new] = name
    return docs.withColumnsRenamed({old: new for new, old in back.items()}), back


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled ones vote for; null and empty texts get the overall vote."""
    model = quality_knn.fit(docs, load(spark, sf_dir, "labels"))
    docs, back = _aside(docs, "score")
    good = quality_knn.score(docs, model).where(F.col("score") >= quality_knn.KEEP_FROM)
    return good.drop("score").withColumnsRenamed(back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that a later document repeats; n_chars follows the text.
    Documents that lose all their lines stay, empty."""
    docs, back = _aside(docs, "n_lines", "n_dropped", "kept_text")
    kept = line_dedup.apply_keep(docs, line_dedup.keep_bitmaps(docs))
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumns(new).select(*docs.columns).withColumnsRenamed(back)


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """A stored copy of `docs` with its rows numbered by _row, and what brings set-aside names back."""
    docs, back = _aside(docs, "_row", *NUMBERING)
    return numbered(docs, "_row"), back


def _without(docs: DataFrame, dropped: DataFrame, back: dict[str, str]) -> DataFrame:
    return docs.join(broadcast_below(dropped), "_row", "left_anti").drop("_row").withColumnsRenamed(back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that of the smallest id (a null id last, ties by a digest of the text).
    Rows are judged one by one, so rows that share an id, or have none, stay or go by their own text.
    Texts without words are no copies of each other; of such rows with one id and text one stays."""
    docs, back = _numbered(docs)
    with passing_stages(spark):
        found = ngram_join.near_duplicates(docs, "_row").withColumnRenamed("doc_id", "_row")
        facts = docs.select("_row", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
        empty = F.col("n_shingles") == 0
        alone = [F.when(empty, F.col(c)).alias(f"own_{c}") for c in ("doc_id", "digest")]
        rows = cut(found.join(facts, "_row").select("_row", "doc_id", "digest", F.when(~empty, F.col("component_id")).alias("group"), *alone), "groups")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "_row"))
        kept = rows.groupBy("group", "own_doc_id", "own_digest").agg(first["_row"].alias("_row"))
        copies = cut(rows.join(kept, "_row", "left_anti").select("_row"), "copies")
    return _without(docs, copies, back)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. Every row is judged by its own text."""
    docs, back = _numbered(docs)
    with passing_stages(spark):
        found = decontaminate.contamination(docs, load(spark, sf_dir, "benchmark"), "_row")
        hit = cut(found.where("hits is not null").select(F.col("doc_id").alias("_row")), "contaminated")
    return _without(docs, hit, back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, source_size, target and taken.
    Rows with one id take what the first of them takes."""
    ends = cut(source_mix.reached(source_mix.mix(docs)), "reached").withColumnsRenamed({"source": "_from", "source_size": "_size", "target": "_target"})
    added = ("size", "source_size", "target", "taken")
    plain, back = _aside(docs, *added, *ends.columns)
    sized = plain.withColumn("size", source_mix.word_count(plain["text"]))
    # A row per source meets the texts where they are: no text is shuffled.
    joined = sized.join(broadcast_below(ends), sized["source"].eqNullSafe(ends["_from"]))
    place = source_mix.place(F.col("doc_id"), F.col("size"))
    times = F.size(F.filter("last", lambda end: place <= end))
    kept = [F.col(c).alias(back.get(c, c)) for c in plain.columns if back.get(c, c) not in added]
    return joined.where((F.col("size") > 0) & (times > 0)).select(
        *kept, "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * times).alias("taken")
    )


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmarks),
    ("mixing sources to target weights", mixture),
]

#: The quality votes are not expressible in SQL; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored before the next one reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
