"""Cutting long lineages with tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="smilegrid-checkpoint-", dir="/tmp"))


_folders: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, reachable by every executor."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Delete the stages that this session has written; frames that read them are no longer usable."""
    context = spark.sparkContext
    folders = _folders.pop(context.applicationId, [])
    for folder in folders:
        _delete(spark, folder)
    return len(folders)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """Stages stored inside are deleted on leaving, but for the last one, the result: no frame may read them later."""
    folders = _folders.setdefault(spark.sparkContext.applicationId, [])
    before = set(folders)
    yield
    for folder in [f for f in folders if f not in before][:-1]:
        _delete(spark, folder)
        folders.remove(folder)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Files through which a stage stored inside was shuffled are deleted once it is stored; else they stay until
    the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, name: str = "stage", **options) -> DataFrame:
    """Materialise a frame that several later operators read.

    The rows go to a compressed columnar table in the shared folder: it survives
    lost executors, and its readers get column pruning, filter pushdown and true
    sizes for the planner instead of recomputing the chain. `options` are of the writer.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
