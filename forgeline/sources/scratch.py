"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: The folders that `written` has filled in each block of `released` that is open now, the innermost last.
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors share.

    Where spark.checkpoint.dir is unset, a local master takes a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="forgeline-")
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read again, so that a lost executor costs one step."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """As `cut`, but as Parquet: for whole tables, of which a checkpoint would hold every row uncompressed."""
    folder = new_folder(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What `written` writes in this block is deleted at its end, when no result that reads it may be needed any more."""
    _OPEN.append([])
    try:
        yield
    finally:
        for folder in _OPEN.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
