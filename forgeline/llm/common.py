"""What the operators of this subpackage share: scratch tables, column clashes, text cleaning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts of this subpackage define it: what ends a word.
WORD = r"[^\x20\x09-\x0D]+"


#: The folders below the application's own in which tables are written now, the innermost last.
_SCOPES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where it is unset, a temporary folder serves a local master, whose driver and executors are one machine; on a
    cluster that is an error, as parts of a table would be left on each executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = spark.conf.get("forgeline.scratch.dir", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="forgeline-")
            spark.conf.set("forgeline.scratch.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again.

    It cuts the lineage and outlives lost executors. Each call uses a new folder.
    """
    path = "/".join([_own_dir(df.sparkSession), *_SCOPES, f"{name}-{uuid.uuid4().hex}"])
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/forgeline/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope() -> Iterator[str]:
    """The name of a new folder in which all tables of this block are written, for `forget`."""
    _SCOPES.append(uuid.uuid4().hex)
    try:
        yield "/".join(_SCOPES)
    finally:
        _SCOPES.pop()


def forget(spark: SparkSession, name: str) -> None:
    """Deletes the tables that were written in a `scope`, once no result that reads them is needed any more."""
    _delete(spark, f"{_own_dir(spark)}/{name}")


def clear(spark: SparkSession) -> None:
    """Deletes this application's scratch tables, once no result that reads them is needed any more."""
    _delete(spark, _own_dir(spark))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written with a column __row that tells its rows apart, repeated ones too."""
    return written(df.withColumn("__row", F.monotonically_increasing_id()), name)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns whose names, in any case, an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes: list[int], most: int, rows: int = 2048) -> Iterable[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `most`, so that no output batch grows with the input batch."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most or i + 1 - begin >= rows:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)
