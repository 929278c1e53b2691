"""Reading raw files, writing cleaned, curated and mart tables, and comparing tables by fingerprint."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.functions.columns import dataset_of
from forgeline.operators import clean as cleaning
from forgeline.operators import contracts
from forgeline.sources.scratch import cut, released, written


def discover_files(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(dataset, path): for each data set the first file by name that its patterns fit. Only names are listed, no content is read.

    A file whose own name fits none counts as part of its folder, if that one's name does; the folder's path is given then.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    own = dataset_of(F.col("path"), strict)
    found = names.select(F.coalesce(own, dataset_of(parent, strict)).alias("dataset"), F.when(own.isNull(), parent).otherwise(F.col("path")).alias("path"))
    return found.filter("dataset IS NOT NULL").groupBy("dataset").agg(F.min("path").alias("path"))


def infer_dataset(name: str) -> str:
    """The data set of one file name; an unknown one is an error."""
    from forgeline.functions.columns import DATASET_PATTERNS

    base = name.replace("\\", "/").rsplit("/", 1)[-1].lower()
    for dataset, patterns in DATASET_PATTERNS.items():
        if any(p in base for p in patterns):
            return dataset
    raise ValueError(f"no data set is known for {name!r}")


def read_csv(spark: SparkSession, path: str, dataset: str | None = None, dates: bool = False) -> DataFrame:
    """A CSV file with a header, gzip too, a byte order mark allowed; every column as text, and date columns as dates if asked."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return cleaning.parse_dates(df) if dates else df


#: The column that holds a line which doesn't have the header's cells.
CORRUPT = "_corrupt"


def read_numbered(spark: SparkSession, path: str, multi_line: bool = False, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """CSV files with one header: every column as text, with `file`, `row_index` and `_corrupt`; written once to the checkpoint folder.

    row_index is a row's place among its file's rows, from 0, without the header and blank lines. Rows are read by file block; each block counts
    its own, and the counts of the blocks before it in the file are added, so that no task reads a file whole. `_corrupt` has the line where
    the cells are more or fewer than the header's, else null. With `multi_line` quoted cells may hold line breaks, and a file is read by one task.
    `judge` may add columns to the rows before they are written.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multi_line)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    reader = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.csv(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    rows = rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])
    rows = written(judge(rows) if judge else rows, "numbered")
    blocks = rows.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.select("file", "__block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__offset"))
    # a row for each block, of which the driver has a list anyway: the rows themselves are never shuffled
    return rows.join(F.broadcast(placed), ["file", "__block"]).withColumn("row_index", F.col("__id") + F.col("__offset")).drop("__block", "__id", "__offset")


def malformed(rows: DataFrame) -> DataFrame:
    """The broken lines of `read_numbered` as violations: file, row_index, ord, field, value, rule."""
    return rows.filter(F.col(CORRUPT).isNotNull()).select("file", "row_index", F.lit(-1).alias("ord"), F.lit("__row__").alias("field"), F.col(CORRUPT).alias("value"), F.lit("malformed_row").alias("rule"))


def whole(rows: DataFrame) -> DataFrame:
    """The other lines of `read_numbered`."""
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def validate_csv(spark: SparkSession, path: str, dataset: str | None = None, as_of: str | None = None) -> DataFrame:
    """The contract violations of CSV files, broken lines among them, by file and the row's place in it."""
    rows = read_numbered(spark, path)
    return contracts.violations(whole(rows), dataset or infer_dataset(path), ["file", "row_index"], as_of).unionByName(malformed(rows))


def save_processed(df: DataFrame, folder: str, dataset: str, run_id: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{dataset}/run_id={run_id}")


def export_silver(df: DataFrame, path: str, form: str = "parquet") -> int:
    """Snappy Parquet or gzip CSV; the number of rows is observed while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if form == "parquet":
        writer.option("compression", "snappy").parquet(path)
    else:
        writer.option("compression", "gzip").option("header", True).csv(path)
    return seen.get["rows"]


def export_gold(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as Parquet and CSV, and the manifest: name, rows, columns."""
    rows = []
    for name, df in tables.items():
        n = export_silver(df, f"{folder}/{name}.parquet")
        spark.read.parquet(f"{folder}/{name}.parquet").write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
        rows.append((name, n, len(df.columns)))
    return spark.createDataFrame(rows, "name string, rows long, columns int")


def write_marts(marts: dict[str, DataFrame]) -> None:
    """Each mart as a managed table, replaced as a whole: running again changes nothing."""
    for name, df in marts.items():
        df.write.mode("overwrite").saveAsTable(name)


def query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def mart_row_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """Rows of each mart, -1 where there is no such table."""
    parts = [spark.table(n).agg(F.lit(n).alias("mart"), F.count(F.lit(1)).alias("rows")) if spark.catalog.tableExists(n) else spark.range(1).select(F.lit(n).alias("mart"), F.lit(-1).cast("long").alias("rows")) for n in names]
    return reduce(DataFrame.unionByName, parts)


def write_quarantine(rows: DataFrame, path: str, run_id: str, dataset: str) -> None:
    """A run's quarantine of one data set, in a folder of its own: run again, it replaces what the run wrote before, be it empty now."""
    rows.drop("run_id", "dataset").write.mode("overwrite").parquet(f"{path}/run_id={run_id}/dataset={dataset}")


def scan_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines with their file): each line is in one of both. A line that isn't a JSON object, or has a value of another type, is broken."""
    kinds = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(CORRUPT, T.StringType())])
    lines = cut(spark.read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path).select("*", F.col("_metadata.file_path").alias("__file")))
    broken = F.col(CORRUPT).isNotNull()
    return lines.filter(~broken).drop(CORRUPT, "__file"), lines.filter(broken).select(F.col("__file").alias("file"), F.col(CORRUPT).alias("line"), F.lit("malformed_json").alias("reason"))


def read_request_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; those that don't parse are left out (`scan_json_lines` has them)."""
    return scan_json_lines(spark, path, schema)[0]


def export_report(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def listing(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, rows, columns)."""
    parts = [df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")) for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, non_null, nulls) from one aggregate over all columns."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("non_null"), (F.col("__n") - F.col(f.name)).alias("nulls")) for f in df.schema])
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def fingerprint(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, rows, columns, content): content sums 60 bits of the MD5 of every row, whatever their order.

    A row's text has its columns by name, whole numbers, texts and dates as they are, doubles with four digits after the point, a
    tilde for null, so that other engines get the same.
    """
    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.coalesce((F.round(c, 4).cast("decimal(38,4)") if f.dataType.typeName() in ("double", "float") else c).cast("string"), F.lit("~"))

    parts = []
    for name, df in datasets.items():
        line = F.concat_ws("|", *[text(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])
        digest = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(38,0)")
        parts.append(df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("content")))
    return reduce(DataFrame.unionByName, parts)


def verify(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(dataset, result): ok, mismatch, missing or extra."""
    a, e = actual.alias("a"), expected.alias("e")
    both = a.join(e, F.col("a.dataset") == F.col("e.dataset"), "full_outer")
    same = (F.col("a.rows") == F.col("e.rows")) & (F.col("a.columns") == F.col("e.columns")) & (F.col("a.content") == F.col("e.content"))
    result = F.when(F.col("a.dataset").isNull(), "missing").when(F.col("e.dataset").isNull(), "extra").when(same, "ok").otherwise("mismatch")
    return both.select(F.coalesce("a.dataset", "e.dataset").alias("dataset"), result.alias("result"))


def run_etl(spark: SparkSession, folder: str, out: str, run_id: str, as_of: str | None = None) -> dict[str, DataFrame]:
    """Raw CSV files to cleaned tables: contracts first, violations into this run's quarantine, the rest cleaned and saved.

    Broken lines go to the quarantine too. A run again with the same id leaves the same tables. Of each data set one file counts, the first by name.
    What is written on the way to a data set's tables goes when they are there.
    """
    done, key = {}, ["file", "row_index"]
    for row in discover_files(spark, folder).collect():
        dataset = row["dataset"]
        with released(spark):
            rows = read_numbered(spark, row["path"], judge=lambda lines, dataset=dataset: contracts.with_violations(lines, dataset, as_of))
            kept, rejected = contracts.gate_judged(whole(rows), dataset, key, row["path"], run_id)
            bad = contracts.quarantine(malformed(rows), key, dataset, row["path"], run_id)
            write_quarantine(rejected.unionByName(bad), f"{out}/quarantine", run_id, dataset)
            save_processed(cleaning.clean(kept.drop(*key), few_copies=True), out, dataset, run_id)
        done[dataset] = spark.read.parquet(f"{out}/{dataset}/run_id={run_id}")
    return done
