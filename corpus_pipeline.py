"""The corpus pipeline: quality, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs, before that stage is called. All but the last return the columns of documents.

In every stage null texts count as empty, null ids, languages and sources are values like others, repeated rows are rows of their own, very long texts
are handled whole, each by one task, columns that are added to documents (of whatever name) are left out, and no documents give none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.llm import byte_bpe, mixing, near, pii, quality
from forgeline.llm.common import forget, numbered, scope, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: (stage, scope) of the tables that stages wrote for themselves and that are not deleted yet.
_OWN: list[tuple[str, str]] = []


def _tidy(stage: Stage) -> Stage:
    """The stage, which first deletes what other stages wrote for themselves: its docs were written after those."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for entry in [e for e in _OWN if e[0] != stage.__name__]:
            forget(spark, entry[1])
            _OWN.remove(entry)
        with scope() as name:
            _OWN.append((stage.__name__, name))
            return stage(spark, docs, sf_dir)

    return run_stage


@_tidy
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; labels that are held out teach nothing. Each text's statistics are computed once.

    A document whose score is the limit stays.
    """
    rows = written(quality.features(docs.select(*COLUMNS), keep_text=True), "statistics")
    model = quality.train(rows.select("doc_id", "statistics"), table(spark, sf_dir, "labels"))
    return quality.scored(rows, model).filter(F.col("score") >= quality.ACCEPT).select(*COLUMNS)


@_tidy
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard of 0.8 or more) the document with the smallest id (null last).

    SimHash's index links what it can; `near` says why bands of MinHashes must find the rest.
    """
    rows = numbered(docs.select(*COLUMNS), "documents")
    return rows.join(near.firsts(rows.select("__row", "doc_id", "text")), "__row", "left_semi").select(*COLUMNS)


@_tidy
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars is that of the new text, null for a null text, which stays null."""
    return pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


@_tidy
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times or not at all; a document without words has no share and goes."""
    rows = numbered(docs.select(*COLUMNS), "documents")
    mixed = mixing.mix(rows, keep=("__row",)).filter("taken > 0")
    times = mixed.select("__row", F.expr("CAST(taken DIV size AS INT)").alias("times"))
    return rows.join(times, "__row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__time")).drop("__time")


@_tidy
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, and their number; no ids for a null or empty text."""
    coded = byte_bpe.encode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Once a stage's result is written, its docs are deleted (the given table isn't)."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with scope() as written_in:
            docs = written(made, f"pipeline-{name}")
        if kept:
            forget(spark, kept)
        kept = written_in
    return STAGES[-1][1](spark, docs, sf_dir)
