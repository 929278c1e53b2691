"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and mapped to random cosines, which approximate a
Gaussian kernel. Every partition sums the normal equations of its labelled rows; the sums are added
up and solved on the driver, where only a few matrices of a fixed size arrive. The sums are kept by fold, so
that every labelled row also has a score from a model that has not seen it; those scores, counted
in bins, are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.llm.common import quoted, slices, without, written

#: Random features, ridge penalty, kernel width (of standardised statistics), bins of the calibration.
FEATURES, RIDGE, WIDTH, BINS = 384, 1e-3, 4.0, 2048
#: A document is accepted from this score on.
ACCEPT = 0.3
#: Folds of the labelled rows (by a hash of the statistics, so that copies share one): their sums come to the driver.
FOLDS = 4
#: Groups of partitions whose sums are added up first, each in a task of its own.
GROUPS = 256

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: The ends of words and sentences in ordinary text.
_PLAIN = [ord(c) for c in ".,;:?'-\"()"]
STATISTICS = ("log_words", "word_length", "upper", "digit", "punct", "odd_punct", "doubled_punct", "lone_punct", "repeated_word", "repeated_pair", "distinct", "repeated_line", "line_words", "one_word_share")


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; shares are of its characters, words or lines."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(codes, minlength=256)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    punct = int(counts[_PUNCT].sum())
    marks = _PUNCT[codes]
    doubled = int(np.count_nonzero(marks[1:] & (codes[1:] == codes[:-1])))
    lone = sum(1 for w in words if len(w) == 1 and _PUNCT[w[0]])
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = set(zip(words, words[1:], strict=False))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    times = Counter(words)
    distinct, most = len(times), max(times.values())
    chars = len(codes)
    share = lambda x, of: float(np.log(1e-3 + x / max(1, of)))
    return [
        float(np.log1p(n)),
        float(np.log((chars - int(counts[[9, 10, 11, 12, 13, 32]].sum())) / n)),
        share(upper, upper + lower),
        share(digits, chars),
        share(punct, chars),
        share(punct - int(counts[_PLAIN].sum()), chars),
        share(doubled, chars),
        share(lone, n),
        share(again, n),
        share(n - 1 - len(pairs), n),
        float(np.log(distinct / n ** 0.8)),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log(n / max(1, len(lines)))),
        share(most, n),
    ]


@dataclass
class Model:
    """What scoring needs: a few kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return np.interp(self.cosines(x) @ self.weights, self.knots, self.values)


def isotonic(means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence in weighted squares, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for m, w in zip(means.tolist(), weights.tolist(), strict=True):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, n2 = pools.pop()
            m1, w1, n1 = pools[-1]
            pools[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([[m] * int(n) for m, _, n in pools]) if pools else np.empty(0)


def features(df: DataFrame, text_col: str = "text", out: str = "statistics", keep_text: bool = False) -> DataFrame:
    """df with the statistics of each whole text (null: empty) as array<double>; `text_col` itself only with keep_text."""
    rest = [c for c in without(df, [out]).columns if c != text_col]
    work = df.select(*[quoted(c) for c in rest], quoted(text_col))
    kept = [*rest, text_col] if keep_text else rest
    schema = T.StructType([*[work.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.DoubleType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pa.compute.fill_null(pa.compute.binary_length(batch.column(len(rest))), 0).to_pylist(), 1 << 22):
                part = batch.slice(a, b - a)
                found = pa.array([statistics(t or "") for t in part.column(len(rest)).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], found], names=[*kept, out])

    return work.mapInArrow(run, schema)


def solved(total: np.ndarray, n: float) -> np.ndarray:
    """The ridge weights of summed normal equations of n rows; the last weight, the constant's, is free."""
    size = FEATURES + 1
    penalty = RIDGE * n * np.eye(size) / FEATURES
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(total[:, :size] + penalty, total[:, size])


def fit(labelled: DataFrame, label_col: str = "label", stats_col: str = "statistics", seed: int = 42) -> Model:
    """The model of all rows whose label is 0 or 1. Without any, every score is 0.5."""
    rows = labelled.filter(quoted(label_col).isin(0, 1)).select(quoted(label_col).cast("double").alias("y"), quoted(stats_col).alias("x"), F.pmod(F.xxhash64(quoted(stats_col)), F.lit(FOLDS)).cast("int").alias("fold"))
    d = len(STATISTICS)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    rng = np.random.default_rng(seed)
    directions, phases = rng.standard_normal((d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    empty = Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if not sums["n"]:
        return empty
    mean, scale = np.array([sums[f"m{i}"] for i in range(d)]), np.array([sums[f"s{i}"] for i in range(d)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), directions, phases, empty.weights, empty.knots, empty.values)
    size = FEATURES + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, size, size + 1))
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                z = model.cosines(np.stack(part["x"].to_numpy()))
                total[fold] += z.T @ np.column_stack([z, part["y"].to_numpy()])
        seen = np.flatnonzero(total[:, -1, -2])
        if len(seen):
            yield pd.DataFrame({"fold": seen.astype("int32"), "sums": list(total.reshape(FOLDS, -1)[seen])})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for fold, one in zip(pdf["fold"], pdf["sums"], strict=True):
                total[fold] = total.get(fold, 0.0) + one
        if total:
            yield pd.DataFrame({"fold": list(total), "sums": list(total.values())})

    shape = "fold int, sums array<double>"
    grouped = rows.mapInPandas(equations, shape).withColumn("group", F.spark_partition_id() % GROUPS).repartition("fold", "group")
    parts = grouped.select("fold", "sums").mapInPandas(added, shape).repartition(FOLDS, "fold").mapInPandas(added, shape).collect()
    by_fold = np.zeros((FOLDS, size, size + 1))
    for p in parts:
        by_fold[p["fold"]] += np.array(p["sums"]).reshape(size, size + 1)
    total, n = by_fold.sum(axis=0), by_fold[:, -1, -2]
    model.weights = solved(total, n.sum())
    # the weights without each fold; those of all rows where a fold holds them all
    others = np.column_stack([solved(total - by_fold[k], n.sum() - n[k]) if n[k] < n.sum() else model.weights for k in range(FOLDS)])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, ones = np.zeros(BINS), np.zeros(BINS)
        for pdf in batches:
            if len(pdf):
                raw = np.take_along_axis(model.cosines(np.stack(pdf["x"].to_numpy())) @ others, pdf["fold"].to_numpy()[:, None], axis=1)[:, 0]
                at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
                n += np.bincount(at, minlength=BINS)
                ones += np.bincount(at, weights=pdf["y"].to_numpy(), minlength=BINS)
        full = np.flatnonzero(n)
        yield pd.DataFrame({"bin": full.astype("int32"), "n": n[full], "ones": ones[full]})

    bins = rows.mapInPandas(binned, "bin int, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toPandas().sort_values("bin")
    model.knots = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    model.values = np.clip(isotonic(bins["ones"].to_numpy() / bins["n"].to_numpy(), bins["n"].to_numpy()), 0, 1)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """The model of `labels` (id, label) and `stats` (id, statistics), without what is held out."""
    known = labels.select(quoted(id_col).alias("__id"), quoted(label_col).alias("label")).filter(F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    return fit(written(stats.select(quoted(id_col).alias("__id"), "statistics").join(known, "__id").select("label", "statistics"), "labelled"))


def scored(stats: DataFrame, model: Model, stats_col: str = "statistics", out: str = "score") -> DataFrame:
    """`stats` with each row's score in place of the statistics."""
    rest = [c for c in without(stats, [out]).columns if c != stats_col]
    schema = T.StructType([*[stats.schema[c] for c in rest], T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(len(rest)).to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], names=[*rest, out])

    return stats.select(*[quoted(c) for c in rest], quoted(stats_col)).mapInArrow(run, schema)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from score `accept` on) for each row of df.

    Null texts count as empty and are scored like others. Labels that are null or other than 0 and
    1, or of unknown documents, teach nothing; a document labelled twice teaches twice. Repeated rows
    stay, an empty table gives no rows, and no other column is read. Statistics are those of whole texts, however long.
    """
    docs = df.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    stats = written(features(docs), "statistics")
    model = train(stats, labels.select(quoted(id_col).alias("doc_id"), quoted(label_col).alias("quality")))
    return scored(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
