"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Whole passes over a source come first; what remains of
its budget is less than the source. A bounded knapsack's dynamic programming says how many more documents
of which length meet it exactly or as nearly as possible from below. Its table has one cell a word, so it covers
the last `covered` words; what lies above them takes the same share of every length. The
documents of each length are then chosen in the order of a seeded hash of id and text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.llm.common import WORD, quoted, written

#: The words of a budget that the dynamic programming covers: its memory and time, whatever the budget. More words make
#: no better fit, as the lengths left over by the share below are those of the whole source.
KNAPSACK_WORDS = 1 << 16
#: Documents of one length that are ordered together when some of them are chosen.
CHOSEN_TOGETHER = 1 << 10


def words_of(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, total_share: float = 1.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_passes: int = 3) -> DataFrame:
    """(source, source_size) with `target`, for one row a source.

    Sources by code point, null last, weigh `weights`, repeating. They share `total_share` of all
    sizes by weight. A target stops at `most_passes` times its source's size, and the excess is
    reshared by weight until none is above. With the sources in the order of size over weight,
    those that stop come first, so one running sum finds the level of the others. The windows run over
    one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.alias("w"), (F.lit(float(most_passes)) * F.col("source_size")).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    budget = F.sum("source_size").over(every) * F.lit(total_share)
    left = budget - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    heavy = F.sum("w").over(every) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0))
    share = w.withColumn("level", left / heavy).withColumn("place", F.row_number().over(by_ratio))
    # the first source whose cap isn't reached sets the level for itself and all after it
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct("place", "level"))).over(every)["level"]
    return share.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many items of each length sum to the largest total within `budget`; each length at most `counts` times."""
    first = np.full(budget + 1, -1, dtype=np.int64)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        left, times = min(int(counts[i]), budget // int(lengths[i])), 1
        while left > 0 and not reached[budget]:
            times = min(times, left)
            weight = times * int(lengths[i])
            new = np.flatnonzero(reached[: budget + 1 - weight] & ~reached[weight:]) + weight
            first[new], reached[new] = len(items), True
            items.append((int(i), times))
            left, times = left - times, 2 * times
    taken, total = np.zeros(len(lengths), dtype=np.int64), int(np.flatnonzero(reached)[-1])
    while total:
        i, times = items[first[total]]
        taken[i] += times
        total -= times * int(lengths[i])
    return taken


def fill(lengths: np.ndarray, counts: np.ndarray, target: float, most_passes: int, covered: int = KNAPSACK_WORDS) -> tuple[int, np.ndarray]:
    """Whole passes over a source, and how many documents of each length once more, to meet `target`.

    Of a rest above `covered` words, the same share of every length is taken (rounded down, then the longest
    first), until the dynamic programming can cover what is left; a smaller rest is covered from the start.
    """
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), dtype=np.int64)
    if total == 0:
        return 0, extra
    budget = min(int(target + 1e-6), most_passes * total)
    passes, rest = divmod(budget, total)
    extra = np.array([int(n) * max(0, rest - covered) // total for n in counts.tolist()], dtype=np.int64)
    rest -= int((extra * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):  # rounding down left at most one document of each length
        if rest <= covered:
            break
        more = min(int(counts[i] - extra[i]), (rest - covered // 2) // max(1, int(lengths[i])))
        extra[i] += more
        rest -= more * int(lengths[i])
    open_ = np.flatnonzero((lengths > 0) & (counts > extra) & (lengths <= rest))
    if rest and len(open_):
        extra[open_] += knapsack(lengths[open_], counts[open_] - extra[open_], int(min(rest, covered)))
    return passes, extra


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_passes: int = 3, seed: int = 42, keep: tuple[str, ...] = (), covered: int = KNAPSACK_WORDS) -> DataFrame:
    """One row for each row of df: doc_id, size, source_size, target, taken, and the columns in `keep`.

    taken is the number of words the mix takes of the document: its size times how often it is
    repeated, from 0 to `most_passes` times. Null texts have size 0; null sources form one source;
    null ids are rows like others. Which documents of a length are taken depends on seed, id and text alone, so
    that documents without an id, or with the same one, are told apart by their texts. Rows that repeat
    both id and text are documents of their own: how many of them are chosen is fixed, and they don't
    differ. Other columns don't count. An empty table gives no rows. Very long texts count whole; one alone may be more than a target leaves. The
    sources' targets are worked out over one row a source, in one task. `covered`: see `fill`.
    """
    kept = [quoted(c) for c in keep]
    docs = df.select(quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"), words_of(quoted(text_col)).alias("size"), *kept, F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("__id"), F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    docs = docs.withColumn("order", F.xxhash64(F.lit(seed), "__id", "__text")).withColumn("tie", F.xxhash64(F.lit(seed + 1), "__id", "__text")).drop("__id", "__text")
    docs = written(docs, "sizes")
    lengths = written(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = targets(sizes, total_share, weights, most_passes).withColumnRenamed("source", "s")
    planned = lengths.join(wanted, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        passes, extra = fill(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"].iloc[0]), most_passes, covered)
        return pdf.assign(passes=passes, extra=extra)

    # one row a length: a source of S words has fewer than sqrt(2 S) lengths
    plans = planned.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, passes int, extra long")
    plans = written(plans.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / CHOSEN_TOGETHER)).cast("long")), "plans")

    # of n documents of a length, `extra` are chosen: whole buckets of the hash, and a part of one bucket. Plans and quotas grow with the
    # documents, so they are never sent to all tasks; a length that many documents share is a hot key, which AQE splits
    spread = F.floor((F.shiftrightunsigned("order", 32).cast("double") / F.lit(float(1 << 32))) * F.col("buckets")).cast("long")
    rows = docs.join(plans.hint("merge"), docs["source"].eqNullSafe(plans["source"]) & (docs["size"] == plans["size"])).select("doc_id", docs["source"], docs["size"], "order", "tie", *kept, "source_size", "target", "passes", "extra", "n", spread.alias("bucket"))
    part = rows.filter("extra > 0 AND extra < n")
    filled = part.groupBy("source", "size", "bucket", "extra").agg(F.count(F.lit(1)).alias("in_bucket"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quotas = filled.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("size").alias("l"), F.col("bucket").alias("b"), F.greatest(F.lit(0), F.least("in_bucket", F.col("extra") - F.col("ahead"))).alias("quota"), "in_bucket")
    quotas = written(quotas, "quotas")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")) & (F.col("bucket") == F.col("b"))
    parted = rows.join(quotas.hint("merge"), same, "left")
    once = F.when(F.col("extra") >= F.col("n"), 1).when(F.col("extra") <= 0, 0).when(F.col("quota") >= F.col("in_bucket"), 1).when(F.col("quota") <= 0, 0)
    settled = written(parted.withColumn("once", once), "settled")
    ranked = settled.filter("once IS NULL").withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order", "tie"))).withColumn("once", (F.col("place") <= F.col("quota")).cast("int")).drop("place")
    chosen = settled.filter("once IS NOT NULL").unionByName(ranked)
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("once"))).cast("long").alias("taken"), *kept)
