"""Exact top-k search for binary codes by incremental multi-index hashing.

Each block of codes is indexed once for every segment of the code. A query looks up its own segment
values first, then all values at one differing bit, and so on, one segment at a time. Once the
segments up to s were searched at radius r and the others at r - 1, a code not seen yet differs in
r * segments + s + 1 bits at least; the search ends when the kth verified distance is below that.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.llm.common import quoted, written
from forgeline.llm.vectors import answers, blocks, representatives, rows_of

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Rows of a block of codes and of a block of queries: at most, and at least while there are tasks for more blocks.
MOST_CODES, LEAST_CODES = 1 << 18, 1 << 14
MOST_QUERIES, LEAST_QUERIES = 1 << 16, 1 << 9


def sign_code(vector: Column) -> Column:
    """The signs of the first 64 components, 1 if positive, the first one highest."""
    return F.aggregate(F.slice(vector, 1, BITS), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))


def masks(radius: int) -> np.ndarray:
    """All segment values with `radius` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], dtype=np.int64)


class MultiIndex:
    """Codes by the value of each segment."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.tables = []
        for s in range(SEGMENTS):
            values = ((codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << WIDTH))])
            self.tables.append((np.argsort(values, kind="stable"), starts))
        self.masks: dict[int, np.ndarray] = {}

    def search(self, query: int, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the codes that can be among the k nearest, all equally distant ones included.

        copies: how many ids stand for each code.
        """
        q = np.uint64(query)
        seen = np.zeros(len(self.codes), dtype=bool)
        near = np.zeros(BITS + 1, dtype=np.int64)
        found: list[np.ndarray] = []
        distances: list[np.ndarray] = []
        for radius in range(WIDTH + 1):
            if radius not in self.masks:
                self.masks[radius] = masks(radius)
            for s, (order, starts) in enumerate(self.tables):
                values = self.masks[radius] ^ ((query >> (WIDTH * s)) & ((1 << WIDTH) - 1))
                begin, n = starts[values], starts[values + 1] - starts[values]
                begin, n = begin[n > 0], n[n > 0]
                at = order[np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)]
                at = at[~seen[at]]
                seen[at] = True
                d = np.bitwise_count(self.codes[at] ^ q)
                near += np.bincount(d, weights=copies[at], minlength=BITS + 1).astype(np.int64)
                found.append(at)
                distances.append(d)
                covered = radius * SEGMENTS + s  # every code within so many bits was seen
                if near[: covered + 1].sum() >= k:
                    at, d = np.concatenate(found), np.concatenate(distances)
                    kth = int(np.searchsorted(np.cumsum(near), k))
                    return at[d <= kth], d[d <= kth]
        return np.concatenate(found), np.concatenate(distances)


def top_k(df: DataFrame, k: int = 10, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance): for each row whose id is divisible by `every`, the k other rows whose sign codes differ least.

    The nearest come first, equal ones by smaller id; all other rows if there are fewer than k. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a null id, take no part.
    Vectors of under 64 components have shorter codes. Repeated rows count once. Extra columns
    don't count, and an empty table gives no rows.
    """
    spark = df.sparkSession
    coded = rows_of(df, id_col, vec_col).select("id", sign_code(F.col("vec")).alias("code"))
    coded = written(coded.distinct(), "codes")
    codes = written(representatives(coded, "code", k), "code-ids")
    queries = coded.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "code")
    asked = written(queries.select("code").distinct(), "asked")
    tasks = spark.sparkContext.defaultParallelism
    n_code, n_query = blocks(codes.count(), MOST_CODES, LEAST_CODES, tasks), blocks(asked.count(), MOST_QUERIES, LEAST_QUERIES, tasks)

    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, seed: F.pmod(F.xxhash64("code", F.lit(seed)), F.lit(n)).cast("int")
    left = codes.select("code", "ids", place(n_code, 1).alias("c"), spread(n_query).alias("q"))
    right = asked.select("code", spread(n_code).alias("c"), place(n_query, 2).alias("q"))

    def cell(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"code": [], "distance": [], "id": []}
        if len(block) and len(wanted):
            index = MultiIndex(block["code"].to_numpy().view(np.uint64))
            ids = list(block["ids"])
            copies = np.array([len(x) for x in ids])
            for code in wanted["code"].tolist():
                at, d = index.search(code & (2**64 - 1), copies, k + 1)
                best = sorted((int(dist), int(i)) for row, dist in zip(at.tolist(), d.tolist(), strict=True) for i in ids[row])[: k + 1]
                out["code"] += [code] * len(best)
                out["distance"] += [d for d, _ in best]
                out["id"] += [i for _, i in best]
        return pd.DataFrame(out).astype("int64")

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(cell, "code long, distance long, id long")
    return answers(queries, found, "code", k, "distance", descending=False)
