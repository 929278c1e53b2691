"""Approximate nearest neighbours: a forest of random-projection trees in every shard of the vectors.

A tree splits its points at the median of their projections onto a random direction, which is tilted
towards where some of the points spread, down to small leaves. A query keeps one priority queue over
all trees of the forest: the branch with the least sum of squared distances beyond its splits,
in any tree, is opened next, until enough candidates were met. The candidates'
cosines are then computed from the original vectors in double precision.

The number of shards follows from the vectors alone, never from the cluster, so that answers are
alike everywhere. Each shard's forest is built once and written; blocks of queries are sent to it.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.llm.common import written
from forgeline.llm.vectors import answers, blocks, representatives, rows_of

TREES, LEAF = 32, 32
#: Points of a node whose scatter tilts its random direction.
SCATTER = 100
#: A search ends when so many times the vectors met up to the last change of its answer have been met since, at the latest with all of a shard.
PATIENCE = 1.6
#: Rows of leaves that a search compares at a time, so that few of numpy's calls are needed.
BATCH = 256
#: How much less a cosine of unit vectors in the search may be than the exact one of the same vectors.
SLACK = 1e-9
#: Bytes of the vectors of one shard (32,768 vectors of 64 components).
SHARD_BYTES = 1 << 24
#: Queries that one task sends to a shard: at most, and at least while there are tasks for more blocks. They change no answer.
MOST_QUERIES, LEAST_QUERIES = 1 << 13, 1 << 8


class Forest:
    """Trees over unit vectors. Inner nodes hold a direction and a median, leaves a range of `rows`."""

    #: What `dumped` keeps.
    FIELDS = ("roots", "low", "high", "plane", "begin", "end", "rows", "matrix", "offsets")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self._nodes = list(zip(*(arrays[n].tolist() for n in ("low", "high", "plane", "begin", "end")), strict=True))

    @classmethod
    def grown(cls, units: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> Forest:
        rng = np.random.default_rng(seed)
        nodes: list[list[int]] = []  # low, high, plane, begin, end
        order: list[np.ndarray] = []
        directions, medians, roots, at = [], [], [], 0

        def new() -> int:
            nodes.append([-1, -1, -1, 0, 0])
            return len(nodes) - 1

        for _ in range(trees):
            roots.append(new())
            stack = [(roots[-1], np.arange(len(units)))]
            while stack:
                node, rows = stack.pop()
                if len(rows) <= leaf:
                    nodes[node][3:] = at, at + len(rows)
                    order.append(rows)
                    at += len(rows)
                    continue
                some = units[rng.choice(rows, min(len(rows), SCATTER), replace=False)]
                some = some - some.mean(axis=0)
                direction = rng.standard_normal(units.shape[1])
                for _ in range(2):  # towards where the points spread
                    tilted = some.T @ (some @ direction)
                    direction = tilted / norm if (norm := np.linalg.norm(tilted)) > 0 else direction
                direction = direction / np.linalg.norm(direction)
                projected = units[rows] @ direction
                by = np.argsort(projected, kind="stable")
                half = len(rows) // 2
                low, high = new(), new()
                nodes[node][:3] = low, high, len(directions)
                directions.append(direction)
                medians.append(float(projected[by[half - 1]] + projected[by[half]]) / 2)
                stack += [(low, rows[by[:half]]), (high, rows[by[half:]])]
        columns = np.array(nodes, dtype=np.int32).T
        matrix = np.array(directions, dtype=np.float32).reshape(-1, units.shape[1])
        return cls(**dict(zip(("low", "high", "plane", "begin", "end"), columns, strict=True)), roots=np.array(roots, dtype=np.int32), rows=np.concatenate(order).astype(np.int32), matrix=matrix, offsets=np.array(medians))

    def beyond(self, queries: np.ndarray) -> np.ndarray:
        """How far each query lies beyond each split."""
        return queries @ self.matrix.T.astype(float) - self.offsets

    def nearest(self, query: np.ndarray, units: np.ndarray, beyond: list[float], k: int, patience: float) -> tuple[np.ndarray, int]:
        """(rows among which the k nearest met are, ties and rounding allowed for; how many were met), through the shared queue.

        A leaf of each tree is met before the search may end. Leaves are compared some at a time, BATCH rows or more. `last` is how many were met
        when the k nearest changed for the last time.
        """
        met = np.zeros(len(units), dtype=bool)
        queue = [(0.0, root) for root in self.roots.tolist()]
        nodes, order, trees = self._nodes, self.rows, len(queue)
        total = last = opened = 0
        least, rows, scores = -np.inf, np.empty(0, dtype=order.dtype), np.empty(0)
        push, pop = heapq.heappush, heapq.heappop
        while queue and (opened < trees or total - last < patience * last):
            leaves, held = [], 0
            while queue and held < BATCH:
                away, node = pop(queue)
                while True:
                    low, high, plane, begin, end = nodes[node]
                    if plane < 0:
                        break
                    d = beyond[plane]
                    if d < 0:
                        push(queue, (away + d * d, high))
                        node = low
                    else:
                        push(queue, (away + d * d, low))
                        node = high
                leaves.append(order[begin:end])
                held += end - begin
            opened += len(leaves)
            new = np.concatenate(leaves)
            new = np.unique(new[~met[new]])
            if not len(new):
                continue
            met[new] = True
            total += len(new)
            found = units[new] @ query
            close = found >= least - SLACK
            if close.any():
                better = len(rows) < k or found.max() > least
                rows, scores = np.concatenate([rows, new[close]]), np.concatenate([scores, found[close]])
                if better:
                    last = total
                    if len(scores) >= k:
                        least = np.partition(scores, len(scores) - k)[len(scores) - k]
                        kept = scores >= least - SLACK
                        rows, scores = rows[kept], scores[kept]
        return np.sort(rows), total


def dumped(forest: Forest, vectors: np.ndarray, ids: list[list[int]]) -> bytes:
    """A shard as bytes: its forest, its original vectors and the ids of each."""
    out = io.BytesIO()
    np.savez(out, vectors=vectors, ids=np.array([i for x in ids for i in x], dtype=np.int64), ends=np.cumsum([len(x) for x in ids]), **{n: getattr(forest, n) for n in Forest.FIELDS})
    return out.getvalue()


def loaded(raw: bytes) -> tuple[Forest, np.ndarray, list[list[int]]]:
    with np.load(io.BytesIO(raw)) as arrays:
        ids = [x.tolist() for x in np.split(arrays["ids"], arrays["ends"][:-1])]
        return Forest(**{n: arrays[n] for n in Forest.FIELDS}), arrays["vectors"], ids


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of one query with each vector, in double precision."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, patience: float = PATIENCE, seed: int = 42, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows found nearest by cosine.

    Equal scores go by smaller id; all other rows if there are fewer than k. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with a null id, take no part; a query
    meets only vectors of its own length. Equal vectors are indexed once, with their k + 1 smallest ids,
    and repeated rows count once. Extra columns don't count, and an empty table gives no rows.

    A shard holds about `shard_bytes` of vectors. A search of it ends when `patience` times as many vectors as were met up to the last change
    of its k + 1 nearest have been met without another; both change the answers, the cluster doesn't.
    """
    rows = written(rows_of(df, id_col, vec_col), "vectors")
    vectors = written(representatives(rows, "vec", k), "vector-ids")
    queries = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec").distinct()
    asked = written(queries.select("vec").distinct(), "asked")
    place = lambda n, seed: F.pmod(F.xxhash64("vec", F.lit(seed)), n).cast("int")
    # one row for each length of vectors
    shards = vectors.groupBy(F.size("vec").alias("d")).agg(F.ceil(F.count(F.lit(1)) * F.size(F.first("vec")) * 8 / shard_bytes).cast("int").alias("shards"))
    shards = written(shards, "shards")

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("first")  # whatever order the rows arrive in
        data = np.stack(shard["vec"].to_numpy())
        forest = Forest.grown(data / np.linalg.norm(data, axis=1, keepdims=True), trees, leaf, seed)
        return pd.DataFrame({"d": [data.shape[1]], "s": [shard["s"].iloc[0]], "forest": [dumped(forest, data, list(shard["ids"]))]})

    placed = vectors.withColumn("d", F.size("vec")).join(shards, "d").select("vec", "ids", F.element_at("ids", 1).alias("first"), "d", place(F.col("shards"), 1).alias("s"))
    forests = written(placed.groupBy("d", "s").applyInPandas(build, "d int, s int, forest binary"), "forests")

    n_query = blocks(asked.count(), MOST_QUERIES, LEAST_QUERIES, df.sparkSession.sparkContext.defaultParallelism)
    left = forests.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("q"))
    sent = asked.withColumn("d", F.size("vec")).join(shards, "d")
    right = sent.select("vec", "d", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"), place(F.lit(n_query), 2).alias("q"))

    def cell(shard: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"vec": [], "score": [], "id": []}
        if len(shard) and len(wanted):
            forest, data, ids = loaded(shard["forest"].iloc[0])
            units = data / np.linalg.norm(data, axis=1, keepdims=True)
            asked = np.stack(wanted["vec"].to_numpy())
            for at in range(0, len(asked), 64):
                part = asked[at : at + 64]
                ones = part / np.linalg.norm(part, axis=1, keepdims=True)
                for query, one, beyond in zip(part, ones, forest.beyond(ones), strict=True):
                    rows, _ = forest.nearest(one, units, beyond.tolist(), k + 1, patience)
                    scores = cosines(query, data[rows])
                    few = np.argsort(-scores, kind="stable")[: k + 1]
                    few = np.flatnonzero(scores >= scores[few[-1]])  # equal ones too
                    best = sorted((-float(scores[j]), int(i)) for j in few for i in ids[rows[j]])[: k + 1]
                    out["vec"] += [query] * len(best)
                    out["score"] += [-s for s, _ in best]
                    out["id"] += [i for _, i in best]
        return pd.DataFrame(out)

    found = left.groupBy("d", "s", "q").cogroup(right.groupBy("d", "s", "q")).applyInPandas(cell, "vec array<double>, score double, id long")
    return answers(queries, found, "vec", k, "score", descending=True)
