"""Near-duplicates by SimHash fingerprints, linked through a hierarchical index in Gray order.

Two fingerprints within three bits agree in at least two of five segments, so the rows are dealt ten
times, by each pair of segments (25 or 26 bits) and its value: groups stay small however many documents there
are. In each task they stand in the order of their Gray rank, where neighbours share many bits. Runs of neighbours become nodes that hold the bits all of them share
(mask and pattern), runs of nodes become upper nodes. A search adds up the differences at
the bits that each level shares anew, and leaves a whole group once the sum exceeds three.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.llm.common import quoted, slices, without, written
from forgeline.llm.components import connected

#: Children of a node of the index.
FANOUT = 8
#: First bits of the five segments, and the end.
SEGMENTS = (0, 13, 26, 39, 52, 64)
#: Fingerprints with the same value in two segments that one task compares; more are dealt out as pairs of blocks.
BLOCK = 1 << 15
#: Values with more fingerprints than that whose list is sent to all tasks; a longer list is joined by a shuffle.
MOST_SENT = 1 << 17
#: Rows gathered before the groups among them are searched, and pairs of query and node held at once.
CHUNK, FRONTIER = 1 << 15, 1 << 21

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, each weighing as often as it occurs; without words 0."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[words - 1 :] if len(found) >= words else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(begins[at : at + (1 << 14)], stops[at : at + (1 << 14)], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", words: int = 3, seed: int = 42, out: str = "fp") -> DataFrame:
    """df without `text_col`, with the signed 64-bit fingerprint `out` of each whole text (null: no words, so 0)."""
    rest = [c for c in without(df, [out]).columns if c != text_col]
    work = df.select(*[quoted(c) for c in rest], F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([*[work.schema[c] for c in rest], T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest))
            for a, b in slices(pa.compute.binary_length(texts).to_pylist(), 1 << 22):
                fps = np.array([fingerprint(t, words, seed) for t in texts.slice(a, b - a).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(rest))], pa.array(fps.view(np.int64))], names=[*rest, out])

    return work.mapInArrow(run, schema)


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in Gray order."""
    for n in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, n))
    return code


class GrayIndex:
    """The index over codes in Gray order, in groups that stand together: one tree for each group."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray) -> None:
        self.levels = [(codes, np.full(len(codes), ~np.uint64(0)), None, None)]
        both, either, group = codes, codes, groups
        last = np.arange(len(codes))
        self.lasts = [last]
        while True:
            begin = np.concatenate([[True], group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.maximum.accumulate(np.where(begin, np.arange(len(group)), 0))
            if not place.any():
                break
            starts = np.flatnonzero(place % FANOUT == 0)
            counts = np.diff(np.concatenate([starts, [len(group)]]))
            both, either, group = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts), group[starts]
            last = last[starts + counts - 1]
            self.levels.append((both, ~(both ^ either), starts, counts))
            self.lasts.append(last)
        self.root = np.searchsorted(group, groups) if len(group) else np.empty(0, dtype=np.int64)

    def later_within(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query row and a later row of its group that differ in at most `most` bits."""
        codes = self.levels[0][0]
        query, node = queries, self.root[queries]
        sums = np.zeros(len(query), dtype=np.uint8)
        known = np.zeros(len(query), dtype=np.uint64)
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, mask, starts, counts = self.levels[level]
            sums = sums + np.bitwise_count((codes[query] ^ pattern[node]) & mask[node] & ~known)
            near = (sums <= most) & (self.lasts[level][node] > query)
            query, node, sums = query[near], node[near], sums[near]
            if level == 0:
                break
            n = counts[node]
            known = np.repeat(mask[node], n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            query, node, sums = np.repeat(query, n), np.repeat(starts[node], n) + inner, np.repeat(sums, n)
        return query, node


def local_labels(codes: np.ndarray, groups: np.ndarray, most: int) -> np.ndarray:
    """For each row the first row that links reach within its group."""
    label = np.arange(len(codes))
    if not len(codes):
        return label
    _, place, sizes = np.unique(groups, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(sizes[place] > 1)
    if not len(shared):
        return label
    if len(shared) < len(codes):
        label[shared] = shared[local_labels(codes[shared], groups[shared], most)]
        return label
    index = GrayIndex(codes, groups)
    step = max(1, FRONTIER // (2 * int(sizes.max())))
    for at in range(0, len(codes), step):
        a, b = index.later_within(np.arange(at, min(at + step, len(codes))), most)
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def pair_masks() -> list[int]:
    """The bits of each two segments, as signed 64-bit masks."""
    segments = [((1 << end) - 1) ^ ((1 << begin) - 1) for begin, end in zip(SEGMENTS, SEGMENTS[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(segments, 2))]


def links(fps: DataFrame, most: int = 3, block: int = BLOCK, most_sent: int = MOST_SENT) -> DataFrame:
    """Edges (a, b) between fingerprints (fp: long, distinct) whose components are those of all pairs within `most` <= 3 bits.

    A task links each fingerprint to the first of its local component instead of listing all
    pairs. A value with more than `block` fingerprints becomes pairs of blocks.
    """
    if not 0 <= most <= 3:
        raise ValueError("pairs of five segments cover up to three differing bits")
    values = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in pair_masks()])
    rows = fps.select("fp", F.posexplode(values).alias("pair", "value"))
    many = rows.groupBy("pair", "value").count().filter(F.col("count") > block)
    many = written(many.select("pair", "value", F.ceil(F.col("count") / block).cast("int").alias("__blocks")), "hot-values")
    sent = F.broadcast(many) if many.count() <= most_sent else many
    dealt = rows.join(sent, ["pair", "value"], "left").withColumn("blocks", F.coalesce("__blocks", F.lit(1))).drop("__blocks")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("own")) | (F.col("blocks") == 1))
    cells = dealt.select("fp", "pair", "value", "own", F.explode(others).alias("other"))
    key = F.struct("pair", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sorted_cells = cells.select("fp", F.xxhash64(key).alias("cell")).repartition("cell").withColumn("rank", gray_rank(F.col("fp"))).sortWithinPartitions("cell", "rank").select("cell", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(rest) >= CHUNK:
                cut = int(np.searchsorted(rest["cell"].to_numpy(), rest["cell"].iloc[-1]))
                if cut:
                    yield edges(rest.iloc[:cut])
                    rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield edges(rest)

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy()
        label = local_labels(fp.view(np.uint64), pdf["cell"].to_numpy(), most)
        linked = label != np.arange(len(label))
        return pd.DataFrame({"a": fp[linked], "b": fp[label[linked]]})

    return sorted_cells.mapInPandas(run, "a long, b long")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """df without `text_col`, with fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    Texts without words (null, empty) have fingerprint zero and are linked like any other. Every
    row comes back, repeated ones too; rows with a null id belong to a component but don't name it.
    Input columns with the names of the outputs, in any case, are replaced. An empty table gives no rows; a very long
    text is read whole, in pieces of its words, by one task.
    """
    rows = written(fingerprints(without(df, ["fingerprint", "component_id"]), text_col, out="__fp"), "fingerprints")
    fps = written(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(quoted(id_col)).alias("least")), "distinct")
    labels = connected(links(fps.select("fp"), most))
    named = labels.join(fps, labels["node"] == fps["fp"]).select("node", "label", "least")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = fps.join(named.join(least, "label").select(F.col("node").alias("fp"), "component_id"), "fp", "left")
    # written, so that the join's both sides come straight from an exchange and a hot fingerprint can be split
    ids = written(ids.select(F.col("fp").alias("__fp"), F.coalesce("component_id", "least").alias("component_id")), "component-ids")
    kept = [c for c in rows.columns if c != "__fp"]
    return rows.join(ids, "__fp").select(*[quoted(c) for c in kept], F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")
