"""Near-duplicates by the exact Jaccard similarity of word shingles: SimHash first, MinHash for what it can't reach.

The fingerprints of the shingles are linked through SimHash's Gray-order index, and every link is confirmed by the
whole sets of shingles. At a similarity of 0.8 two 64-bit fingerprints differ in about ten bits, though, and segments
short enough to survive that hold a large share of all rows; so documents that agree in one band of MinHashes are
candidates too. Each is held against one centre of each of its bands first, the member that most others meet in
bands. Then only pairs of a band that are still in different components are, and of those only pairs whose sizes and whose
numbers of shingles that no other candidate has leave room for the similarity, and whose parity maps do: one bit for
each slot of a table of hashes, set if an odd number of a set's shingles falls there. Two maps differ in no more bits
than their sets differ in shingles, so that a pair beyond the most that the similarity allows needs no further look; in a
large group of texts edited each in its own way nearly all pairs end there. Sets of over about PARITY shingles fill the
maps, and fewer of their pairs do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.llm.common import slices, written
from forgeline.llm.components import connected
from forgeline.llm.simhash import links

#: Words of a shingle, and the similarity from which two documents are near-duplicates.
WORDS, SIMILAR = 5, 0.8
#: Bands and MinHashes of each: a pair at 0.8 shares no band once in 190,000 times.
BANDS, DEPTH = 40, 6
#: Bits of a parity map.
PARITY = 2048

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 32, (BANDS * DEPTH, 1), dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, (BANDS * DEPTH, 1), dtype=np.uint32) | np.uint32(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes, in order, of a text's word shingles; a shorter text is one shingle, one without words has none."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - words + 1)
    begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[words - 1 :] if len(found) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(begins, stops, strict=True)], dtype=np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHashes (of 32 bits) of a set of shingles; none of the empty set."""
    if not len(found):
        return found
    halves = (found >> np.uint64(32)).astype(np.uint32)
    width = min(len(halves), 1 << 9)
    least, work = np.full((BANDS * DEPTH, width), ~np.uint32(0)), np.empty((BANDS * DEPTH, width), dtype=np.uint32)
    for at in range(0, len(halves), width):
        part = halves[at : at + width]
        made = work[:, : len(part)]
        np.bitwise_xor(part, _FLIP, out=made)
        np.multiply(made, _TIMES, out=made)
        np.minimum(least[:, : len(part)], made, out=least[:, : len(part)])
    raw, step = least.min(axis=1).tobytes(), 4 * DEPTH
    return np.array([xxhash.xxh64_intdigest(raw[i * step : (i + 1) * step], i) for i in range(BANDS)], dtype=np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles: the bits that over half of their hashes have; of the empty set 0."""
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(found), bitorder="little").tobytes(), "little")


def parity(found: np.ndarray) -> np.ndarray:
    """The parity map of a set of shingles, 64 bits in each of its numbers; of the empty set all zero."""
    times = np.bincount((found & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((times & 1).astype(np.uint8)).view(np.int64)


def _mapped(df: DataFrame, key: str, fields: list[T.StructField], each) -> DataFrame:
    """df's `key` with what `each` makes of the shingles of each whole text (null: empty)."""
    schema = T.StructType([df.schema[key], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pa.compute.binary_length(texts).to_pylist(), 1 << 22):
                made = [each(shingles(t)) for t in texts.slice(a, b - a).to_pylist()]
                columns = [pa.array([m[i] for m in made], pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType) else pa.int64()) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=schema.names)

    return df.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType(), False)


def _longs(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.LongType(), False), False)


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of `similar` or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(common / (F.size("of_a") + F.size("of_b") - common) >= similar).select("a", "b")


def firsts(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Of `rows` (__row, doc_id, text) the __row with the smallest doc_id (null last) of each component of near-duplicates.

    Texts without words (null, empty) are copies of each other. Repeated rows are copies too, of which the smallest __row stays; an
    empty table gives no rows. Very long texts are compared whole, by the set of all their shingles.
    """

    def signed(found: np.ndarray) -> tuple:
        return np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64), len(found), np.uint64(fingerprint(found)).view(np.int64), bands(found).view(np.int64)

    signs = _mapped(rows, "__row", [_long("node"), _long("n"), _long("fp"), _longs("bands")], signed)
    signs = written(signs, "bands")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("first")
    own = written(rows.select("__row", "doc_id").join(signs.select("__row", "node"), "__row").groupBy("node").agg(first), "sets")

    # equal sets are one node from here on
    nodes = written(signs.groupBy("node", "n", "fp").agg(F.first("bands").alias("bands")), "nodes")
    near = lambda x, y: F.least(x, y) >= similar * F.greatest(x, y)  # noqa: E731  (others can't be similar, whatever they share)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    # SimHash: nodes of one fingerprint, and of fingerprints that the index links, by the first node of each
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    same = nodes.join(heads, "fp").filter("node != head").select(*pair("node", "head"))
    linked = links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("head_a")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("head_b")), "b")
    by_fingerprint = same.union(linked.select(*pair("head_a", "head_b")))

    # MinHash: each member of a band and the band's centre
    cells = nodes.select("node", "n", F.posexplode("bands").alias("i", "cell"))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = written(cells.join(shared, "cell"), "cells")
    best = F.max(F.struct("met", F.xxhash64("node").alias("h"), "node", "n")).alias("centre")
    centres = met.join(met.groupBy("node").agg(F.sum("members").alias("met")), "node").groupBy("cell").agg(best)
    members = written(met.join(centres, "cell").select("i", "cell", "node", "n", F.col("centre.node").alias("centre"), F.col("centre.n").alias("centre_n")), "members")
    by_band = members.filter((F.col("node") != F.col("centre")) & near("n", "centre_n")).select(*pair("node", "centre"))
    tried = written(by_fingerprint.union(by_band).distinct(), "tried")
    used = tried.select(F.col("a").alias("node")).union(tried.select(F.col("b").alias("node"))).union(members.select("node")).distinct()
    asked = own.join(used, "node", "left_semi").select("node", F.col("first.__row").alias("__row"))
    texts = asked.join(rows.select("__row", "text"), "__row").select("node", "text")
    sets = written(_mapped(texts, "node", [_longs("found"), _longs("parity")], lambda found: (found.view(np.int64), parity(found))), "shingles")
    sure = written(_confirmed(tried, sets, similar), "confirmed")

    # only bands with several components count from here on
    labels = connected(sure)
    placed = members.join(labels, "node", "left").select("i", "cell", "node", "n", F.coalesce("label", "node").alias("label"))
    split = placed.groupBy("cell").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("cell")
    placed = written(placed.join(split, "cell"), "placed")

    # a shingle that no other node of these bands has can be in no common part: n - own is the most that a node shares
    held = sets.join(placed.select("node").distinct(), "node", "left_semi").select("node", F.explode("found").alias("shingle"))
    single = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).filter("times = 1")
    owns = written(single.groupBy("node").agg(F.count(F.lit(1)).alias("own")), "own-shingles")
    placed = placed.join(owns, "node", "left").select("i", "cell", "node", "n", "label", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
    room = lambda n, common, other: common * (1 + similar) >= similar * (n + other)  # noqa: E731  (of a node for one of `other` shingles)
    # no partner is smaller than similar * n
    placed = placed.filter(room(F.col("n"), F.col("common"), F.col("n") * similar)).join(nodes.select("node", "bands"), "node")
    placed = written(placed.join(sets.select("node", "parity"), "node"), "open")

    # members of a band's largest component need no more pairs among themselves
    main = placed.groupBy("cell", "label").count().groupBy("cell").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("count", "label")).alias("main")).filter("labels > 1")
    minor = placed.join(main, "cell").filter("label != main").select("cell", *[F.col(c).alias(f"my_{c}") for c in ("node", "n", "label", "common", "bands", "parity")], "main")
    fits = room(F.col("n"), F.col("common"), F.col("my_n")) & room(F.col("my_n"), F.col("my_common"), F.col("n"))
    differ = reduce(add, [F.bit_count(F.col("parity")[w].bitwiseXOR(F.col("my_parity")[w])) for w in range(PARITY // 64)])
    alike = differ * (1 + similar) <= (F.col("n") + F.col("my_n")) * (1 - similar) + 1e-6  # sets of this similarity differ in no more shingles
    first_band = F.expr("i = 0 OR NOT exists(sequence(0, greatest(i - 1, 0)), j -> bands[j] = my_bands[j])")  # each pair in the first of its bands only
    apart = minor.join(placed, "cell").filter((F.col("label") != F.col("my_label")) & near("n", "my_n") & fits & ((F.col("label") == F.col("main")) | (F.col("my_node") < F.col("node"))) & alike & first_band)
    left = written(apart.select(*pair("my_node", "node")).join(tried, ["a", "b"], "left_anti"), "left")
    labels = connected(sure.union(written(_confirmed(left, sets, similar), "confirmed")))
    named = own.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    return named.select(F.col("first.__row").alias("__row"))
