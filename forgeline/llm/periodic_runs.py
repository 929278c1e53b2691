"""Periodic runs of words: stretches in which the same few words, or the same long passage, come again and again.

A document is exploded into overlapping tiles for each octave of periods. In the octave of period q a
run's words equal those q later over a stretch of at least `step` places, and boundaries stand at all multiples
of `step`, so that each such stretch holds a boundary. At a boundary two Z-functions, of the words after it and
of the words before it read backwards, tell for every period of the octave how far the equal places reach
to both sides within the tile. Tiles know nothing of each other. What they find is shuffled by document and
period, where fragments that overlap are stitched into whole runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.llm.common import quoted, slices, without, written

#: A run has at least so many words and holds its period at least so many times.
LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Words between the first boundaries of two tiles; in octaves of long periods eight steps.
TILE_WORDS = 4096
#: The tiles of longer texts are dealt to all tasks; those of others are solved where the text is read.
DEALT_BYTES = 1 << 16
#: Bytes of runs up to which they are sent to all tasks; more are joined by a shuffle.
SENT_BYTES = 64 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_TILE = "key binary, n bigint, octave int, octaves int, start bigint, first bigint, last bigint, ids binary"
_FRAGMENT = "key binary, period bigint, lo bigint, hi bigint"


def octaves(n: int, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(first period, period after the last, step): the first octave has the periods under 8, each other one those of one power of two.

    A run of period q has max(least - q, (exponent - 1) * q) places or more that equal the place q later; the step is the largest
    power of two that no period of the octave undercuts.
    """
    return [o for o in _all_octaves(least, exponent) if o[0] * exponent <= n] if n >= least else []


@lru_cache(maxsize=16)
def _all_octaves(least: int, exponent: int) -> tuple[tuple[int, int, int], ...]:
    out, lo, hi = [], 1, 8
    while hi < 1 << 40:
        fewest = min(max(least - q, (exponent - 1) * q) for q in range(lo, min(hi, lo + least)))
        out.append((lo, hi, 1 << (fewest.bit_length() - 1)))
        lo, hi = hi, hi * 2
    return tuple(out)


def tiles(n: int, tile: int, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first octave, octave after the last, first word, word after the last, first boundary, end of the boundaries) of each tile.

    Octaves whose tiles would be equal share them. A tile reaches one step before its first boundary, and one step and one period beyond its last.
    """
    known = octaves(n, least, exponent)
    at = 0
    for width, same in groupby(known, key=lambda o: min(n, max(tile, 8 * o[2]))):
        group = list(same)
        step, longest = max(o[2] for o in group), group[-1][1]
        for first in range(0, n, width):
            last = min(n, first + width)
            yield at, at + len(group), max(0, first - step), min(n, last + step + longest), first, last
        at += len(group)


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest prefix of s that stands there too."""
    n = len(s)
    z, left, right = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _promising(words: np.ndarray, at: np.ndarray, periods: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of boundary and period have at least `most` equal places in a row around the boundary, or reach so far to one side."""
    around = np.arange(-most, most)
    equal = words[at[:, None] + around] == words[(at + periods)[:, None] + around]
    ahead = np.where(equal[:, most:].all(axis=1), most, equal[:, most:].argmin(axis=1))
    back = np.where(equal[:, :most].all(axis=1), most, equal[:, most - 1 :: -1].argmin(axis=1))
    return ahead + back >= most


def solve(words: np.ndarray, n: int, group: list[tuple[int, int, int]], start: int, first: int, last: int, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(period, lo, hi) for each stretch of places lo..hi-1 of the document that equal the place one period later, as far as the tile shows.

    `words` are those from `start` on; boundaries lie in first..last-1. Only stretches that are long enough for a run, or that a tile's limit cuts, are given.
    """
    pad = 2 * group[-1][2] + group[-1][1] + 1
    padded = np.full(len(words) + 2 * pad, -1, np.int32)
    padded[:pad] = -2
    padded[pad : pad + len(words)] = words
    open_tiles: list[tuple[int, int]] = []
    for index, (lo, hi, step) in enumerate(group):
        at = np.arange(-(-first // step) * step, last, step) - start + pad
        periods = np.arange(lo, min(hi, n // exponent + 1))
        if not len(at):
            continue
        later = as_strided(padded[at[0] + lo :], (len(at), len(periods)), (step * padded.itemsize, padded.itemsize), writeable=False)
        rows, columns = (later == padded[at][:, None]).nonzero()
        most = min(step, 16)
        kept = np.zeros(len(at), bool)
        for a in range(0, len(rows), 1 << 16):
            r, q = rows[a : a + (1 << 16)], periods[columns[a : a + (1 << 16)]]
            kept[r[_promising(padded, at[r], q, most)]] = True
        open_tiles += [(index, int(b)) for b in at[kept]]
    found = []
    for index, b in open_tiles:
        lo, hi, step = group[index]
        longest = min(hi - 1, n // exponent)
        reach = min(step, b - pad)
        right = z_function(padded[b : b + step + longest].tolist())
        behind = padded[b - reach : b][::-1].tolist()
        left = z_function([*behind, -3, *padded[b - reach : b + longest][::-1].tolist()])
        periods = np.arange(lo, longest + 1)
        ahead = np.minimum(np.array(right[lo : longest + 1]), step)
        back = np.array(left)[reach + 1 + longest - periods]
        good = (ahead > 0) & ((ahead + back >= np.maximum(least - periods, (exponent - 1) * periods)) | (ahead == step) | (back == step))
        middle = b - pad + start
        found += zip(periods[good].tolist(), (middle - back[good]).tolist(), (middle + ahead[good]).tolist(), strict=True)
    return stitched(found)


def stitched(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The fragments of one document, those of a period that overlap or touch made one."""
    out: list[tuple[int, int, int]] = []
    for period, lo, hi in sorted(found):
        if out and out[-1][0] == period and lo <= out[-1][2]:
            out[-1] = (period, out[-1][1], max(hi, out[-1][2]))
        else:
            out.append((period, lo, hi))
    return out


def word_ids(text: str) -> np.ndarray:
    """The words of a text, equal words having equal numbers."""
    words = text.encode().split()
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _exploded(rows: Iterator[tuple[bytes, str]], tile: int, least: int, exponent: int) -> Iterator[tuple]:
    for key, text in rows:
        ids = word_ids(text)
        for octave, after, start, end, first, last in tiles(len(ids), tile, least, exponent):
            yield key, len(ids), octave, after, start, first, last, ids[start:end]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose sizes sum to about `most`."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_TILES = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("octave", pa.int32()), ("octaves", pa.int32()), ("start", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("ids", pa.binary())])
_FRAGMENTS = pa.schema([("key", pa.binary()), ("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def fragments(df: DataFrame, tile: int = TILE_WORDS, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, dealt_bytes: int = DEALT_BYTES) -> DataFrame:
    """(key, period, lo, hi) of what the tiles of df's texts find; df has (key, text), without nulls."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*t[:7], t[7].tobytes()) for t in _exploded(_pairs(batches), tile, least, exponent))
        yield from _batches(rows, _TILES, lambda row: len(row[7]), 1 << 22)

    def found(parts: Iterator[tuple]) -> Iterator[tuple]:
        for key, n, octave, after, start, first, last, ids in parts:
            for fragment in solve(ids, n, octaves(n, least, exponent)[octave:after], start, first, last, least, exponent):
                yield key, *fragment

    def solve_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(found(_exploded(_pairs(batches), tile, least, exponent)), _FRAGMENTS, lambda row: 1, 1 << 15)

    def solve_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((*r[:7], np.frombuffer(r[7], np.int32)) for b in batches for i in range(b.num_rows) for r in zip(*(c.to_pylist() for c in b.slice(i, 1).columns), strict=True))
        yield from _batches(found(parts), _FRAGMENTS, lambda row: 1, 1 << 15)

    long = F.octet_length("text") > dealt_bytes
    here = df.filter(~long).mapInArrow(solve_here, _FRAGMENT)
    dealt = df.filter(long).mapInArrow(explode, _TILE).repartition("key", "octave", "first").mapInArrow(solve_dealt, _FRAGMENT)
    return here.unionAll(dealt)


def stitch(found: DataFrame, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """(key, runs): the runs of each key that has any, by start and then period, from its fragments, repeated ones too.

    A stretch of period q that is as long as a run has a smaller period only if that divides q; the same stretch
    is found with it then, so that the smallest period of a stretch is its own.
    """
    apart = found.groupBy("key", "period", "lo").agg(F.max("hi").alias("hi"))
    order = Window.partitionBy("key", "period").orderBy("lo")
    begins = F.col("lo") > F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = apart.withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("key", "period", "island").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("period")).alias("length"))
    long = whole.filter(F.col("length") >= F.greatest(F.lit(least), exponent * F.col("period")))
    own = long.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    return own.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found")).select("key", F.expr(f"CAST(transform(found, x -> struct(x.start, x.length, x.period)) AS array<{RUN}>)").alias("runs"))


def find(df: DataFrame, text_col: str = "text", tile: int = TILE_WORDS, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, dealt_bytes: int = DEALT_BYTES, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """df with `runs`: array<struct<start, length, period>> of words of `text_col`, by start and then period, never null.

    A run is a stretch of words that are equal q words apart, q being the smallest such period, that is at least `least`
    words and `exponent` (2 or more) periods long and can't be extended to either side. Words end at ASCII white space. Null and empty
    texts, and those under `least` words, have no runs. Texts are told apart by their SHA-256, so that repeated rows get equal runs and copies are
    stitched once. A very long text is solved tile by tile in many tasks; its longest periods need a tile of the whole text. An
    empty table gives no rows; an input column named runs, in any case, is replaced.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run must have two words and two periods at least")
    base = without(df, ["runs"])
    text = F.coalesce(quoted(text_col), F.lit(""))
    key = F.unhex(F.sha2(text, 256))
    runs = written(stitch(fragments(base.select(key.alias("key"), text.alias("text")), tile, least, exponent, dealt_bytes), least, exponent), "runs")
    size = runs.agg(F.coalesce(F.sum(64 + 32 * F.size("runs")), F.lit(0)).alias("bytes")).first()["bytes"]
    named = runs.select(F.col("key").alias("__key"), F.col("runs").alias("__runs"))
    both = base.withColumn("__key", key).join(F.broadcast(named) if size <= sent_bytes else named.hint("merge"), "__key", "left")
    return both.select(*[quoted(c) for c in base.columns], F.coalesce("__runs", F.expr(f"CAST(array() AS array<{RUN}>)")).alias("runs"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of ties the one that starts first, then the smaller period; null without runs."""
    better = lambda x, y: (y["length"] * x["period"] > x["length"] * y["period"]) | ((y["length"] * x["period"] == x["length"] * y["period"]) & (F.struct(y["start"], y["period"]) < F.struct(x["start"], x["period"])))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda x, y: F.when(better(x, y), y).otherwise(x))


def said(runs: Column) -> Column:
    """start,length,period and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")


def collapsed_text(text: str, runs: list[dict]) -> str:
    """The words that no run holds beyond its first period, joined by one space."""
    words = text.encode().split()
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for run in runs:
            change[run["start"] + run["period"]] += 1
            change[run["start"] + run["length"]] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words).decode()


def collapse(df: DataFrame, text_col: str = "text", runs_col: str = "runs", out_col: str = "collapsed") -> DataFrame:
    """df with `out_col`: each whole text without what its runs repeat, its words joined by one space; `text_col` is left out.

    Null texts give an empty text, null runs count as none. Rows stay as they are in number and order; a column named
    like `out_col`, in any case, is replaced.
    """
    base = without(df, [out_col])
    rest = [c for c in base.columns if c != text_col]
    work = base.select(*[quoted(c) for c in rest], F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([*[base.schema[c] for c in rest], T.StructField(out_col, T.StringType(), False)])
    at = rest.index(runs_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.utf8_length(batch.column(len(rest))).to_pylist()
            for a, b in slices(sizes, 1 << 22):
                part = batch.slice(a, b - a)
                made = [collapsed_text(t, r) for t, r in zip(part.column(len(rest)).to_pylist(), part.column(at).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(made, pa.string())], names=[*rest, out_col])

    return work.mapInArrow(run, schema)
