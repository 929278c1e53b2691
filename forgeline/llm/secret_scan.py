"""Secrets in texts: assignments, access keys and long hexadecimal strings by pattern, and strings that pass for random.

Each long token that a pattern may have missed gets the smallest encoding that has all its symbols, and a battery of tests against
uniform random symbols of it: chi-squared over the alphabet and over its classes (digits, capitals, ...), runs above and below
the middle of the alphabet, serial correlation. A token that fails one is no secret. For those that pass, the question is
how likely a token of that length and encoding would be so even if its symbols were those of ordinary text, whose
frequencies are counted over the whole corpus. False discoveries are controlled on these probabilities, for each encoding and octave of lengths
by itself, so that short tokens, about which the tests say little, can't ride on long ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.llm.common import quoted, slices, without, written

#: Base kinds in the order of the contract, then what the tests find.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

#: Tokens from this length on are tested.
LEAST_TESTED = 16
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST_TESTED)
#: A token passes for random if the least p-value of its tests, times their number, isn't under this.
REJECTED = 0.01
#: The share of false discoveries among what is found in each stratum.
FALSE_SHARE = 0.05
#: Standard deviations are rounded up to 1 / BINS for the control, and are told apart down to LOWEST.
BINS, LOWEST = 100, -40

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, the smallest alphabet first: their symbols in order, in classes. Digits alone are numbers, not keys.
ENCODINGS: dict[str, tuple[str, ...]] = {
    "hex": (_DIGITS, _LOWER[:6]),
    "hex_upper": (_DIGITS, _UPPER[:6]),
    "base32": (_UPPER, _DIGITS[2:8]),
    "base36": (_DIGITS, _LOWER),
    "base36_upper": (_DIGITS, _UPPER),
    "base62": (_DIGITS, _UPPER, _LOWER),
    "base64": (_UPPER, _LOWER, _DIGITS, "+/"),
    "base64_url": (_UPPER, _LOWER, _DIGITS, "-_"),
}
_ALPHABETS = ["".join(classes) for classes in ENCODINGS.values()]
_SETS = [frozenset(a) for a in _ALPHABETS]
_PLACES = [np.array([a.find(chr(b)) for b in range(128)]) for a in _ALPHABETS]
_BOUNDS = [np.cumsum([len(c) for c in classes]) for classes in ENCODINGS.values()]

SPAN = "struct<k:int,s:bigint,e:bigint>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base spans, by start and then kind; matches that fail their condition are dropped without a retry."""
    out = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    out += [(1, *m.span()) for m in _ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def encoding_of(token: str) -> int | None:
    """The place in ENCODINGS of the smallest alphabet that holds the token; none for digits alone and for mixed alphabets."""
    used = set(token)
    if used <= set(_DIGITS):
        return None
    return next((i for i, a in enumerate(_SETS) if used <= a), None)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_squared(counts: np.ndarray, expected: np.ndarray) -> float:
    """The probability of a sum of squares at least so large, from a gamma distribution with its exact mean and variance (Wilson and Hilferty)."""
    n = counts.sum()
    value = float(((counts - expected) ** 2 / expected).sum())
    mean = len(counts) - 1
    variance = 2 * mean + float((n / expected).sum() - len(counts) ** 2 - 2 * mean) / n
    if variance <= 0 or mean == 0:
        return 1.0
    shape = mean * mean / variance
    return _upper_tail(((value / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape))


def battery(token: str, encoding: int) -> tuple[float, int]:
    """(the least p-value of the tests times their number, at most 1; the sum of the squares of the symbols' counts)."""
    size, n = len(_ALPHABETS[encoding]), len(token)
    places = _PLACES[encoding][np.frombuffer(token.encode(), np.uint8)]
    counts = np.bincount(places, minlength=size)
    p = [_chi_squared(counts, np.full(size, n / size))]
    bounds = _BOUNDS[encoding]
    widths = np.diff(bounds, prepend=0)
    p.append(_chi_squared(np.add.reduceat(counts, bounds - widths), n * widths / size))
    high = places >= size / 2
    above = int(high.sum())
    if 0 < above < n:
        mean = 2 * above * (n - above) / n
        deviation = math.sqrt(max(mean * (mean - 1) / (n - 1), 1e-12))
        p.append(2 * _upper_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean - 1) / deviation))
    else:
        p.append(2.0 ** (1 - min(n, 1000)))
    off = places - places.mean()
    spread = float((off**2).sum())
    p.append(2 * _upper_tail(abs(float((off[1:] * off[:-1]).sum()) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0)
    return min(1.0, len(p) * min(p)), int((counts**2).sum())


def tested(text: str) -> list[tuple[int, int, int, float, int]]:
    """(start, end, encoding, p, squares) of each long token of an encoding."""
    out = []
    for m in _TOKEN.finditer(text):
        encoding = encoding_of(m[0])
        if encoding is not None:
            out.append((*m.span(), encoding, *battery(m[0], encoding)))
    return out


_TESTED = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("encoding", pa.int32()), ("p", pa.float64()), ("squares", pa.int64())]))
_BASE = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))


def _scan(df: DataFrame, text_col: str) -> DataFrame:
    """df's other columns with __base and __tested; besides, a row for each batch with __symbols, how often it holds each ASCII character. Written."""
    rest = [c for c in df.columns if c != text_col]
    work = df.select(*[quoted(c) for c in rest], F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    added = T.StructType.fromDDL(f"__base array<{SPAN}>, __tested array<struct<s:bigint,e:bigint,encoding:int,p:double,squares:bigint>>, __symbols array<bigint>")
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType, True) for c in rest], *added.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = np.zeros(256, np.int64)
            for a, b in slices(pa.compute.utf8_length(batch.column(len(rest))).to_pylist(), 1 << 22):
                part = batch.slice(a, b - a)
                texts = part.column(len(rest)).to_pylist()
                for text in texts:
                    symbols += np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
                base = [[{"k": k, "s": s, "e": e} for k, s, e in base_spans(t)] for t in texts]
                tokens = [[dict(zip(("s", "e", "encoding", "p", "squares"), x, strict=True)) for x in tested(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(base, _BASE), pa.array(tokens, _TESTED), pa.nulls(len(texts), pa.list_(pa.int64()))], names=names)
            if batch.num_rows:
                lone = [pa.nulls(1, c.type) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*lone, pa.nulls(1, _BASE), pa.nulls(1, _TESTED), pa.array([symbols[:128].tolist()], pa.list_(pa.int64()))], names=names)

    return written(work.mapInArrow(run, schema), "scanned")


def moments(symbols: list[int]) -> list[tuple[float, float]]:
    """For each encoding the sums of squares and cubes of its symbols' shares in ordinary text; without any of them those of equal shares.

    Where an alphabet has letters of one case only, those of the other case count for them: words in capitals have the letters of words.
    """
    out = []
    for alphabet in _ALPHABETS:
        both = [{c, *({c.swapcase()} - set(alphabet))} for c in alphabet]
        counts = np.array([sum(symbols[ord(x)] for x in xs) for xs in both], dtype=float)
        share = counts / counts.sum() if counts.sum() else np.full(len(alphabet), 1 / len(alphabet))
        out.append((float((share**2).sum()), float((share**3).sum())))
    return out


def deviations(squares: Column, length: Column, encoding: Column, known: list[tuple[float, float]]) -> Column:
    """How many standard deviations a token's sum of squares lies above (below: negative) that of a token of ordinary text's symbols."""
    second, third = (F.get(F.array(*[F.lit(m[i]) for m in known]), encoding) for i in (0, 1))
    n = length.cast("double")
    mean = n * (n - 1) * second + n
    variance = 4 * n * (n - 1) * (n - 2) * third + 2 * n * (n - 1) * second - 2 * n * (n - 1) * (2 * n - 3) * second * second
    return (squares - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9)))


def limits(counts: dict[int, int], total: int, share: float = FALSE_SHARE) -> int | None:
    """The highest bin of deviations that Benjamini and Hochberg's procedure still lets pass, of `total` tokens of a stratum; none if none does."""
    best, passed = None, 0
    for bin_, n in sorted(counts.items()):
        passed += n
        if _upper_tail(-bin_ / BINS) * total <= share * passed:
            best = bin_
    return best


def find(df: DataFrame, text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """df without `text_col`, with base_spans and spans: array<struct<k, s, e>> (kind of KINDS, code points, end exclusive), by start and then kind.

    Base spans are those of the three patterns, leftmost and without overlap for each kind; spans adds the tokens that the tests find,
    none of which overlaps a base span. Null and empty texts have none. Whole texts are scanned, however long they are, each by one task. Repeated rows get equal
    answers, and each of them counts in the control of false discoveries. An empty table gives no rows. Input columns with the names of the outputs, in any case, are replaced.
    """
    base = without(df, ["base_spans", "spans"])
    rest = [i for i, c in enumerate(base.columns) if c.lower() != text_col.lower()]
    plain = base.toDF(*[f"c{i}" for i in range(len(base.columns))])
    scanned = _scan(plain, f"c{[c.lower() for c in base.columns].index(text_col.lower())}")
    symbols = [0] * 128
    for at, n in scanned.filter("__symbols IS NOT NULL").select(F.posexplode("__symbols")).groupBy("pos").agg(F.sum("col")).collect():
        symbols[at] = n
    known = moments(symbols)
    texts = scanned.filter("__symbols IS NULL")

    def octave(x: Column) -> Column:
        return F.floor(F.log2((x["e"] - x["s"]).cast("double"))).cast("int")

    def bin_of(x: Column) -> Column:
        return F.when(x["p"] >= REJECTED, F.ceil(F.greatest(F.least(deviations(x["squares"], x["e"] - x["s"], x["encoding"], known), F.lit(0.0)), F.lit(float(LOWEST))) * BINS).cast("int")).otherwise(F.lit(1))

    x = F.col("x")
    strata: dict[tuple[int, int], dict[int, int]] = {}
    for encoding, of, bin_, n in texts.select(F.explode("__tested").alias("x")).groupBy(x["encoding"], octave(x), bin_of(x)).count().collect():
        strata.setdefault((encoding, of), {})[bin_] = n
    highest = {}
    for stratum, counts in strata.items():
        limit = limits({b: n for b, n in counts.items() if b <= 0}, sum(counts.values()), false_share)
        if limit is not None:
            highest[stratum] = limit
    parts = [y for (encoding, of), limit in sorted(highest.items()) for y in (F.lit(f"{encoding} {of}"), F.lit(limit))]
    found = F.array().cast(f"array<{SPAN}>")
    if parts:
        passes = lambda y: F.coalesce(bin_of(y) <= F.try_element_at(F.create_map(*parts), F.concat_ws(" ", y["encoding"].cast("string"), octave(y).cast("string"))), F.lit(False))
        apart = lambda y: ~F.exists("__base", lambda b: (b["s"] < y["e"]) & (y["s"] < b["e"]))
        found = F.transform(F.filter("__tested", lambda y: passes(y) & apart(y)), lambda y: F.struct(F.lit(len(KINDS) - 1).alias("k"), y["s"].alias("s"), y["e"].alias("e")))
    both = F.transform(F.array_sort(F.transform(F.concat("__base", found), lambda y: F.struct(y["s"].alias("s"), y["k"].alias("k"), y["e"].alias("e")))), lambda y: F.struct(y["k"].alias("k"), y["s"].alias("s"), y["e"].alias("e")))
    return texts.select(*[F.col(f"c{i}").alias(base.columns[i]) for i in rest], F.col("__base").alias("base_spans"), both.alias("spans"))


def said(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
