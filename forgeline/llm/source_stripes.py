"""How the sources of a language differ in their words, by stripes that each partition folds in memory.

A partition folds whole documents into hash stripes: for each language and term the number of documents and, for each source, of
occurrences. Stripes that fill the memory are passed on and begun anew. They meet by language and term, so that a term
is one stripe of the whole corpus, and from these stripes the divergences come directly: what a term adds
to each pair of sources, and where a source uses it more than its language does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeline.llm.common import quoted, written

LEAST_DOCS, SMOOTHING, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Cells (a term's sources, and its document frequency) that a task holds before it passes its stripes on.
MOST_CELLS = 1 << 19
#: Cells of a dense block of terms and sources, and sums of pairs that a task holds before it passes them on.
BLOCK_CELLS = 1 << 20
#: Groups of language and source of which all tasks get the totals. The result has a row for each pair of a language's groups, so that
#: more of them than this would ask for about 10**12 rows.
MOST_GROUPS = 1 << 20

#: ASCII letters in lower case and all bytes of other characters stay; the rest of ASCII ends a term.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_STRIPES = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_STRIPE = "lang string, term string, df bigint, sources array<string>, counts array<bigint>"
_VALUES = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_VALUE = "part string, lang string, source string, item string, value bigint"


def terms(text: str) -> list[bytes]:
    """The terms of a text: stretches of ASCII letters and other characters beyond ASCII, only A-Z in lower case."""
    return text.encode().translate(_LETTERS).split()


def _passed_on(stripes: dict[str, dict[bytes, list]]) -> Iterator[pa.RecordBatch]:
    for lang, of in stripes.items():
        items = list(of.items())
        for a in range(0, len(items), 1 << 14):
            part = items[a : a + (1 << 14)]
            counts = [stripe[1] for _, stripe in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array([term.decode() for term, _ in part], pa.string()),
                    pa.array([stripe[0] for _, stripe in part], pa.int64()),
                    pa.array([list(c) for c in counts], pa.list_(pa.string())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                ],
                schema=_STRIPES,
            )


def fold(batches: Iterator[pa.RecordBatch], most_cells: int = MOST_CELLS) -> Iterator[pa.RecordBatch]:
    """Stripes of (text, lang, source) rows. The empty term, which no text holds, counts the documents of each source."""
    stripes: dict[str, dict[bytes, list]] = {}
    cells = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for text, lang, source in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                mine = stripes.setdefault(lang, {})
                counts = Counter(terms(text))
                counts[b""] = 1
                for term, n in counts.items():
                    stripe = mine.get(term)
                    if stripe is None:
                        mine[term] = [1, {source: n}]
                        cells += 2
                        continue
                    stripe[0] += 1
                    by_source = stripe[1]
                    if source in by_source:
                        by_source[source] += n
                    else:
                        by_source[source] = n
                        cells += 1
                if cells >= most_cells:
                    yield from _passed_on(stripes)
                    stripes, cells = {}, 0
    yield from _passed_on(stripes)


def merged(stripes: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, df, cells): one stripe for each language and term in `least_docs` documents or more, and for the empty term.

    Stripes are dealt by language and term once; each is summed by source and gathered again where it was dealt to.
    """
    dealt = stripes.repartition("lang", "term")
    cells = dealt.select("lang", "term", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("source"), F.col("df").alias("n"))), F.expr("transform(sources, (s, i) -> struct(s AS source, counts[i] AS n))"))).alias("c"))
    summed = cells.groupBy("lang", "term", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    gathered = summed.groupBy("lang", "term").agg(F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("df"), F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("cells"))
    return gathered.filter((F.col("df") >= least_docs) | (F.col("term") == ""))


def shares(counts: np.ndarray, totals: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * counts / totals) in whole numbers, for counts up to totals under 2**53 and a scale that is a power of 1000."""
    whole, rest = np.divmod(counts, totals)
    while scale > 1:
        scale //= 1000
        more, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + more
    return whole + 1


def _values(rows: Iterator[tuple[str, str, list[dict]]], heads: dict[str, tuple[list[str], list[int], int]], smoothing: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Where groups use a term more than their language (part term), and the differences of pairs of sources (part pair, the lesser source first)."""
    places = {lang: {s: i for i, s in enumerate(head[0])} for lang, head in heads.items()}
    sums: dict[str, np.ndarray] = {}
    held: dict[str, list[tuple[str, list[dict]]]] = {}

    def batch(part: str, lang: str, sources: list[str], items: list[str], values: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(items), pa.string()), pa.array([lang] * len(items), pa.string()), pa.array(sources, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=_VALUES)

    def block(lang: str) -> Iterator[pa.RecordBatch]:
        names, totals, kept = heads[lang]
        stripes, n = held.pop(lang), len(names)
        counts = np.zeros((len(stripes), n), np.int64)
        for t, (_, cells) in enumerate(stripes):
            for cell in cells:
                counts[t, places[lang][cell["source"]]] = cell["n"]
        of = np.array(totals, np.int64)
        own = shares(counts + smoothing, of + smoothing * kept, scale)
        base = shares(counts.sum(axis=1) + smoothing, of.sum() + smoothing * kept, scale)
        more = own - base[:, None]
        at, by = np.nonzero((counts > 0) & (more > 0))
        for a in range(0, len(at), 1 << 15):
            t, s = at[a : a + (1 << 15)], by[a : a + (1 << 15)]
            yield batch("term", lang, [names[i] for i in s.tolist()], [stripes[i][0] for i in t.tolist()], more[t, s].tolist())
        if n * n <= BLOCK_CELLS:
            total = sums.setdefault(lang, np.zeros((n, n), np.int64))
            for i in range(n - 1):
                total[i, i + 1 :] += np.abs(own[:, i + 1 :] - own[:, i : i + 1]).sum(axis=0)
        else:
            for i in range(n - 1):
                yield batch("pair", lang, [names[i]] * (n - 1 - i), names[i + 1 :], np.abs(own[:, i + 1 :] - own[:, i : i + 1]).sum(axis=0).tolist())

    for lang, term, cells in rows:
        stripes = held.setdefault(lang, [])
        stripes.append((term, cells))
        if len(stripes) * len(heads[lang][0]) >= BLOCK_CELLS:
            yield from block(lang)
    for lang in list(held):
        yield from block(lang)
    for lang, total in sums.items():
        names = heads[lang][0]
        for i in range(len(names) - 1):
            yield batch("pair", lang, [names[i]] * (len(names) - 1 - i), names[i + 1 :], total[i, i + 1 :].tolist())


def divergences(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, most_terms: int = MOST_TERMS, most_cells: int = MOST_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's words are from those of others, and what it uses more than its language.

    Each language keeps the V terms that stand in at least `least_docs` of its documents. A group gives a kept term the share
    p = 1 + floor(scale * (count + smoothing) / (N + smoothing * V)), N being its occurrences of kept terms. Part pair has for each other
    source of the language the sum of |p - q| over all kept terms (0 without any), part term the `most_terms` terms that the
    group holds and whose share is above the language's. Ranks count from 1, values descending, ties by item's UTF-8 bytes. All
    numbers are whole ones. Null texts, languages and sources count as empty strings; a group without a term, or whose language keeps none, has its
    pairs; a language's only source has none. Repeated rows are documents of their own. Very long texts are folded whole. An empty table
    gives no rows. Other columns, whatever their names, play no part.
    """
    work = df.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate((text_col, lang_col, source_col))])
    kept = written(merged(work.mapInArrow(lambda batches: fold(batches, most_cells), _STRIPE), least_docs), "stripes")
    by_group = kept.select("lang", "term", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source"))
    groups = written(by_group.agg(F.sum(F.when(F.col("term") != "", F.col("c.n")).otherwise(0)).alias("total")), "groups")
    if groups.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of language and source")
    sizes = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count(F.when(F.col("term") != "", 1)).alias("n")).collect()}
    heads: dict[str, tuple[list[str], list[int], int]] = {}
    for lang, source, total in sorted(map(tuple, groups.collect())):
        names, totals, _ = heads.setdefault(lang, ([], [], sizes[lang]))
        names.append(source)
        totals.append(total)
    sent = df.sparkSession.sparkContext.broadcast(heads)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(0, b.num_rows, 1024) for r in zip(*(c.to_pylist() for c in b.slice(i, 1024).columns), strict=True))
        yield from _values(rows, sent.value, smoothing, scale)

    values = written(kept.filter("term != ''").select("lang", "term", "cells").mapInArrow(emit, _VALUE), "values")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = values.filter("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)
    lesser = values.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = others.select("lang", "source", "item", F.lit(0).cast("bigint").alias("value")).unionByName(lesser).unionByName(lesser.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(top)
