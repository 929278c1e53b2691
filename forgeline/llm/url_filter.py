"""URL filter over a sorted array of 64-bit digests.

Rules (host, path, verdict), blocked hosts and blocked words of hosts become one list of strings, kept as
arrays: xxh64 keys in order, the full strings, and the verdicts. Workers map the keys from a file,
probe them by vectorised binary search, and confirm a hit by the stored string, so that a collision of
digests decides nothing. A rule fits its host and all subdomains if the URL's path starts with the
rule's path; the longest rule wins.

The arrays are built by ranges of keys, each in a task of its own. A list of a checked size is sent to all tasks
whole; of a longer one each range meets the strings to be looked up that fall into it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.llm.common import quoted, without, written

#: A list is sent to all tasks up to this size of its arrays.
MOST_LIST_BYTES = 64 << 20
#: Ranges of keys, each of which is sorted in one task: a power of two.
RANGES = 1 << 8
SEED = 42
#: What a string in the list starts with: a rule, a host, a word between the dots and hyphens of a host.
RULE, HOST, WORD = "r:", "h:", "w:"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


class DigestArray:
    """Distinct strings sorted by digest, each with whether it blocks."""

    def __init__(self, keys: bytes, ends: np.ndarray, strings: bytes, blocks: np.ndarray) -> None:
        self.keys, self.ends, self.strings, self.blocks = keys, ends, strings, blocks
        self.token = xxhash.xxh64_hexdigest(keys + strings + blocks.tobytes())

    @classmethod
    def of(cls, strings: list[str], blocks: list[bool]) -> DigestArray:
        raw = [s.encode() for s in strings]
        keys = np.array([xxhash.xxh64_intdigest(s, SEED) for s in raw], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        raw = [raw[i] for i in order]
        return cls(keys[order].tobytes(), np.cumsum([len(s) for s in raw]).astype(np.int64), b"".join(raw), np.array(blocks, dtype=bool)[order])

    @classmethod
    def joined(cls, parts: list[DigestArray]) -> DigestArray:
        """Arrays of ranges of keys, in the order of the ranges, as one."""
        starts = np.cumsum([0, *[len(p.strings) for p in parts]])
        ends = [p.ends + s for p, s in zip(parts, starts[:-1], strict=True)]
        return cls(b"".join(p.keys for p in parts), np.concatenate([np.empty(0, np.int64), *ends]), b"".join(p.strings for p in parts), np.concatenate([np.empty(0, bool), *[p.blocks for p in parts]]))

    def string(self, i: int) -> bytes:
        return self.strings[self.ends[i - 1] if i else 0 : self.ends[i]]

    def find(self, wanted: list[str]) -> np.ndarray:
        """For each string its place, or -1."""
        keys = _mapped(self.token, self.keys)
        found = np.full(len(wanted), -1, dtype=np.int64)
        if not len(keys) or not wanted:
            return found
        raw = [w.encode() for w in wanted]
        digests = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in raw), dtype=np.uint64, count=len(raw))
        at = np.searchsorted(keys, digests)
        for i in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == digests):
            j = int(at[i])
            while j < len(keys) and keys[j] == digests[i]:
                if self.string(j) == raw[i]:
                    found[i] = j
                    break
                j += 1
        return found


@lru_cache(maxsize=8)
def _mapped(token: str, keys: bytes) -> np.ndarray:
    """The keys as a map of a nameless file of this worker, once a process; no other task reads it."""
    if not keys:
        return np.empty(0, dtype=np.uint64)
    with tempfile.TemporaryFile() as f:
        f.write(keys)
        f.flush()
        return np.memmap(f, dtype=np.uint64, mode="r")


def _range(text: Column) -> Column:
    """The range of keys that a string falls into: the first bits of its digest."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - RANGES.bit_length() + 1).cast("int")


def arrays(entries: DataFrame, hosts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(range, keys, ends, strings, blocks): the list as arrays, one row a range of keys, written. Of a rule given twice, a blocking one stays.

    Null and empty hosts and words are in no list.
    """
    bad = F.raise_error(F.concat(F.lit("a verdict is allow or block, not "), F.coalesce("verdict", F.lit("null"))))
    checked = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict") == "block").otherwise(bad.cast("boolean"))
    listed = entries.select(F.concat(F.lit(RULE), "host", "path").alias("text"), checked.alias("blocks"))
    for kind, df in ((HOST, hosts), (WORD, words)):
        if df is not None:
            name = quoted(df.columns[0])
            listed = listed.unionByName(df.filter(name.isNotNull() & (name != "")).select(F.concat(F.lit(kind), name).alias("text"), F.lit(True).alias("blocks")))
    listed = listed.filter("text IS NOT NULL").groupBy("text").agg(F.bool_or("blocks").alias("blocks")).withColumn("range", _range(F.col("text")))

    def sorted_range(pdf: pd.DataFrame) -> pd.DataFrame:
        a = DigestArray.of(pdf["text"].tolist(), pdf["blocks"].tolist())
        return pd.DataFrame({"range": [pdf["range"].iloc[0]], "keys": [a.keys], "ends": [a.ends.tobytes()], "strings": [a.strings], "blocks": [a.blocks.tobytes()]})

    return written(listed.groupBy("range").applyInPandas(sorted_range, "range int, keys binary, ends binary, strings binary, blocks binary"), "digests")


def _array(row) -> DigestArray:
    return DigestArray(bytes(row["keys"]), np.frombuffer(row["ends"], np.int64), bytes(row["strings"]), np.frombuffer(row["blocks"], bool))


def _wanted(host: Column, path: Column, lengths: list[int]) -> Column:
    """What could be in the list for this URL: each domain above its host with each beginning of its path, each domain, each word."""
    labels = F.split(host, r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    rules = F.flatten(F.transform(domains, lambda d: F.transform(cuts, lambda n: F.concat(F.lit(RULE), d, F.left(path, n)))))
    return F.array_distinct(F.concat(rules, F.transform(domains, lambda d: F.concat(F.lit(HOST), d)), F.transform(F.split(host, "[.-]", -1), lambda w: F.concat(F.lit(WORD), w))))


def _decided(found: dict[str, bool]) -> tuple[str | None, str]:
    """Rule and verdict of a URL by what of it is in the list: the longest rule, of equally long ones the first by code point."""
    rules = [s for s in found if s.startswith(RULE)]
    if rules:
        best = min(rules, key=lambda s: (-len(s), s))
        return best[len(RULE) :], "block" if found[best] else "allow"
    return None, "block" if found else "allow"


def judge(df: DataFrame, entries: DataFrame, blocklist: DataFrame, words: DataFrame | None = None, url_col: str = "url", most_list_bytes: int = MOST_LIST_BYTES) -> DataFrame:
    """df without `url_col`, with host, path, rule and verdict of each URL.

    `entries` (host, path, verdict) are rules: the longest that fits is named in `rule` and decides.
    Where none fits, the lists decide: block if `blocklist` (one column of hosts) holds the host or a parent domain, or `words`
    (one column) one of the words between dots and hyphens of the host; else allow. A null URL has an empty host
    and path, no rule and is allowed, as empty strings are in no list. Repeated rows stay; input columns with the names of
    the outputs, in any case, are replaced. An empty table gives no rows.
    """
    outputs = ["host", "path", "rule", "verdict"]
    rest = [c for c in without(df, outputs).columns if c != url_col]
    parsed = df.select(*[quoted(c) for c in rest], host_of(quoted(url_col)).alias("host"), path_of(quoted(url_col)).alias("path"))
    ranges = arrays(entries, blocklist, words)
    lengths = sorted(r["n"] for r in entries.select(F.length("path").alias("n")).filter("n IS NOT NULL").distinct().collect())  # the lengths of a URL's path at most
    size = ranges.agg(F.coalesce(F.sum(F.octet_length("keys") + F.octet_length("ends") + F.octet_length("strings") + F.octet_length("blocks")), F.lit(0)).alias("n")).first()["n"]
    if size <= most_list_bytes:
        return _mapped_over(parsed, DigestArray.joined([_array(r) for r in ranges.orderBy("range").collect()]), lengths)
    return _by_range(parsed, rest, ranges, lengths)


def _mapped_over(parsed: DataFrame, array: DigestArray, lengths: list[int]) -> DataFrame:
    """Every task looks its URLs up in the whole list."""
    sent = parsed.sparkSession.sparkContext.broadcast(array)
    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = sent.value
        for batch in batches:
            urls = [tuple(w) for w in batch.column(batch.num_columns - 1).to_pylist()]
            distinct = list(dict.fromkeys(urls))
            strings = list(dict.fromkeys(s for u in distinct for s in u))
            at = array.find(strings)
            hits = {strings[i]: bool(array.blocks[at[i]]) for i in np.flatnonzero(at >= 0)}
            decided = {u: _decided({s: hits[s] for s in u if s in hits}) for u in distinct}
            columns = [pa.array([decided[u][i] for u in urls], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return parsed.withColumn("__wanted", _wanted(F.col("host"), F.col("path"), lengths)).mapInArrow(run, schema)


def _by_range(parsed: DataFrame, rest: list[str], ranges: DataFrame, lengths: list[int]) -> DataFrame:
    """Each distinct string is looked up once, where the range of its key lies; hits come back to the URLs that want them."""
    urls = written(parsed.select("host", "path").distinct().select("host", "path", F.explode(_wanted(F.col("host"), F.col("path"), lengths)).alias("text")), "wanted")
    strings = urls.select("text").distinct().withColumn("range", _range(F.col("text")))

    def probe(array: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found, blocks = np.empty(0, dtype=bool), []
        if len(array) and len(wanted):
            a = _array(array.iloc[0])
            at = a.find(wanted["text"].tolist())
            found, blocks = at >= 0, a.blocks[at[at >= 0]]
            return pd.DataFrame({"text": wanted["text"][found], "blocks": blocks})
        return pd.DataFrame({"text": pd.Series([], dtype=str), "blocks": pd.Series([], dtype=bool)})

    hits = written(ranges.groupBy("range").cogroup(strings.groupBy("range")).applyInPandas(probe, "text string, blocks boolean"), "hits")
    rule = F.col("text").startswith(RULE)
    best = F.min(F.when(rule, F.struct((-F.length("text")).alias("n"), "text", "blocks"))).alias("best")
    judged = written(urls.join(hits, "text").groupBy("host", "path").agg(best, F.bool_or(~rule).alias("listed")), "judged")
    verdict = F.when(F.coalesce("best.blocks", "listed", F.lit(False)), "block").otherwise("allow")
    return parsed.join(judged, ["host", "path"], "left").select(*[quoted(c) for c in rest], "host", "path", F.substring("best.text", len(RULE) + 1, 1 << 30).alias("rule"), verdict.alias("verdict"))
