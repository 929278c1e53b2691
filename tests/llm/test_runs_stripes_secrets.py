"""Periodic runs, source divergences and secret scans against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forgeline.llm import periodic_runs, queries, secret_scan, source_stripes
from forgeline.llm.common import table

SPACE = "[ \t-\r]+"


def plain_words(text):
    return [w for w in re.split(SPACE, text or "") if w]


# --- periodic runs -----------------------------------------------------------------------------------
def plain_runs(words, least=24, exponent=3):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def periodic_texts(n, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words, size, kinds = [], rng.randrange(0, 400), rng.choice([1, 2, 3, 50])
        while len(words) < size:
            unit = [f"w{rng.randrange(kinds)}" for _ in range(rng.choice([1, 2, 5, 7, 8, 15, 16, 17, 40]))]
            words += (unit * 9)[: rng.randrange(1, 9 * len(unit))] if rng.random() < 0.6 else unit
        texts.append(rng.choice([" ", "\n", " \t\x0b"]).join(words[:size]))
    return texts


@pytest.mark.parametrize("tile", [1, 64, 4096])
def test_tiles_of_any_size_find_the_runs_of_a_plain_search(tile):
    for text in periodic_texts(150, tile):
        words = plain_words(text)
        ids = periodic_runs.word_ids(text)
        for least, exponent in ((24, 3), (6, 2)):
            known, found = periodic_runs.octaves(len(ids), least, exponent), []
            for a, b, start, end, first, last in periodic_runs.tiles(len(ids), tile, least, exponent):
                found += periodic_runs.solve(ids[start:end], len(ids), known[a:b], start, first, last, least, exponent)
            own = {}
            for q, lo, hi in periodic_runs.stitched(found):
                if hi - lo + q >= max(least, exponent * q):
                    own.setdefault((lo, hi - lo + q), q)
            assert sorted((s, n, q) for (s, n), q in own.items()) == plain_runs(words, least, exponent)


@pytest.mark.parametrize(("dealt_bytes", "sent_bytes", "tile"), [(1 << 16, 64 << 20, 4096), (0, 0, 32), (200, 0, 64)])
def test_runs_on_every_path(spark, dealt_bytes, sent_bytes, tile):
    texts = [*periodic_texts(60, 7), None, "", " \n ", "a " * 23, "a " * 24, "a " * 3000, "a b " * 24 + "c " + "a b " * 24, "ä\xa0é " * 30]
    rows = [(i, t, "x") for i, t in enumerate([*texts, *texts[:10]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS string").repartition(5)
    out = periodic_runs.find(df, tile=tile, dealt_bytes=dealt_bytes, sent_bytes=sent_bytes)
    assert out.columns == ["doc_id", "text", "runs"]
    both = {r.doc_id: r for r in periodic_runs.collapse(out).select("doc_id", "collapsed", "runs", periodic_runs.strongest(F.col("runs")).alias("best")).collect()}
    assert len(both) == len(rows)
    for i, text, _ in rows:
        words, got = plain_words(text), both[i]
        runs = plain_runs(words)
        assert [(r.start, r.length, r.period) for r in got.runs] == sorted(runs, key=lambda r: (r[0], r[2]))
        assert got.collapsed == plain_collapsed(words, runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        assert best == (got.best and (got.best.start, got.best.length, got.best.period))


def test_strongest_run_compares_exactly_and_breaks_ties_by_start(spark):
    runs = [(9, 3 * 10**9 + 1, 10**9), (5, 3 * 10**9, 10**9), (7, 30, 10)]
    df = spark.createDataFrame([(runs,), ([(8, 30, 10), (5, 60, 20)],), ([],)], f"runs array<{periodic_runs.RUN}>")
    assert [r.best and r.best.start for r in df.select(periodic_runs.strongest(F.col("runs")).alias("best")).collect()] == [9, 5, None]


def test_runs_of_an_empty_table(spark):
    out = periodic_runs.collapse(periodic_runs.find(spark.createDataFrame([], "doc_id long, text string")))
    assert out.columns == ["doc_id", "runs", "collapsed"] and out.count() == 0


def test_runs_query_against_a_plain_version(spark, sf):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        words, h = plain_words(r.text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        row = got.pop(r.doc_id)
        assert row.n_runs == len(runs)
        said = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda x: (x[0], x[2])))
        assert row.runs_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert not got


# --- divergences of sources --------------------------------------------------------------------------
def plain_divergences(rows, least=30, smoothing=5, scale=10**9, most=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda c, kept=kept: {t: 1 + scale * (c[t] + smoothing) // (sum(c[u] for u in kept) + smoothing * len(kept)) for t in kept}
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(pairs)]
            more = sorted(((p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(more[:most])]
    return sorted(out)


@pytest.mark.parametrize(("most_cells", "block_cells"), [(1 << 19, 1 << 20), (20, 1 << 20), (20, 8)])
def test_divergences_with_stripes_of_any_size(spark, monkeypatch, most_cells, block_cells):
    monkeypatch.setattr(source_stripes, "BLOCK_CELLS", block_cells)
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        words = rng.choices(["The", "the", "ÄPFEL", "äpfel", "Ärger", "don't", "x1y", "ſ", "K", "漢字", "a", "b", "c", "d"], k=rng.randrange(0, 12))
        rows.append((" ".join(words), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s10", "S2", "é", None])))
    rows += [(None, "xx", "only"), ("", "yy", "s1"), ("rare", "yy", "s2"), *rows[:40]]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("VALUE", F.lit("x")).repartition(7)
    got = source_stripes.divergences(df, most_cells=most_cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergences(rows)
    few = source_stripes.divergences(df, least_docs=5, most_terms=2, most_cells=most_cells)
    assert sorted(map(tuple, few.collect())) == plain_divergences(rows, least=5, most=2)


def test_divergences_of_an_empty_table(spark):
    out = source_stripes.divergences(spark.createDataFrame([], "text string, lang string, source string"))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_shares_are_exact_for_large_counts():
    import numpy as np

    rng = random.Random(9)
    for _ in range(500):
        total = rng.randrange(1, 2**52)
        count = rng.randrange(0, total + 1)
        assert int(source_stripes.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * count // total


def test_a_term_longer_than_any_word_is_folded_whole(spark):
    rows = [("z" * 300_000, "en", s) for s in ("a", "b")] * 15
    out = source_stripes.divergences(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert sorted((r.source, r.item, r.value) for r in out) == [("a", "b", 0), ("b", "a", 0)]  # in all documents alike


# --- secrets -----------------------------------------------------------------------------------------
def plain_base(text):
    """The base spans, by scanning from each place; a failing match is skipped as a whole."""
    out = []
    assign = re.compile("(?:%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
    for kind, pattern, good in ((0, assign, lambda m: len(m[1]) >= 6), (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        at = 0
        while (m := pattern.search(text, at)) is not None:
            at = m.end()
            if good(m):
                out.append((m.start(), kind, m.end()))
    return [(k, s, e) for s, k, e in sorted(out)]


HARD = [
    "password=token:abcdefgh", "API_KEY : 'abcdef'", 'apikey":"a.b=c-d', "ſecret=abcdefg toKen=abcdefg", "secret = = abcdef", "passwd==abcdef",
    "AKIA" + "B" * 15 + " AKIA" + "B" * 16, "AKIAAKIA" + "Z9" * 20, "f" * 23 + "g" + "0" * 24, "x" + "ab" * 12 + "x", "token=" + "ab" * 14, "é token: deadbeef \U0001f600 secret=\U0001f600abcdef",
    "password=\nabcdef", "token  =  'abc", "token=abc secret=abcdef", "TOKENtoken=tokentoken=aaaaaa", "", " ", "0123456789abcdef0123456789ABCDEF",
]


def test_base_spans_of_hard_texts():
    rng = random.Random(4)
    parts = ["token", "secret", "API_KEY", "apikey", "AKIA", "=", ":", " ", "'", '"', "abc", "0f", "DEADBEEF", "é", "."]
    for text in [*HARD, *["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(3000)]]:
        assert secret_scan.base_spans(text) == plain_base(text), text


def random_token(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_the_battery_passes_random_tokens_and_rejects_ordinary_ones():
    rng = random.Random(6)
    for name, classes in secret_scan.ENCODINGS.items():
        alphabet, encoding = "".join(classes), list(secret_scan.ENCODINGS).index(name)
        passed = sum(secret_scan.battery(random_token(rng, alphabet, 40), encoding)[0] >= secret_scan.REJECTED for _ in range(400))
        assert passed >= 370, name  # the tests reject about one in a hundred
    for token in ("the-quick-brown-fox-jumps-over-the-lazy-dog", "internationalizationofapplications", "abcdefghijklmnopqrstuvwxyz0123456789", "AAAAAAAAAAAAAAAAAAAAAAAA", "aaaabbbbccccddddeeeeffff00001111", "2024-01-30T10-20-30-2024-01-31", "path/to/some/library/module/name"):
        encoding = secret_scan.encoding_of(token)
        assert encoding is None or secret_scan.battery(token, encoding)[0] < secret_scan.REJECTED, token
    assert secret_scan.encoding_of("1234567890123456") is None and secret_scan.encoding_of("a+b-c" * 5) is None


def planted(seed, n=400):
    """(texts, the places of planted keys): ordinary words, in one text of four with a key that no base pattern knows."""
    rng = random.Random(seed)
    words = ["the", "river", "of", "information", "and", "Windows", "house", "international", "telecommunication", "responsibilities", "Kraftfahrzeugversicherung", "/usr/local/share/documents", "user_name_of_the_service"]
    texts, keys = [], []
    for i in range(n):
        parts = rng.choices(words, k=60)
        if i % 4 == 0:
            at = rng.randrange(60)
            parts[at] = random_token(rng, "".join(secret_scan.ENCODINGS[rng.choice(["base62", "base64", "hex_upper", "base64_url"])]), 40)
            begin = len(" ".join(parts[:at])) + (at > 0)
            keys.append((i, begin, begin + 40))
        texts.append(" ".join(parts))
    return texts, keys


def test_planted_keys_are_found_and_ordinary_words_are_not(spark):
    texts, keys = planted(8)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    out = secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string, SPANS string").repartition(3))
    assert out.columns == ["doc_id", "base_spans", "spans"]
    found = {(r.doc_id, x.s, x.e) for r in out.collect() for x in r.spans if x.k == 3}
    assert len(found & set(keys)) >= 0.9 * len(keys)
    assert len(found - set(keys)) <= 0.05 * len(found)
    again = secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string, SPANS string").repartition(1))
    assert found == {(r.doc_id, x.s, x.e) for r in again.collect() for x in r.spans if x.k == 3}


def test_short_strata_do_not_ride_on_long_ones():
    normal = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    assert secret_scan.limits({-400: 10, -100: 5}, 100) == -400
    assert normal(-1.0) * 100 > 0.05 * 15
    assert secret_scan.limits({-100: 5}, 100) is None and secret_scan.limits({}, 0) is None


def test_secrets_of_odd_rows_and_an_empty_table(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdefgh"), (3, "token=abcdefgh"), (None, "secret: 'abcdefgh'"), (4, "x " * 200_000 + "password=abcdefgh")]
    df = spark.createDataFrame([(i, t, i, [1]) for i, t in rows], "doc_id long, text string, __c0 long, k array<int>")
    out = secret_scan.find(df)
    assert out.columns == ["doc_id", "__c0", "k", "base_spans", "spans"]
    got = sorted((r.doc_id or 0, secret_said(r.base_spans), r.k) for r in out.collect())
    assert got == [(0, "0:0:17", [1]), (1, "", [1]), (2, "", [1]), (3, "0:0:14", [1]), (3, "0:0:14", [1]), (4, "0:400000:400017", [1])]
    empty = secret_scan.find(df.filter("false"))
    assert empty.columns == out.columns and empty.count() == 0


def secret_said(spans):
    return ",".join(f"{x.k}:{x.s}:{x.e}" for x in spans)


def test_secrets_query_against_a_plain_version(spark, sf):
    got = {r.doc_id: r for r in queries.op13_secret_scan(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        base, row = plain_base(r.text or ""), got.pop(r.doc_id)
        said = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == x for k, _, _ in base) for x in range(3)]
        assert set(said.split(",")) - {""} <= set(row.spans.split(","))
    assert not got


def test_symbols_are_counted_over_the_whole_corpus(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(secret_scan, "moments", lambda symbols, real=secret_scan.moments: seen.append(list(symbols)) or real(symbols))
    texts = ["abc" * 1000, "b", None, "é!"]
    secret_scan.find(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).count()
    assert seen[0] == [sum((t or "").count(chr(c)) for t in texts) for c in range(128)]


def test_stripes_are_passed_on_when_the_memory_is_full():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "b c", "c d"] * 300), pa.array(["en"] * 900), pa.array(["s1", "s2", "s1"] * 300)], names=["c0", "c1", "c2"])
    out = list(source_stripes.fold(iter([batch]), most_cells=4))
    total = Counter()
    for b in out:
        for row in b.to_pylist():
            for s, n in zip(row["sources"], row["counts"], strict=True):
                total[row["term"], s] += n
    assert len(out) > 3 and total == {("", "s1"): 600, ("", "s2"): 300, ("a", "s1"): 300, ("b", "s1"): 300, ("b", "s2"): 300, ("c", "s2"): 300, ("c", "s1"): 300, ("d", "s1"): 300}
