"""Edge cases, determinism and plain versions of the training-data operators."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from forgeline.llm import ann_forest, byte_bpe, chat, common, hamming_search, mixing, pii, quality, simhash, token_prefix, url_filter
from forgeline.llm.common import table, written


def rows_of_vectors(n, d, seed, first=0):
    rng = np.random.default_rng(seed)
    return [(first + i, rng.standard_normal(d).astype("float32").tolist()) for i in range(n)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


# --- searches ---------------------------------------------------------------------------------------
def test_hamming_codes_of_short_vectors(spark):
    rows = rows_of_vectors(40, 5, 1)
    out = hamming_search.top_k(vectors(spark, rows), k=4, every=20).collect()
    code = {i: [x > 0 for x in v] for i, v in rows}
    for q in (0, 20):
        best = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items() if i != q)[:4]
        assert sorted((r.rank, r.distance, r.vec_id) for r in out if r.query_id == q) == [(n + 1, d, i) for n, (d, i) in enumerate(best)]


def test_forest_with_vectors_of_several_lengths(spark):
    rows = rows_of_vectors(150, 64, 2) + rows_of_vectors(60, 3, 3, 1000) + [(5000, [1.0])]
    df = vectors(spark, rows + rows[:30]).withColumn("SCORE", F.lit("x")).withColumn("vec", F.lit(1)).withColumn("d", F.lit(2))
    out = ann_forest.top_k(df, k=5, every=50).collect()
    length = {i: len(v) for i, v in rows}
    unit = {i: np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) for i, v in rows}
    assert {r.query_id for r in out} == {0, 50, 100, 1000, 1050}  # 5000 has no vector of its length but its own
    for q in (0, 50, 100, 1000, 1050):
        best = sorted((-float(unit[q] @ u), i) for i, u in unit.items() if i != q and length[i] == length[q])[:5]
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in best]  # a leaf of each tree holds them all


def test_forest_answers_are_alike_on_any_cluster(spark, sf, monkeypatch):
    df = table(spark, sf.replace("0.001", "0.1"), "embeddings")
    answers = []
    for blocks, parts in ((1, 1), (7, 9)):
        monkeypatch.setattr(ann_forest, "blocks", lambda *a, n=blocks: n)
        out = ann_forest.top_k(df.repartition(parts), k=5, every=50, shard_bytes=1 << 18, trees=4, patience=0.1)
        answers.append(sorted(map(tuple, out.collect())))
    assert answers[0] == answers[1]
    fewer = {(r[0], r[2]) for r in answers[0]}
    whole = {(r.query_id, r.vec_id) for r in ann_forest.top_k(df, k=5, every=50, patience=1e9).collect()}
    assert len(fewer & whole) < len(whole)  # a small share does prune


def _searched(data, queries):
    """(recall of the 5 nearest, mean share met, seconds of the searches, seconds of the module's own scan) over `queries` rows of one shard."""
    import time

    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    forest = ann_forest.Forest.grown(units)
    far = forest.beyond(units[queries])
    began, answers, share = time.perf_counter(), [], 0.0
    for q, beyond in zip(queries, far, strict=True):
        rows, met = forest.nearest(units[q], units, beyond.tolist(), 6, ann_forest.PATIENCE)
        scores = ann_forest.cosines(data[q], data[rows])
        answers.append({int(i) for i in rows[np.argsort(-scores, kind="stable")] if i != q}.intersection([int(i) for i in rows[np.argsort(-scores, kind="stable")[:6]]]))
        share += met / len(data) / len(queries)
    middle, hits = time.perf_counter(), 0
    for q, answer in zip(queries, answers, strict=True):
        scores = ann_forest.cosines(data[q], data)
        scores[q] = -2
        hits += len(answer & {int(i) for i in np.argsort(-scores, kind="stable")[:5]})
    return hits / 5 / len(queries), share, middle - began, time.perf_counter() - middle


def test_forest_on_even_and_on_clustered_vectors():
    rng = np.random.default_rng(11)
    queries = rng.choice(20_000, 60, replace=False).tolist()
    recall, share, _, _ = _searched(rng.standard_normal((20_000, 64)), queries)
    assert recall >= 0.9 and share < 0.7
    centres = rng.standard_normal((400, 64))
    recall, share, searched, scanned = _searched(centres[rng.integers(0, 400, 20_000)] + 0.25 * rng.standard_normal((20_000, 64)), queries)
    assert recall >= 0.99 and share < 0.1 and searched < scanned


# --- mixing ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("ids", ["CAST(NULL AS BIGINT)", "doc_id % 3"])
def test_mix_chooses_the_same_texts_without_ids(spark, sf, ids):
    df = table(spark, sf, "documents").withColumn("doc_id", F.expr(ids))
    df = df.unionAll(df.limit(20))
    chosen = [sorted((r.doc_id or -1, r.text, r.taken) for r in mixing.mix(df.repartition(n), keep=("text",)).collect()) for n in (1, 7)]
    assert chosen[0] == chosen[1]


@pytest.mark.parametrize("covered", [1, 40, 1000, 10**7])
def test_fill_meets_targets_on_both_sides_of_what_the_table_covers(covered):
    rng = np.random.default_rng(covered)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 60, 20))
        counts = rng.integers(1, 200, len(lengths))
        total = int((lengths * counts).sum())
        target = float(rng.uniform(0, 3)) * total
        passes, extra = mixing.fill(lengths, counts, target, 3, covered)
        taken = passes * total + int((lengths * extra).sum())
        assert (extra >= 0).all() and (extra <= counts).all() and taken <= target + 1e-6
        assert taken >= int(target) - (60 if covered < 100 else 1)


# --- personal data -----------------------------------------------------------------------------------
def plain_reliable(edges, kinds, rounds, support):
    """(pattern, form, k): reliability, from edges {(pattern, form, instance)} and the kinds of known instances at each edge."""
    seeds = {}
    for (p, f, i), ks in kinds.items():
        for k in ks:
            seeds.setdefault((p, f, k), set()).add(i)
    seeds = {x: s for x, s in seeds.items() if len(s) >= support}
    open_ = {(p, f) for p, f, _ in seeds}
    edges = {e for e in edges if e[:2] in open_}
    size = {}
    for p, f, _ in edges:
        size[p, f] = size.get((p, f), 0) + 1
    base = {(i, k): 1.0 for (p, f, i), ks in kinds.items() if (p, f) in open_ for k in ks}
    scores = dict(base)
    for _ in range(rounds):
        patterns = {}
        for p, f, k in seeds:
            known = sum(scores.get((i, k), 0.0) for q, g, i in edges if (q, g) == (p, f))
            patterns[p, f, k] = known / (size[p, f] + 1)
        lent = {}
        for (p, f, k), r in patterns.items():
            if r >= pii.BELIEVED:
                for q, g, i in edges:
                    if (q, g) == (p, f):
                        lent[i, k] = lent.get((i, k), 1.0) * (1 - r)
        scores = dict(base)
        for x, miss in lent.items():
            scores[x] = max(scores.get(x, 0.0), 1 - miss)
    return {x: r for x, r in patterns.items() if r >= pii.FINDS}


def test_graph_scores_as_a_plain_version_says(spark):
    rng = random.Random(4)
    rows, edges, kinds = [], set(), {}
    for _ in range(400):
        p, i = f"p{rng.randrange(6)}", f"i{rng.randrange(60)}"
        k = rng.choice([0, 3, 3]) if int(i[1:]) % 3 else -1
        rows.append((k, p, "number", i))
        edges.add((p, "number", i))
        if k >= 0:
            kinds.setdefault((p, "number", i), set()).add(k)
    got = {(r.pattern, r.form, r.k): r.reliability for r in pii.reliable_patterns(spark.createDataFrame(rows, "k int, pattern string, form string, instance string")).collect()}
    expected = plain_reliable(edges, kinds, pii.ROUNDS, pii.SUPPORT)
    assert got.keys() == expected.keys() and all(math.isclose(got[x], expected[x]) for x in got) and got
    assert pii.reliable_patterns(spark.createDataFrame([], "k int, pattern string, form string, instance string")).count() == 0


PHONES = ["+84 912 345 678", "+1 202 555 0147", "+44 20 7946 0958"]


@pytest.mark.parametrize(("before", "after"), [("{n} code: ", ""), ("{n} rang ", " on the line"), ('{n} phone = "', '" end')])
def test_contexts_of_one_word_on_the_right_and_of_both_sides(spark, before, after):
    texts = [f"{before.format(n=f'w{i} v{i}')}{p}{after}" for i, p in enumerate(PHONES * 2)] + [f"{before.format(n='w9 v9')}0912 345 679{after}", "no label but 0912 345 679 here"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    at = len(before.format(n="w9 v9"))
    assert [(x.s, x.e) for x in rows[6].spans] == [(at, at + 12)] and not rows[6].base_spans and not rows[7].spans


def test_repeated_rows_clashing_names_and_no_graph(spark):
    texts = ["mail a@b.co now", "mail a@b.co now", None, "no data", ""]
    df = spark.createDataFrame([(1, t) for t in texts], "__text int, text string").withColumn("__n", F.lit(1))
    out = pii.mask(df)
    assert out.columns == df.columns and sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, ["mail [EMAIL] now"] * 2 + [None, "no data", ""]))
    found = pii.find(df)
    assert found.columns == ["__text", "__n", "base_spans", "spans"] and found.filter("size(spans) = 1").count() == 2
    assert pii.mask(df.filter("false")).count() == 0


def test_many_matches_in_one_text(spark):
    text = "1.2.3.4 a@b.co 12345678 " * 4000
    row = pii.find(spark.createDataFrame([(1, text)], "id int, text string")).select(pii.said(F.col("base_spans")).alias("b")).first()
    expected = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"a@b\.co", text)] + [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"1\.2\.3\.4", text)]
    assert row.b == ",".join(expected)


# --- quality -----------------------------------------------------------------------------------------
def plain_scores(x, y, fold, every):
    """Scores by least squares of stacked rows and the min-max formula of isotonic regression."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    rng = np.random.default_rng(42)
    w, b = rng.standard_normal((x.shape[1], quality.FEATURES)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def cosines(v):
        z = np.cos(np.clip((v - mean) / np.where(scale > 1e-9, scale, 1.0), -8, 8) @ w + b) * math.sqrt(2 / quality.FEATURES)
        return np.column_stack([z, np.ones(len(v))])

    def ridge(v, t):
        root = np.full(quality.FEATURES + 1, math.sqrt(quality.RIDGE * len(v) / quality.FEATURES))
        root[-1] = math.sqrt(1e-9)
        return np.linalg.lstsq(np.vstack([cosines(v), np.diag(root)]), np.concatenate([t, np.zeros(len(root))]), rcond=None)[0]

    unseen = np.zeros(len(x))
    for k in np.unique(fold):
        unseen[fold == k] = cosines(x[fold == k]) @ ridge(x[fold != k], y[fold != k])
    bins = np.clip((unseen + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    knots = np.unique(bins)
    n, ones = np.array([(bins == k).sum() for k in knots]), np.array([y[bins == k].sum() for k in knots])
    cn, co = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(ones)])
    values = [max(min((co[j + 1] - co[i]) / (cn[j + 1] - cn[i]) for j in range(m, len(knots))) for i in range(m + 1)) for m in range(len(knots))]
    return np.interp(cosines(every) @ ridge(x, y), (knots + 0.5) / quality.BINS * 2 - 0.5, values)


def test_quality_as_a_plain_refit_says(spark, sf):
    where = sf.replace("0.001", "0.01")
    docs, labels = table(spark, where, "documents"), table(spark, where, "labels")
    stats = written(quality.features(docs.select("doc_id", "text")), "t")
    known = stats.join(labels, "doc_id").filter(~quality.held_out(F.col("doc_id"))).select("statistics", "quality", F.pmod(F.xxhash64("statistics"), F.lit(quality.FOLDS)).alias("fold")).collect()
    every = stats.orderBy("doc_id").collect()
    expected = plain_scores(np.array([r.statistics for r in known]), np.array([r.quality for r in known], dtype=float), np.array([r.fold for r in known]), np.array([r.statistics for r in every]))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert np.quantile([abs(got[r.doc_id] - e) for r, e in zip(every, expected, strict=True)], 0.995) < 1e-5


def test_order_of_words_changes_no_count(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "|", "alpha", "delta", "9"] * 30
    moved = words.copy()
    rng.shuffle(moved)
    counts = [quality.STATISTICS.index(n) for n in ("log_words", "word_length", "upper", "digit", "punct", "lone_punct", "distinct", "one_word_share")]
    a, b = quality.statistics(" ".join(words)), quality.statistics(" ".join(moved))
    assert [a[i] for i in counts] == [b[i] for i in counts]


def test_quality_of_repeated_rows(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = quality.classify(docs.unionAll(docs.limit(30)), labels)
    assert out.count() == docs.count() + 30 and out.groupBy("doc_id").agg(F.count_distinct("score").alias("n")).filter("n > 1").count() == 0


# --- others ------------------------------------------------------------------------------------------
def test_decode_of_null_and_empty_ids(spark):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(1, None), (2, []), (3, [72, 105])], "id int, token_ids array<int>").withColumn("DECODED", F.lit(1))
    out = {r.id: bytes(r.decoded) for r in byte_bpe.decode(df, ranks, pattern).collect()}
    assert out[1] == b"" and out[2] == b"" and out[3] == byte_bpe.encoding(ranks, pattern).decode_bytes([72, 105])


def test_cuts_stand_only_where_the_pattern_sees_white_space():
    assert byte_bpe.pieces("abc\x1cdef", 2) == ["abc\x1cdef"] and byte_bpe.pieces("abc　def ", 3) == ["abc", "　def", " "]


def test_steps_over_an_int8_are_an_error(monkeypatch):
    model = token_prefix.PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(model, "prefixes", lambda chunk: ([0, 200], [True, True]))
    with pytest.raises(ValueError, match="int8"):
        model.steps("a")


def test_scratch_tables_of_a_scope_are_deleted(spark):
    df = spark.range(3)
    with common.scope() as name:
        inner = written(df, "inner")
    outer = written(df, "outer")
    assert inner.count() == outer.count() == 3
    common.forget(spark, name)
    assert outer.count() == 3
    with pytest.raises(Exception, match=r"(?i)not.*exist|not found"):
        spark.read.parquet(inner.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_stages_of_empty_tables_and_clashing_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.filter("false"), sf).count() == 0, name
    few = docs.limit(30).withColumn("SCORE", F.lit(1)).withColumn("statistics", F.lit("x")).withColumn("__row", F.lit(1)).withColumn("taken", F.lit(0)).withColumn("token_ids", F.lit(1))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, few, sf)
        assert out.columns == list(cp.COLUMNS) and (name == "mixing" or out.count() <= 30)


def test_empty_inputs(spark, sf):
    docs = table(spark, sf, "documents").filter("false")
    assert simhash.components(docs).count() == 0 and mixing.mix(docs).count() == 0
    assert url_filter.judge(table(spark, sf, "pages").filter("false").select("page_id", "url"), spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "host string")).count() == 0
    assert chat.digest(chat.examples(table(spark, sf, "conversations").filter("false"))).count() == 0
