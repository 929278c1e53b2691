"""The near-duplicate stage of the pipeline against planted copies and every pair's similarity."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from forgeline.llm import near
from forgeline.llm.common import table


def jaccard(a, b):
    x, y = set(near.shingles(a).tolist()), set(near.shingles(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(texts):
    """The first of each component of all pairs at 0.8 or more, by the place in texts."""
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= near.SIMILAR:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted(set(label))


def test_near_copies_are_dropped_and_others_stay(spark, sf):
    rng = random.Random(5)
    texts = []
    for size in (14, 40, 400) * 6:
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts.append(" ".join(words))
        for cut in (1, 1 + size // 60, 1 + size // 25, 1 + size // 8, 2 + size // 5):
            at = rng.randrange(size - cut)
            texts.append(" ".join([*words[:at], *(f"x{rng.randrange(10**6)}" for _ in range(cut)), *words[at + cut :]]))
    texts += ["", " \n", "one two", "One  two", "one three"]
    found = [jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i]]
    assert sum(0.8 <= x < 0.95 for x in found) > 10 and sum(0.5 < x < 0.8 for x in found) > 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.dedup_stage(spark, docs, sf).select("doc_id").collect()) == brute(texts)


def test_parity_maps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = random.Random(7)
    for size in (0, 1, 30, 300, 6000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for cut in (0, 1, size // 20, size // 3):
            a, b = near.shingles(" ".join(words)), near.shingles(" ".join([*words[cut:], *(f"x{rng.randrange(10**6)}" for _ in range(cut))]))
            bits = int(sum(bin(int(x) & (2**64 - 1)).count("1") for x in near.parity(a) ^ near.parity(b)))
            assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (cut or not bits)


def test_a_group_of_texts_edited_each_in_its_own_way(spark, sf):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 4, 5, 6))):
            words[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.dedup_stage(spark, docs, sf).select("doc_id").collect()) == brute(texts)


def test_documents_as_every_pair_says(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    kept = sorted(r.doc_id for r in cp.dedup_stage(spark, docs, sf).select("doc_id").collect())
    assert kept == [rows[i][0] for i in brute([t for _, t in rows])]
