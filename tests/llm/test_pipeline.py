"""The pipeline: each stage on its own input against plain rules, and the whole."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as cp
from forgeline.llm import byte_bpe, near, quality, queries
from forgeline.llm.common import table, written


def odd(df):
    """The rows, with nulls, empty and repeated ones."""
    extra = df.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    return df.unionAll(extra).unionAll(df.limit(4)).unionAll(df.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(10**9).cast("long")))


def test_stages(spark, sf):
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "simhash_dedup", "pii", "mixing", "byte_bpe"]
    docs = written(odd(table(spark, sf, "documents")), "t")
    good = written(cp.quality_stage(spark, docs, sf), "t")
    stats = written(quality.features(docs.select("doc_id", "text")), "t")
    kept = quality.scored(stats, quality.train(stats, table(spark, sf, "labels"))).filter(F.col("score") >= quality.ACCEPT)
    assert good.count() == kept.count() and good.columns == list(cp.COLUMNS)

    # the first of each component of all pairs of texts with a five-word Jaccard of 0.8 or more, null ids last
    once = written(cp.dedup_stage(spark, good, sf), "t")
    rows = sorted(((r.doc_id, r.text or "") for r in good.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [set(near.shingles(t).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and (len(x & sets[j]) >= 0.8 * len(x | sets[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    assert sorted(str(r.doc_id) for r in once.collect()) == sorted(str(rows[i][0]) for i in set(label))

    masked = written(cp.pii_stage(spark, once, sf), "t")
    assert masked.count() == once.count() and masked.filter("n_chars != length(text)").count() == 0
    assert masked.filter(F.col("text").rlike(r"[a-z0-9.]+@mail[0-9]\.example\.com")).count() == 0
    clean = once.filter(~F.col("text").rlike("[0-9]|@")).select("doc_id", "text")
    assert clean.exceptAll(masked.select("doc_id", "text")).count() == 0

    mixed = written(cp.mixing_stage(spark, masked, sf), "t")
    assert mixed.columns == list(cp.COLUMNS) and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixed.distinct().exceptAll(masked.distinct()).count() == 0

    coded = cp.token_stage(spark, mixed, sf)
    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    rows = coded.collect()
    assert len(rows) == mixed.count() and all(r.token_ids == enc.encode_ordinary(texts[r.doc_id] or "") for r in rows)


def test_run_and_queries(spark, sf):
    assert cp.run(spark, sf).count() > 0
    assert sorted(queries.QUERIES) == sorted(f"op{n}_{x}" for n, x in enumerate("hamming_search chat ann_forest mixing simhash pii quality token_counts url_filter byte_bpe periodic_runs source_stripes secret_scan".split(), 1))
