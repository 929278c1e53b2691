"""Queries run on whole texts."""

from __future__ import annotations

from forgeline.plans import queries


def test_safe_cells_see_all_of_each_text(spark, sf):
    made = {r.doc_id: r.n_chars for r in queries.QUERIES["safe_cells_whole"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert made == {i: len(t) + 3 if i % 5 == 0 else len(t) + (t.lstrip(" \t")[:1] in tuple("=+-@")) for i, t in texts.items()}
    assert max(made.values()) > 1000
