"""Contexts of one word at the start of a line, identifiers with letters, and the seeds that suffice."""

from __future__ import annotations

import pytest

from forgeline.llm import pii

PHONES = ["+84 912 345 678", "+1 202 555 0147", "+44 20 7946 0958"]


@pytest.mark.parametrize(("before", "token"), [("Phone: ", "0912 345 679"), ("some text\nPhone: ", "0912 345 679"), ("my member number ", "AB123456"), ("my member number ", "user_4821")])
def test_three_seeds_find_one_more(spark, before, token):
    texts = [f"{before}{p} and so on" for p in PHONES] + [f"{before}{token} and so on", f"no label but {token} here"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    assert [len(r.base_spans) for r in rows] == [1, 1, 1, 0, 0]
    assert [(x.s, x.e) for x in rows[3].spans] == [(len(before), len(before) + len(token))] and not rows[4].spans


def test_letters_tell_instances_apart(spark):
    texts = ["my member number AB1234567", "my member number CD1234567"]
    found = pii._scan(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").selectExpr("explode(__mentions) AS m").select("m.instance").collect()
    assert sorted(r.instance for r in found) == ["ab1234567", "cd1234567"]
