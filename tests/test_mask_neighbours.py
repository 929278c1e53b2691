"""Nine-digit numbers that share one separator are all masked, by the query and by its SQL."""

import duckdb

from forgeline.plans.queries import ORACLE_SQL, QUERIES


def test_neighbouring_numbers(spark, tmp_path):
    texts = ["123456789 987654321", "123456789,987654321,123456789 x", "1234567890 123456789", "no number"]
    spark.createDataFrame([(i + 1, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine = QUERIES["pii_mask_documents"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.redactions for r in mine] == [2, 3, 1, 0]
    assert [tuple(r) for r in mine] == con.sql("SELECT doc_id, masked_sha, redactions FROM (" + ORACLE_SQL["pii_mask_documents"] + ") ORDER BY doc_id").fetchall()
