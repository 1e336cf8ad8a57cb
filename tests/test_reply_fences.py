"""Replies around odd documents: what is read back is the document, as the SQL says."""

import duckdb

import __spark_entry__ as entry

TEXTS = ["", " \t\n", "```", "```\n", "``` a", "a ```", "```\na\n```", "```py\na", "a\n```\n ", "`` a ``", "\u00a0a\u00a0", "\u00a0", "\u00a0```\na\n```\u00a0", "\u2003a\u0085", "\x0b a\r\n\x0c", "a\n\nb", "a", None]


def test_odd_documents_equal_the_sql(spark, tmp_path):
    rows = [(3 * i + k, text) for i, text in enumerate(TEXTS) for k in range(3)] + [(None, "```\na"), (-1, "a\n```"), (-2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["reply_fences"](spark, str(tmp_path)).select("doc_id", "body").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, duck.execute(entry.oracle_sql()["reply_fences"]).fetchall()))
