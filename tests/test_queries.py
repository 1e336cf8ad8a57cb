"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return f"{value:.12g}"
    return None if pd.api.types.is_scalar(value) and pd.isna(value) else str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v.item() if hasattr(v, "item") else v) or "" for v in row) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(TABLES)).toPandas(), duck.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if not n.startswith("op") and n != "pipeline"))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, str(TABLES)).count() > 0


def test_model_facts_against_a_plain_reading(spark):
    """The fake client's replies hold words 10 to 40 of the prompt as quote: whatever stands in the posting is kept."""
    squash = lambda s: " ".join(s.lower().split())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    rows = QUERIES["model_facts"](spark, str(TABLES)).collect()
    assert len(rows) == len(texts) and sum(r.sponsorship == "no" for r in rows) > 100
    for r in rows:
        if r.sponsorship_quote is not None:
            assert squash(r.sponsorship_quote) in squash(texts[r.doc_id]) and r.sponsorship == "no"
        elif r.sponsorship == "no":
            assert len(texts[r.doc_id].strip()) <= 10  # nothing was quoted


def test_ridge_over_a_whole_table(spark):
    """Estimates and the final order of every user by normal equations in plain numpy."""
    frame = spark.read.parquet(f"{TABLES}/embeddings.parquet").toPandas()
    vectors = np.stack(frame.embedding).astype(np.float64)
    user, scored = frame.vec_id % 5, frame.vec_id % 4 > 0
    got = {r.id: r for r in QUERIES["ridge_estimate"](spark, str(TABLES)).collect()}
    final = {r.id: r.final for r in QUERIES["learned_blend"](spark, str(TABLES)).collect()}
    for u in range(5):
        x, y = vectors[(user == u) & scored], frame.label[(user == u) & scored].to_numpy() * 10.0
        own = frame.vec_id[(user == u) & ~scored].tolist()
        z = x - x.mean(0)
        want = y.mean() + (vectors[(user == u) & ~scored] - x.mean(0)) @ np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
        assert np.allclose([got[i].learned for i in own], want, atol=1e-6) and {got[i].n for i in own} == {len(y)}
        standard = lambda v: (v - v.mean()) / v.std() if v.std() > 0 else 0 * v
        weight = 2 * len(y) / (len(y) + 200)
        assert np.allclose([final[i] for i in own], standard(np.array([i % 13 for i in own], float)) + weight * standard(want), atol=1e-6)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
