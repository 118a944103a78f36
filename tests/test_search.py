"""Nearest vectors against SQL, with copies, ties, gaps and odd components; no pair becomes a row."""

from __future__ import annotations

import duckdb
import numpy as np

from tidemark.queries.dynamics import QUERIES


def test_knn_vectors_equals_sql_on_odd_vectors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (400, 4)).astype(float).tolist()  # many ties
    vectors[100:220] = [vectors[100]] * 120
    vectors[20], vectors[21], vectors[40], vectors[41], vectors[60], vectors[61], vectors[62] = None, None, [1.0, None, 0.0, 2.0], [None] * 4, [1.0, 2.0], [float("nan")] * 4, [float("inf")] * 4
    rows = [*enumerate(vectors), (20, [0.0] * 4), (120, vectors[100]), (None, [0.0] * 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    query = QUERIES["knn_vectors"]
    found = query.run(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, con.sql(query.sql).fetchall()))
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
