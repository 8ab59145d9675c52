"""Numbers that round to nothing have no sign, in the queries and in their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name, column", [("export_vectors", "vector"), ("l2_normalize", "unit")])
def test_no_negative_zero(spark, tmp_path, name, column):
    spark.createDataFrame([(1, [1.0, -1e-11]), (2, [-1e-11, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT *, 1 AS label FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = {i: str(list(x)) for i, x in con.sql(entry.oracle_sql()[name]).fetchall()}
    df = entry.queries()[name]
    spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("*", "1 AS label").write.parquet(f"{tmp_path}/with/embeddings.parquet")
    got = {r.vec_id: str(list(r[column])) for r in df(spark, f"{tmp_path}/with").collect()}
    assert got == expected == {1: "[1.0, 0.0]", 2: "[0.0, 1.0]"}
