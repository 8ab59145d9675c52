"""Unit vectors are rounded as their SQL rounds them; zeros, gaps and empty vectors too."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

ODD = [[0.0, -0.0], [], None, [1.0, None, 2.0], [None], [0.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [-1.0, 1024.0], [3.0, -4.0]]
# An element of each is 0.9151282884999999 or 0.8098097184999999, of which SQL makes a half by * 10^9.
HALVES = [[-1.7954299449920654, 0.7909825444221497], [0.9662947058677673, 1.333773136138916]]


@pytest.mark.parametrize("name, column", [("export_vectors", "vector"), ("l2_normalize", "unit")])
def test_same_as_sql(spark, tmp_path, name, column):
    rows = [(i, v, 1) for i, v in enumerate(ODD + HALVES)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = {i: str(x) for i, x in con.sql(entry.oracle_sql()[name]).fetchall()}
    assert {r.vec_id: str(r[column]) for r in entry.queries()[name](spark, str(tmp_path)).collect()} == expected
