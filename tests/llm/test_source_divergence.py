"""The audit's tree and traversal against full matrices, and its query against SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from kindred.llm import source_divergence
from kindred.llm.registry import QUERIES
from tests.llm.conftest import SCHEMA, frame, prose


@pytest.mark.parametrize("shape", [(1, 1), (2, 1), (3, 40), (20, 300), (70, 9)])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.4, 1.0])
def test_tree_and_pairs(shape, share):
    r = np.random.default_rng(shape[0] * 7 + int(share * 100))
    m = np.where(r.random(shape) < share, r.integers(1, 2_000_000_000, shape), 0)
    m[: shape[0] // 2, shape[1] // 3 :] = 0  # whole empty quadrants
    m[-1] = 0  # a last row of the square that no cell names
    row, column = np.nonzero(m)
    shuffled = r.permutation(len(row))
    tree = source_divergence.K2Tree(row[shuffled], column[shuffled], m[row, column][shuffled], max(shape))
    zero = r.integers(1, 1000, shape[0])
    first, second = np.triu_indices(shape[0], 1)
    full = np.where(m > 0, m, zero[:, None])
    for places in (3, 1 << 17):
        assert source_divergence.pair_sums(tree, zero, shape[1], first, second, places).tolist() == np.abs(full[first] - full[second]).sum(axis=1).tolist()


def sql(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({source_divergence.ORACLE})").fetchall(), key=str)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """Languages and sources that are null, empty, without terms, and with many rows."""
    at = tmp_path_factory.mktemp("audit")
    mixed = frame(spark, [r for r in rows if r[0] not in (50, 51)])
    more = [(1000 + i, (prose(i, 30 + i % 50, 60) if i % 9 else ["", None, "12 _ #"][i % 3]), ["en", "fr", None, "xx"][i % 4] if i % 50 else "rare", None if i % 13 == 0 else f"s{i % 7 if i % 3 else 0}", 1) for i in range(600)]
    more += [(None, "Über ÀB éa " * 40, "en", "accents", 1)] * 35 + [(7, None, "en", "empty", 0), (8, "123", "fr", "digits", 3)]
    mixed.unionByName(spark.createDataFrame(more, SCHEMA.split(", batch")[0]), allowMissingColumns=True).repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_query_on_odd_groups(spark, folder):
    found = QUERIES["op13_source_divergence"](spark, folder)
    expected = sql(folder)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect()), key=str) == expected
    assert {(r[0], r[1]) for r in expected} >= {("", ""), ("en", "empty"), ("fr", "digits")} and any(r[4] == 0 for r in expected if r[0] == "rare")


@pytest.mark.parametrize("size", [{"cells": 10, "rows": 3}, {"cells": 50, "rows": 512}, {"top": 3}])
def test_blocks_give_the_same(spark, folder, size):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found, top = source_divergence.divergence_audit(docs, **size), size.get("top", 50)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect()), key=str) == [r for r in sql(folder) if r[2] == "pair" or r[5] <= top]


def test_probability_is_exact(spark):
    rows = [(0, 1, 1), (10**12, 3 * 10**12 + 1, 10**6), (9 * 10**15, 9 * 10**15, 7), (3, 0, 0)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("n", source_divergence.probability("n", "total", "v").alias("p")).collect()
    assert {r.n: r.p for r in got} == {n: 1 + 10**9 * (n + 5) // (t + 5 * v) if t + 5 * v else None for n, t, v in rows}


def test_no_documents(spark, no_docs):
    assert source_divergence.divergence_audit(no_docs).count() == 0
