"""Costly expressions are computed once a row, in more tasks than a small file has splits."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from kindred.jobs import articles, parsers, posts
from kindred.session import spread

PER_PART = ["parse_analysis", "repaired_analysis", "parse_taxonomy", "signature_bag", "signature_depths", "code_features", "anonymized_text", "code_shapes", "align_signature"]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_is_parsed_once(spark, sf_dir):
    for query in (articles.parse_analysis, parsers.repaired_analysis, posts.parse_taxonomy):
        assert optimized(query(spark, sf_dir)).count("from_json(") == 1


@pytest.mark.parametrize("name", PER_PART)
def test_small_files_are_spread(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_signatures_are_read_once(spark, sf_dir):
    assert "aggregate(" not in optimized(parsers.signature_matrix(spark, sf_dir))


def test_spread_keeps_rows(spark):
    df = spark.range(100).coalesce(1)
    got = spread(df, "id")
    assert sorted(r.id for r in got.collect()) == list(range(100)) and max(got.rdd.glom().map(len).collect()) < 50


def test_blocks_after_the_first_usable_are_not_parsed(monkeypatch):
    import pandas as pd

    from kindred.functions import code

    seen, parsed = [], code.parsed
    monkeypatch.setattr(code, "parsed", lambda c: seen.append(c) or parsed(c))
    own = pd.Series([["x = (", "  def g(self): pass", "def f(): pass"], ["x = 1"], ["def f(): pass", "y"]])
    wrapped = pd.Series([["class A:\n    x = (", "class A:\n  def g(self): pass", "never"], ["class A:\n    x = 1"], ["never", "never"]])
    got = code.first_usable.func(own, wrapped)
    assert got.values.tolist() == [[1, True], [None, None], [0, False]]
    assert "never" not in seen and "y" not in seen and len(seen) == 7
