"""Posts, files, table maintenance, and queries that SQL cannot give."""

from __future__ import annotations

import ast
import html
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kindred.functions import code, posts
from kindred.functions import text as tx
from kindred.sources import tables
from kindred.sources.commits import Table
from kindred.streaming.visits import on_route, run_visit_table


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column).collect()]


def test_dedent_and_wrap(spark):
    cases = ["    def f():\n        return 1\n", "a\n  b", "\tx\n\t  y\n \n\tz", "", "  \n\n", " \tq\n  r", "x"]
    assert one(spark, posts.dedented(F.col("x")), *cases) == [textwrap.dedent(c) for c in cases]
    assert one(spark, posts.in_class(F.col("x")), cases[0]) == ["class Solution:\n" + textwrap.indent(textwrap.dedent(cases[0]), "    ")]


def test_code_blocks(spark):
    post = "```js\n1\n```\n`x`\n```Python3\n2\n\n```\n```\n3\n```\n```py\n4\n```\n```c\nnever closed"
    assert one(spark, posts.code_blocks(F.col("x")), post, "", None) == [["2\n\n", "4\n", "1\n", "3\n", "never closed"], [], None]


def test_literal_lists(spark):
    cases = ["['a', 'b']", "[]", '["it\'s", \'b\']', r"['a\'b']"]
    assert one(spark, posts.literal_list(F.col("x")), *cases) == [ast.literal_eval(c) for c in cases]
    assert one(spark, posts.literal_list(F.col("x")), "nan", "") == [[], []]


def test_votes_and_buckets(spark):
    df = spark.createDataFrame([([("X", 3), ("UPVOTE", 5), ("UPVOTE", 7)],), ([("X", 3)],), ([],), (None,)], "r array<struct<type:string,count:int>>")
    assert [r[0] for r in df.select(posts.votes(F.col("r"))).collect()] == [5, 0, 0, 0]
    assert [r[0] for r in spark.range(6).select(posts.bucketed(F.col("id"), 4)).collect()] == ["0", "1", "2", "3", "4+", "4+"]


def test_entities_and_usable_code(spark):
    cases = ["&amp;lt; &eacute; &#x41; &copy &am &notit; &hellip;", "plain", None]
    assert one(spark, tx.unescaped(F.col("x")), *cases) == [html.unescape(c) if c else c for c in cases]
    assert one(spark, code.is_usable("x"), "def f(): pass", "async def g(): pass", "x = 1", "def (", None) == [True, True, False, False, False]


def test_taxonomy_and_mapping(spark):
    good = '{"phases": [{"label": "a", "role": "b"}], "tags": [], "algorithm": "x"}'
    bad = ["", "{", '{"phases": []}', good.replace('"b"', '""'), good.replace('"x"', '" "')]
    got = one(spark, posts.parsed_taxonomy(F.col("x")), "say " + good, *bad)
    assert [r.error for r in got] == [None, "lists missing", "lists missing", "lists missing", "bad phases", "no algorithm"] and got[0].value.algorithm == "x"
    keys = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, posts.parsed_mapping(F.col("x"), keys), '{"a": "z", "c": "q"}', "no", None) == [{"a": "z", "b": "b"}, {"a": "a", "b": "b"}, {"a": "a", "b": "b"}]


def test_upsert_overwrite_and_cache(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long, s string")
    tables.upserted(rows((1, 1, "a"), (2, 5, "b")), path, "k", "v")
    tables.upserted(rows((1, 1, "tie"), (2, 4, "older"), (3, 1, None)), path, "k", "v")
    table = Table(spark, path, "k", "v")
    assert sorted(map(tuple, table.read().collect())) == [(1, 1, "tie"), (2, 5, "b"), (3, 1, None)]
    tables.overwritten(table.read().where("k > 1"), path)
    assert table.read().count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    lines, cache = f"file://{tmp_path}/lines", f"file://{tmp_path}/cache"
    read = lambda **o: tables.read_jsonl(spark, lines, "k long, s string", {"k": "id"}, cache, **o)
    tables.exported(rows((1, 1, "a")).drop("v"), lines)
    assert read().columns == ["id", "s"] and read().count() == 1
    tables.exported(rows((1, 1, "a"), (2, 2, "b")).drop("v"), lines)
    assert read().count() == 1 and read(refresh=True).count() == 2


def test_visit_table_goes_on_from_its_state(spark, tmp_path):
    from datetime import datetime

    at, put = datetime(2024, 1, 1), lambda *ips: spark.createDataFrame([(i, datetime(2024, 1, 1)) for i in ips], "ip string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: run_visit_table(spark.readStream.schema("ip string, ts timestamp").parquet(f"{tmp_path}/in"), "ip", "ts", "s", f"file://{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    put("a", "b", "a")
    run()
    put("b", "c", None)
    run()
    run()
    held = Table(spark, f"file://{tmp_path}/out", "visitor", "visit_count")
    got = held.read()
    assert len(held.head().deltas) == 2 and list(held.head().epochs) == [f"{tmp_path}/state"]
    assert sorted(r.visit_count for r in got.collect()) == [1, 2, 2] and {r.first_seen for r in got.collect()} == {at}


def test_routes(spark):
    df = spark.createDataFrame([("GET", "/", "1"), ("POST", "/", "1"), ("GET", "/x", "1"), ("GET", "/", None)], "m string, p string, ip string")
    assert on_route(df, "m", "p", "ip", "salt").count() == 1 and on_route(df, "m", "p", "ip", None).count() == 0


def test_matrix_rejects_unknown_metrics(spark, sf_dir):
    from kindred.operators import sets

    w = spark.createDataFrame([(1, 2, 1.0)], "id long, tag long, w double")
    with pytest.raises(ValueError):
        sets.matrix(w, w, w.select("id"), "cosine")


def test_kmeans_is_settled(spark, sf_dir):
    """Every vector is in the cluster whose mean is nearest, but for a few that the last round moved."""
    got = {r.vec_id: r.cluster for r in entry.queries()["kmeans_clusters"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.array([got[r.vec_id] for r in rows])
    means = np.stack([x[own == c].mean(axis=0) for c in range(10)])
    nearest = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert len(got) == len(rows) and (nearest == own).mean() > 0.95


def test_aligned_signature():
    from kindred.functions.code import aligned

    stub = "class Solution:\n    def f(self, nums, k):\n        "
    assert aligned("def f(k, n=1):\n    g = lambda: k + n\n    return g()", stub, "f") == "def f(nums, k=1):\n    g = lambda: nums + k\n    return g()"  # names trade places
    assert aligned("def f(a, b):\n    def f(a):\n        return a\n    return f(b)", stub, "f") == "def f(nums, k):\n\n    def f(a):\n        return nums\n    return f(k)"
    for same in ("def f(a):\n    return a", "def f(nums, k):\n    return  k", "def g(a, b):\n    return  a", "def f(a, b:\n", None, ""):
        assert aligned(same, stub, "f") == same
    assert aligned("def f(a, b): return a", None, "f") == aligned("def f(a, b): return a", "def (", "f") == "def f(a, b): return a"
