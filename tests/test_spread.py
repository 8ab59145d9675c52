"""Steps that deal a hot group to many tasks, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.operators.corpus import chunked
from kindred.operators.evaluation import quantiles
from kindred.operators.vectors import cosine_scores, ranked, ranks_of, score_counts, score_quantiles


def test_chunks_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else None if i % 2 else "cold", (i * 37) % 1000, "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "source string, id long, _by string")
    got = {(r.source, r.id): r.chunk for r in chunked(df.repartition(7), 10, "source", "id").collect()}
    for source in ("hot", "cold", None):
        ids = sorted(r[1] for r in rows if r[0] == source)
        assert [got[source, i] for i in ids] == [n // 10 for n in range(len(ids))]
    assert len(got) == 1000 and chunked(df.limit(0), 10, "source", "id").collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"a": np.round(rng.uniform(-1, 1, 501), 9), "b": np.repeat([0.25, -0.5], 40), "c": np.array([0.125]), None: np.round(rng.normal(0, 0.01, 64), 3)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("d", None)]
    at = {"low1": 0.0, "p10": 0.1, "median": 0.5, "p75": 0.75, "top": 1.0}
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, s double"), "g", "s", at).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs) and np.isclose([got[g].mean, got[g].low, got[g].high], [xs.mean(), xs.min(), xs.max()], atol=1e-12).all()
        assert np.allclose([got[g][n] for n in at], np.quantile(xs, list(at.values())), atol=1e-12)


@pytest.mark.parametrize("block_bytes", [64_000_000, 200])
def test_ranks_without_pairs(spark, block_bytes):
    rng = np.random.default_rng(3)
    vs = rng.integers(-2, 3, (60, 4)).astype(float)  # small whole numbers: many ties
    vs[7] = 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vs)] + [(99, None)], "id long, v array<float>")
    every = ranked(cosine_scores(v.where("id % 5 = 0"), v), "cosine")
    marks = every.where("c = (q * 7 + 3) % 60").select("q", "c", F.col("cosine").alias("score"))
    expected = {(r.q, r.c): r["rank"] for r in every.join(marks.select("q", "c"), ["q", "c"], "left_semi").collect()}
    got = {(r.q, r.c): r["rank"] for r in ranks_of(marks, v, block_bytes).collect()}
    assert got == expected and len(got) > 5
    assert ranks_of(marks.limit(0), v).collect() == []


@pytest.mark.parametrize("block_bytes", [64_000_000, 200])
def test_scores_counted_without_pairs(spark, block_bytes):
    rng = np.random.default_rng(4)
    vs = rng.integers(-2, 3, (60, 4)).astype(float)
    label = [None if i % 11 == 0 else i % 4 for i in range(60)]
    v = spark.createDataFrame([(i, x.tolist(), k) for i, (x, k) in enumerate(zip(vs, label))] + [(99, None, 1)], "id long, v array<float>, label long")
    asked = v.where("id % 5 = 0")
    pairs = [(label[r.q], 2 if label[r.q] is None or label[r.c] is None else int(label[r.q] == label[r.c]), round(r.cosine, 9)) for r in cosine_scores(asked, v).collect()]
    counts = score_counts(asked, v, 10**8, block_bytes=block_bytes).collect()
    assert {(r.label, r.same) for r in counts} == {p[:2] for p in pairs} and sum(r.n for r in counts) == len(pairs)
    assert {(r.label, r.same, r.bin): r.n for r in counts} == {k: sum(1 for p in pairs if (*p[:2], round(p[2] * 1e9) // 10**8) == k) for k in {(*p[:2], round(p[2] * 1e9) // 10**8) for p in pairs}}
    assert abs(sum(r.total for r in counts) - sum(round(p[2] * 1e9) for p in pairs)) == 0
    at = {"low": 0.0, "p10": 0.1, "median": 0.5, "high": 1.0}
    for by, of in (("label", 0), ("same", 1)):
        got = {r[by]: r for r in score_quantiles(asked, v, by, at, block_bytes=block_bytes).collect()}
        assert set(got) == {p[of] for p in pairs}
        for g, r in got.items():
            xs = [p[2] for p in pairs if p[of] == g]
            assert r.n == len(xs) and np.isclose(r["mean"], np.mean(xs), atol=1e-12)
            assert np.allclose([r[n] for n in at], np.quantile(xs, list(at.values())), atol=1e-12)
    assert score_counts(asked.limit(0), v, 10**8).collect() == []


def test_scrubbed_texts_without_a_word(spark):
    df = spark.createDataFrame([("no such word",), (None,), ("",), ("STONE stones Stone, écat cats",)], "x string")
    got = [r.y for r in df.select(tx.scrubbed("x", {"stone": "element", "cat": "dog"}).alias("y")).collect()]
    assert got == ["no such word", None, "", "Element elements Element, écat dogs"]
