"""The set join by kinds of frequent tags against all pairs; hot tags make no more levels of keys."""

from __future__ import annotations

import random

import pytest

from kindred.operators import set_join
from kindred.operators.set_join import nearest_sets
from tests.test_set_join import frame, plain


@pytest.mark.parametrize("metric, k, seed", [("dice", 3, 1), ("jaccard", 1, 2), ("jaccard", 10, 3)])
def test_kinds_against_all_pairs(spark, metric, k, seed, monkeypatch):
    monkeypatch.setattr(set_join, "_extended", lambda rows: pytest.fail("a level of keys"))
    r = random.Random(seed)
    weight = {f"r{i}": 50 + i % 3 for i in range(60)} | {f"h{i}": r.choice([1, 2, 2, 60]) for i in range(6)}
    sets = {i: {f"h{r.randrange(6)}" for _ in range(r.randint(1, 5))} | {f"r{r.randrange(60)}" for _ in range(r.randint(0, 2))} for i in range(200)}
    sets |= {i: {"h0", "h1"} for i in range(200, 230)} | {230: {"r0"}}
    queries = {i: s for i, s in sets.items() if i % 4 == 0} | {1000: {"h0", "h1", "h2", "h3", "h4", "h5", "r1"}, 1001: {"h3"}}
    got = nearest_sets(frame(spark, queries, weight), frame(spark, sets, weight), k, metric, 25)
    assert sorted(map(tuple, got.collect())) == plain(queries, sets, weight, k, metric)


def test_levels_give_the_same(spark):
    """Where kinds are too many the search goes by levels of keys."""
    r = random.Random(4)
    weight = {f"t{i}": 1 + i % 3 for i in range(12)}
    sets = {i: {f"t{min(int(r.expovariate(0.4)), 11)}" for _ in range(r.randint(1, 5))} for i in range(80)}
    df = frame(spark, sets, weight)
    assert sorted(map(tuple, nearest_sets(df, df, 3, "dice", 5, most_kinds=0).collect())) == plain(sets, sets, weight, 3, "dice")
