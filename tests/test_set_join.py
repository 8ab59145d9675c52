"""Set join by keys of tags against all pairs, with tags that most sets hold."""

from __future__ import annotations

import random

import pytest

from kindred.operators import set_join
from kindred.operators.set_join import nearest_sets


def plain(queries, items, weight, k, metric):
    out = []
    for q, a in queries.items():
        rows = []
        for c, b in items.items():
            both = sum(weight[t] for t in a & b)
            if c != q and a & b:
                total = sum(weight[t] for t in a) + sum(weight[t] for t in b)
                rows.append((q, c, both / (total - both) if metric == "jaccard" else 2 * both / total))
        rows.sort(key=lambda r: (-r[2], r[1]))
        out += [(*r, i + 1) for i, r in enumerate(rows[:k])]
    return sorted(out)


def frame(spark, sets, weight):
    rows = [(i, t, weight[t]) for i, tags in sets.items() for t in tags]
    return spark.createDataFrame(rows, "id long, tag string, w long").repartition(3)


@pytest.mark.parametrize("metric, k, limit, seed", [("dice", 3, 5, 1), ("jaccard", 1, 2, 2), ("dice", 10, 20, 3), ("jaccard", 4, 1, 4)])
def test_against_all_pairs(spark, metric, k, limit, seed):
    r = random.Random(seed)
    tags = [f"t{i}" for i in range(25)]
    weight = {t: r.choice([1, 2, 3, 10**9 + i]) for i, t in enumerate(tags)}
    sets = {i: {tags[min(int(r.expovariate(0.25)), 24)] for _ in range(r.randint(1, 6))} for i in range(120)}
    sets |= {i: {"t0", "t1"} for i in range(120, 150)} | {i: {"t0"} for i in range(150, 180)}
    queries = {i: s for i, s in sets.items() if i % 4 == 0}
    got = nearest_sets(frame(spark, queries, weight), frame(spark, sets, weight), k, metric, limit)
    assert sorted(map(tuple, got.collect())) == plain(queries, sets, weight, k, metric)


def test_hot_tag_never_makes_its_pairs(spark, monkeypatch):
    """Two thousand sets share a tag and most share three: pairs that meet stay far below the square."""
    weight = {"hot": 1, "warm": 2, "mild": 2} | {f"r{i}": 5 for i in range(700)}
    sets = {i: {"hot", f"r{i % 700}"} | ({"warm"} if i % 3 else set()) | ({"mild"} if i % 5 else set()) for i in range(2000)}
    met, real = [], set_join._met

    def counted(*args):
        out = real(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(set_join, "_met", counted)
    items = frame(spark, sets, weight)
    got = nearest_sets(items, items, 5, "dice", 50)
    assert sum(met) < 2000 * 2 * (7 * 6 + 3) and sum(met) < 2000 * 2000 / 20
    some = {i: sets[i] for i in range(0, 2000, 97)}
    assert sorted(tuple(r) for r in got.collect() if r.q in some) == plain(some, sets, weight, 5, "dice")


def test_defined_cases(spark):
    schema = "id long, tag string, w long, t int, key string"
    rows = [(1, "a", 2, 0, "x"), (1, "a", 2, 0, "x"), (2, "a", 2, 1, None), (3, "b", 1, 1, None), (None, "a", 2, 1, None), (4, None, 1, 1, None)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, nearest_sets(df, df, 2).collect())) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    assert nearest_sets(df.limit(0), df, 2).count() == 0 and nearest_sets(df, df.limit(0), 2).count() == 0
    with pytest.raises(ValueError, match="metric"):
        nearest_sets(df, df, 2, "cosine")
    with pytest.raises(ValueError, match="1 or more"):
        nearest_sets(df, df, 0)
