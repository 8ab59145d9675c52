"""Search by cells and blocks gives what comparing all gives."""

from __future__ import annotations

import numpy as np
import pytest

from kindred.operators.search import nearest, top_neighbours
from kindred.operators.vectors import ranked


def plain(vectors, asked, k):
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in vectors.items() if v is not None}
    out = []
    for q in asked:
        if q in unit:
            best = sorted((-round(float(unit[q] @ unit[c]), 9), c) for c in unit if c != q)[:k]
            out += [(q, c, -s + 0.0, n) for n, (s, c) in enumerate(best, 1)]
    return sorted(out)


def data(kind):
    r = np.random.default_rng(5)
    if kind == "clusters":
        centres = r.normal(size=(12, 16))
        v = {i: (centres[i % 12] + 0.1 * r.normal(size=16)).tolist() for i in range(600)}
    elif kind == "uniform":
        v = {i: r.normal(size=8).tolist() for i in range(400)}
    else:  # one hot cell of equal rows, ties and vectors of zeros
        v = {i: [1.0, 2.0, 0.0] if i % 3 else r.integers(-1, 2, 3).astype(float).tolist() for i in range(300)}
    v[1000], v[1001] = None, [0.0] * len(v[0])
    return v


@pytest.mark.parametrize("kind", ["clusters", "uniform", "ties"])
def test_same_as_comparing_all(spark, kind):
    v = data(kind)
    rows = spark.createDataFrame([(i, x, "z") for i, x in v.items()], "id long, v array<double>, extra string").repartition(4)
    asked = rows.where("id % 5 = 0")
    for k, options in ((4, {"pivots": 9, "block": 50}), (7, {"pivots": 1, "block": 37}), (500, {"pivots": 30, "block": 64}) if kind == "uniform" else (1, {})):
        expected = plain(v, [i for i in v if i % 5 == 0], k)
        got = ranked(nearest(asked, rows, k, **options), "cosine", k)
        assert sorted((r.q, r.c, r.cosine + 0.0, r["rank"]) for r in got.collect()) == expected
    by_size = [sorted(map(tuple, top_neighbours(asked, rows, 3, n).select("q", "c", "cosine", "rank").collect())) for n in (10**9, 0)]
    assert by_size[0] == by_size[1]


def test_cells_are_ruled_out(spark):
    v = data("clusters")
    rows = spark.createDataFrame([(i, x) for i, x in v.items() if x is not None], "id long, v array<double>")
    near = nearest(rows.where("id % 5 = 0"), rows, 3, pivots=24, block=1000)
    assert near.count() < 120 * 3 * 6  # of 24 cells few are asked, and each gives three


def test_groups_of_equal_rows_make_few_pairs(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(900)], "id long, v array<double>")
    near = nearest(rows.where("id % 5 = 0"), rows, 2, pivots=4, block=300)
    assert near.count() < 180 * 2 * 2 * 12
    assert {r.c for r in ranked(near, "cosine", 2).where("q = 5").collect()} == {1, 2}


def test_none(spark):
    rows = spark.createDataFrame([], "id long, v array<float>")
    assert nearest(rows, rows, 3).count() == 0
