"""The stratified sample against a plain greedy one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from kindred.operators.sampling import stratified


def greedy(rows, quota, salt=""):
    rows = {(i, t) for i, t in rows if i is not None and t is not None}
    sizes, picked = Counter(t for _, t in rows), {}
    for tag in sorted(sizes, key=lambda t: (sizes[t], t)):
        left = sorted((i for i, t in rows if t == tag and i not in picked), key=lambda i: (hashlib.md5(f"{i}{salt}".encode()).hexdigest(), i))
        picked.update((i, tag) for i in left[:quota])
    return sorted(picked.items())


@pytest.mark.parametrize("quota, salt", [(1, ""), (3, "x"), (40, "")])
def test_against_greedy(spark, quota, salt):
    r = random.Random(quota)
    rows = [(i, f"t{min(int(r.expovariate(0.4)), 12)}") for i in range(150) for _ in range(r.randint(1, 5))]
    rows += [(i, "hot") for i in range(150)] + [(i, "same size") for i in range(7)] + [(i, "size same") for i in range(7)] + [(None, "t1"), (3, None)]
    got = stratified(spark.createDataFrame(rows, "id long, tag string").repartition(3), quota, salt)
    assert sorted(map(tuple, got.collect())) == greedy(rows, quota, salt)


def test_chain_of_tags(spark):
    rows = [(i, t) for i in range(12) for t in range(i, 12)]  # who is turned away by one tag asks the next, twelve times
    assert sorted(map(tuple, stratified(spark.createDataFrame(rows, "id long, tag int"), 1).collect())) == greedy(rows, 1)


def test_none(spark):
    assert stratified(spark.createDataFrame([], "id long, tag string"), 2).count() == 0
