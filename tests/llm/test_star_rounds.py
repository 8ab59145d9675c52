"""Edges that are stars need no round, and near copies no components of their own for SimHash groups."""

from __future__ import annotations

import random

from kindred.llm import components as stars_of
from kindred.llm import near_copies
from tests.llm.conftest import prose


def rounds(monkeypatch, spark, edges):
    names = []
    with monkeypatch.context() as m:
        m.setattr(stars_of, "written", lambda df, name, f=stars_of.written: names.append(name) or f(df, name))
        found = {r.node: r.root for r in stars_of.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    return found, len(names)


def test_stars_need_no_round(spark, monkeypatch):
    star = [(1, 5), (6, 1), (1, 7), (7, 1), (2, 9)]
    assert rounds(monkeypatch, spark, star) == ({1: 1, 5: 1, 6: 1, 7: 1, 2: 2, 9: 2}, 1)
    for edges in ([(5, 1), (5, 2)], [(3, 2), (2, 1)]):  # a leaf of two, a leaf with a leaf
        found, n = rounds(monkeypatch, spark, edges)
        assert set(found.values()) == {1} and len(found) == 3 and n > 1
    assert rounds(monkeypatch, spark, []) == ({}, 1)


def test_stars_of_pairs():
    r = random.Random(4)
    nodes = r.sample(range(-1000, 1000), 60)
    pairs = [tuple(r.sample(range(60), 2)) for _ in range(35)]
    label = list(range(60))
    for i, j in pairs:
        label = [label[i] if x == label[j] else x for x in label]
    least = {i: min(nodes[j] for j in range(60) if label[j] == label[i]) for i in range(60)}
    assert sorted(near_copies.stars(nodes, pairs)) == sorted((nodes[i], least[i]) for i in range(60) if least[i] != nodes[i])


def test_groups_are_joined_once(spark, monkeypatch):
    calls = []
    for at in ("kindred.llm.near_copies.components", "kindred.llm.simhash_dedup.components"):
        monkeypatch.setattr(at, lambda edges, at=at: calls.append(at) or stars_of.components(edges))
    texts = [prose(i // 2, 120) + " end" * (i % 2) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    found = {r.key: r.root for r in near_copies.near_copies(docs).collect()}
    assert all((found[i] == found[j]) == (i // 2 == j // 2) for i in range(8) for j in range(8))
    assert calls == ["kindred.llm.near_copies.components"] * 2
