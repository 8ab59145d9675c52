"""Near copies against all pairs of shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from kindred.llm.near_copies import near_copies, similar
from tests.llm.conftest import frame, prose


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(texts, least=0.8):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}


def copies(n=6):
    """Texts and copies with a few words changed, at similarities on both sides of 0.8."""
    out = []
    for i in range(n):
        w = prose(1000 + i, 150 + 10 * i).split()
        out.append(" ".join(w))
        for changed in (1, 2, 3, 4, 5, 8, 12):
            r, v = random.Random(31 * i + changed), list(w)
            for at in r.sample(range(len(v)), changed):
                v[at] = f"new{at}"
            out.append(" ".join(v))
    return out


@pytest.mark.parametrize("most", [1_000_000, 400])
def test_near_copies(spark, rows, most):
    texts = [t for _, t in rows] + copies()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string").repartition(3)
    found = {}
    for r in near_copies(df, most=most).collect():
        found.setdefault(r.root, set()).add(r.key)
    expected = groups(texts)
    assert {frozenset(g) for g in found.values()} == expected and max(map(len, expected)) < 20


def test_similar_against_all_pairs():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(120)]
    for least in (0.4, 0.5, 0.8):
        label = list(range(len(sets)))
        for i, j in similar(sets, least):
            assert len(np.intersect1d(sets[i], sets[j])) >= least * len(np.union1d(sets[i], sets[j])) - 1e-9
            label = [label[i] if x == label[j] else x for x in label]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                assert label[i] == label[j] or len(np.intersect1d(a, b)) < least * len(np.union1d(a, b))


def test_stage_drops_near_copies(spark):
    texts = copies()
    kept = corpus_pipeline.near_dedup(spark, frame(spark, list(enumerate(texts))), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(map(min, groups(texts)))
