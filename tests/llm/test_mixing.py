"""Mixing against a plain fitting of its own, and its topics."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from kindred.llm.registry import QUERIES
from kindred.llm.source_mixing import fitted_topics, mixed_sample, raked, sampled_rows
from tests.llm.conftest import frame


def fitted(tokens, targets, rounds=500):
    """Weights by cell: every dimension's totals are set to their targets in turn, on dicts."""
    total, weight = sum(tokens.values()), dict.fromkeys(tokens, 1.0)
    for _ in range(rounds):
        for d, target in enumerate(targets):
            have = Counter()
            for cell, n in tokens.items():
                have[cell[d]] += n * weight[cell]
            for cell in tokens:
                weight[cell] *= target.get(cell[d], 0) * total / have[cell[d]] if have[cell[d]] else 0
    return weight


def test_op1_against_a_plain_fitting(spark, sf_dir):
    rows = QUERIES["op1_source_mixing"](spark, sf_dir).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.source, r.lang, r.topic] += r.n_tokens
    targets = []
    for d in range(3):
        share = Counter()
        for cell, n in tokens.items():
            share[cell[d]] += n
        flat = {v: n**0.5 for v, n in share.items() if n}
        targets.append({v: x / sum(flat.values()) for v, x in flat.items()})
    expected = fitted(tokens, targets)
    assert {(r.source, r.lang, r.topic): r.weight for r in rows if r.n_tokens} == pytest.approx({c: expected[c] for c, n in tokens.items() if n}, rel=2e-2, abs=1e-3)
    every = sum(tokens.values())
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(every / 2, rel=1e-6)
    assert len({r.topic for r in rows}) > 3


def test_topics_follow_the_words(spark):
    words = [[f"{'abcd'[t]}word{i}" for i in range(40)] for t in range(4)]
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(words[i % 4], k=30))) for i in range(200)] + [(900, None), (901, "  ")]
    got = {x.doc_id: x.topic for x in sampled_rows(frame(spark, rows).repartition(3), topics=4).select("doc.doc_id", "topic").collect()}
    own = [Counter(got[i] for i in range(t, 200, 4)).most_common(1)[0] for t in range(4)]
    assert len({name for name, _ in own}) == 4 and all(n >= 48 for _, n in own) and got[900] == got[901] == "none"


def test_topics_of_few_and_no_texts():
    assert fitted_topics(np.zeros((0, 8), np.float32), 3).shape == (8, 3)
    assert fitted_topics(np.eye(8, dtype=np.float32)[:2], 3).shape[0] == 8


def test_columns_named_like_results(spark):
    docs = frame(spark, [(i, f"some words of text {i}") for i in range(20)])
    got = mixed_sample(docs, tokens="batch")
    assert set(docs.columns) <= set(got.columns) and len(got.columns) == len(set(got.columns)) and {r.n_tokens for r in got.collect()} == {1}
    assert sampled_rows(docs).select("doc.*").exceptAll(docs).isEmpty()


def test_marginals_that_cannot_be_met_are_said_to_miss(spark, caplog):
    cells = spark.createDataFrame([("a", "x", "t", 10.0), ("b", "y", "t", 10.0)], "source string, lang string, topic string, tokens double")
    targets = [spark.createDataFrame(rows, f"{d} string, target double") for d, rows in (("source", [("a", 0.9), ("b", 0.1)]), ("lang", [("x", 0.1), ("y", 0.9)]), ("topic", [("t", 1.0)]))]
    for n in (100, 0):
        caplog.clear()
        raked(cells, targets, rounds=4, most_local=n).collect()
        assert "off by" in caplog.text
