"""The budget of mixing where weights lie far apart."""

from __future__ import annotations

import random

import pytest

from kindred.llm.source_mixing import budget_factor, mixed_sample

WORDS = [f"longword{i:03}" for i in range(200)]


def test_budget_with_a_monolingual_source(spark):
    """Source a has one language only, b all four: no weights meet the targets, and some go to 0."""
    cells = [("a", "en", 90), ("b", "en", 1), ("b", "xx", 3), ("b", "yy", 3), ("b", "zz", 3)]
    rows = [(i, " ".join(random.Random(i).choices(WORDS, k=10 + i % 7)), s, lang) for i, (s, lang) in enumerate((s, lang) for s, lang, n in cells for _ in range(8 * n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    for share in (0.5, 0.8):
        drawn = mixed_sample(docs, share=share).collect()
        tokens = sum(r.n_tokens for r in drawn)
        assert min(r.weight for r in drawn) < 1e-6
        assert sum(r.n_tokens * r.probability for r in drawn) == pytest.approx(share * tokens, rel=1e-6)
        assert sum(r.n_tokens for r in drawn if r.drawn) == pytest.approx(share * tokens, rel=0.15)


@pytest.mark.parametrize("spread", [0, 3, 30, 250])
def test_budget_factor(spark, spread):
    r = random.Random(spread)
    rows = [(float(r.randrange(1, 1000)), 10 ** -(spread * r.random())) for _ in range(60)] + [(0.0, 1e-299), (5.0, 0.0)]
    cells, total = spark.createDataFrame(rows, "tokens double, weight double"), sum(t for t, w in rows if w)
    for share in (0.01, 0.5, 0.99, 1.5):
        c = budget_factor(cells, share * total)
        assert sum(t * min(1.0, c * w) for t, w in rows) == pytest.approx(min(share, 1) * total, rel=1e-9)
