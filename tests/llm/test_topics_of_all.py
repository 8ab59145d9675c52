"""Topics are fitted on all distinct texts, whatever their hashes, partitions and copies."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from kindred.llm.source_mixing import sampled_rows, spread_topics, text_counts


def test_texts_beyond_a_sample_of_low_hashes_count(spark):
    """Of 9000 texts those with an even hash have other words than those with an odd one; a sample of every second hash saw one kind only."""
    r = random.Random(4)
    made = [" ".join(r.choices([f"{'ab'[i % 2]}word{j}" for j in range(30)], k=12)) for i in range(18_000)]
    both = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").where(F.pmod(F.xxhash64("text"), F.lit(2)) == (F.col("doc_id") % 2))
    docs = both.withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    assert docs.count() > 8_000
    got = sampled_rows(docs, topics=2).groupBy((F.col("doc.doc_id") % 2).alias("kind"), "topic").count().collect()
    assert len(got) == 2 and len({x.topic for x in got}) == 2


def test_centres_against_plain_ones_and_in_other_partitions(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices([f"{'abc'[i % 3]}w{j}" for j in range(40)] + ["all", "of", "them"], k=5 + i % 60)) for i in range(400)] + ["", None, "word " * 300]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:50]]], "text string")
    one, other = spread_topics(docs.repartition(7), 3, 64), spread_topics(docs.coalesce(1), 3, 64)
    assert (one == other).all() and one.shape == (64, 3)
    rows = text_counts(docs, 64).collect()
    assert len(rows) == len(set(filter(None, texts)))
    counts = np.array([np.frombuffer(x.counts, np.uint8 if len(x.counts) == 64 else np.uint32) for x in rows], float)
    rarity = np.log((len(counts) + 1) / ((counts > 0).sum(axis=0) + 1)) + 1
    unit = counts * rarity
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    own = (counts @ one).argmax(axis=1)
    centres = np.stack([unit[own == t].sum(axis=0) for t in range(3)])  # each is the mean of its texts: nothing moves any more
    centres = (centres / np.linalg.norm(centres, axis=1, keepdims=True) * rarity).T
    assert np.abs(centres - one).max() < 1e-3
    assert spread_topics(docs.where("text IS NULL"), 3, 64).shape == (64, 3)
