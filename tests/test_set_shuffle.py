"""The set join by kinds hands on a bounded number of pairs for a query, and reads its rows without making them anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kindred.operators.set_join import nearest_sets
from tests.test_set_join import plain


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    return sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)))


def test_hot_tags_shuffle_little(spark):
    before = shuffled(spark)
    assert entry.queries()["hot_tag_join"](spark, "/root/testdata/sf0.01").count() == 7330
    assert shuffled(spark) - before < 60_000 * 120  # line items; 224 bytes each when pairs by hot tags were dealt and rows made four times


@pytest.mark.parametrize("metric, limit, most_kinds, seed", [("dice", 15, 4000, 1), ("jaccard", 2, 4000, 2), ("jaccard", 15, 0, 3)])
def test_weights_by_number_of_items(spark, metric, limit, most_kinds, seed):
    r = random.Random(seed)
    sets = {i: {f"h{r.randrange(70)}" for _ in range(r.randint(1, 9))} | {f"r{r.randrange(90)}" for _ in range(r.randint(0, 3))} for i in range(200)}
    sets |= {i: {f"r{i}"} for i in (300, 304)} | {308: {"r1", "r2"}}
    n = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    rows = [(i, t) for i, s in sets.items() for t in s]
    df = spark.createDataFrame(rows + rows[:50] + [(None, "h1"), (4, None)], "id long, tag string").repartition(3)
    got = nearest_sets("id % 4 = 0", df, 5, metric, limit, most_kinds, lambda df: (F.lit(1000) / df).cast("long"))
    queries = {i: s for i, s in sets.items() if i % 4 == 0}
    assert sorted(map(tuple, got.collect())) == plain(queries, sets, {t: 1000 // x for t, x in n.items()}, 5, metric)
