"""Rows without ids, or with one that many have: batches stay even and the order of texts holds across them."""

from __future__ import annotations

from collections import Counter

from kindred.llm import repeats, suffix_dedup, superkmer_dedup
from tests.llm.conftest import frame, prose
from tests.llm.test_operators import order, removed_bytes


def skewed() -> list[tuple]:
    shared = [prose(700 + i, 60) for i in range(4)]
    text = lambda i: f"{prose(i, 20)} {shared[i % 4]} {prose(1000 + i, 15)} {shared[i % 3]}"
    rows = [(None, text(i)) for i in range(60)] + [(77, text(60 + i)) for i in range(40)] + [(100 + i, text(100 + i)) for i in range(60)]
    return rows + [(None, text(3)), (77, text(61)), (77, None), (77, "")]


def test_bytes_of_hot_ids(spark):
    rows = skewed()
    got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(7), batch_bytes=5_000, hot_count=20)
    found = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got.collect()]
    assert sorted(found, key=str) == removed_bytes(rows, 100)


def test_words_of_hot_ids(spark):
    rows, first, expected = skewed(), {}, []
    for doc_id, text in sorted(rows, key=order):
        words = (text or "").split()
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), doc_id)
    for doc_id, text in rows:
        words = (text or "").split()
        gone = {j for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] != doc_id for j in range(i, i + 50)}
        expected.append((doc_id, len(words), " ".join(w for i, w in enumerate(words) if i not in gone)))
    got = superkmer_dedup.remove_windows(frame(spark, rows).repartition(7), batch_bytes=5_000, hot_count=20)
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_batches_are_even(spark):
    rows = [(None, prose(i, 30)) for i in range(700)] + [(5, prose(5000 + i, 30)) for i in range(700)] + [(1000 + i, prose(9000 + i, 30)) for i in range(700)]
    docs = frame(spark, rows)
    for finder in (suffix_dedup.ByteFinder(100), superkmer_dedup.WindowFinder(50)):
        dealt = repeats._carried(docs, finder, 10_000, 50_000)[0]
        sizes = Counter(r.batch for r in dealt.select("batch").collect())
        assert len(sizes) > 20 and max(sizes.values()) < 2 * len(rows) / len(sizes)


def test_order_of_texts(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, "z"), (3, ""), (3, "é"), (3, "z")]
    ties = repeats.text_order(spark.createDataFrame(rows, "doc_id long, text string"))
    own = spark.createDataFrame(rows, "doc_id long, text string").distinct().select("doc_id", "text", *repeats._hashes())
    got = own.join(ties, ["doc_id", "_h0", "_h1"]).orderBy("tie").select("doc_id", "text").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (1, "b"), (3, ""), (3, "z"), (3, "é")]
    assert repeats.text_order(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")) is None
