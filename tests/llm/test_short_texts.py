"""Texts that are shorter than a benchmark item."""

from __future__ import annotations

from kindred.llm import decontamination
from tests.llm.conftest import frame, prose


def test_texts_shorter_than_an_item(spark):
    item = prose(3000, 25).split()
    docs = [(1, " ".join(item[:-1])), (2, " ".join(item[2:])), (3, " ".join(item[:12])), (4, " ".join(item)), (5, " ".join(item[:-1] + ["a", "b"])), (6, "w")]
    items = [(9, " ".join(item)), (10, prose(3001, 25)), (11, prose(3002, 60))]
    found = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in decontamination.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # 21 shingles; 20 and 19 of them are left in the first two, and a window of 25 words shares 20 of 22.
    assert found == {(1, 9): (0, 24, 20 / 21), (2, 9): (0, 23, 19 / 21), (4, 9): (0, 25, 1.0), (5, 9): (0, 25, 20 / 22)}
