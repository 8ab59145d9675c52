"""Texts are split into lines once, and words are counted as the pattern counts them."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from kindred.llm import line_dedup
from tests.llm.conftest import frame


def test_ranks_read_written_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(line_dedup, "_ranked", lambda df, keys, f=line_dedup._ranked: seen.append(df) or f(df, keys))
    docs = frame(spark, [(1, "one two\nthree"), (2, "one two\nfour")])
    assert [(r.doc_id, r.seq, r.n_words) for r in line_dedup.first_ranks(line_dedup.numbered_lines(docs)).orderBy("doc_id").collect()] == [(1, 0, 2), (2, 0, 2)]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "split" not in plan and seen[0].inputFiles()


def test_words_of_odd_lines(spark):
    r = random.Random(6)
    lines = ["".join(r.choice("ab \t\v\f\ré　\x1c\x85\xa0") for _ in range(r.randint(1, 9))) for _ in range(2000)] + ["a b c", " a", "a ", "a  b", "a\tb c", "é ü"]
    lines = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    got = {(x.doc_id, x.seq): x.n_words for x in line_dedup.numbered_lines(frame(spark, list(enumerate(lines))).select("doc_id", F.concat("text", F.lit("\n \t\n"), "text").alias("text"))).collect()}
    assert got == {(i, s): len(re.findall(r"[^\x20\x09-\x0D]+", x)) for i, x in enumerate(lines) for s in (0, 1)}
