"""Longest and maximal runs of lines against a plain search."""

from __future__ import annotations

import random

import pytest

from kindred.llm import line_dedup
from tests.llm.conftest import frame


def plain_runs(texts):
    """(doc, line) -> lines of the longest run from there that also starts earlier; texts in order, lines without a word left out."""
    lines = [[x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")] for t in texts]
    places = [(d, i) for d, own in enumerate(lines) for i in range(len(own))]
    out = {}
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            k = 0
            while i + k < len(lines[d]) and j + k < len(lines[e]) and lines[d][i + k] == lines[e][j + k]:
                k += 1
            out[d, i] = max(out.get((d, i), 0), k)
    return lines, {p: n for p, n in out.items() if n}


def made(seed):
    r = random.Random(seed)
    base = [[r.choice(["a", "b b", "c", "d d d", "a a"]) for _ in range(r.choice([1, 3, 9, 20]))] for _ in range(6)]
    texts = []
    for _ in range(14):
        parts = [x for _ in range(r.randint(1, 3)) for x in (lambda b, i: b[i : i + r.randint(1, 20)])(r.choice(base), r.randint(0, 4))]
        texts.append("\n".join(x for p in parts for x in ([p, " "] if r.random() < 0.1 else [p])))
    return [*texts, "a\n" * 21, "", " \n\t", texts[0] + "\nz"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_longest_and_maximal_runs(spark, seed):
    texts = list(dict.fromkeys(made(seed)))
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]).repartition(3)  # a repeated row is one document
    lines, longest = plain_runs(texts)
    found = line_dedup.longest_runs(line_dedup.numbered_lines(docs)).collect()
    assert {(r.doc_id, r.seq): r.n_lines for r in found} == longest and len(found) == len(longest)
    assert all(r.n_words == sum(len(x.split()) for x in lines[r.doc_id][r.seq : r.seq + r.n_lines]) for r in found)
    assert max(longest.values()) >= 9
    words = lambda p: sum(len(x.split()) for x in lines[p[0]][p[1] : p[1] + longest[p]])
    maximal = {(*p, n) for p, n in longest.items() if longest.get((p[0], p[1] - 1)) != n + 1 and n >= 2 and words(p) >= 5}
    assert {(r.doc_id, r.seq, r.n_lines) for r in line_dedup.maximal_runs(docs, 2, 5).collect()} == maximal and maximal
    gone = {(d, i + k) for (d, i), n in longest.items() if words((d, i)) >= 5 for k in range(n)}
    removed = {(r.doc_id, r.n_removed) for r in line_dedup.remove_repeated_lines(docs, least_words=5).collect()}
    assert removed == {(d, sum(e == d for e, _ in gone)) for d in range(len(texts))}


def test_short_lines_go_with_their_run_only(spark):
    rows = [(1, "x\nyes\nsix words stand in this line\nno\ny"), (2, "p\nyes\nq"), (3, "r\nyes\nsix words stand in this line\nno\ns"), (4, "yes\nno"), (5, None)]
    kept = {r.doc_id: (r.kept, r.depth) for r in line_dedup.remove_repeated_lines(frame(spark, rows), least_words=5).collect()}
    assert kept == {1: (rows[0][1], 0), 2: ("p\nyes\nq", 0), 3: ("r\ns", 3), 4: ("yes\nno", 0), 5: ("", 0)}


def test_least_is_a_line(spark):
    with pytest.raises(ValueError, match="one line"):
        line_dedup.maximal_runs(frame(spark, [(1, "a")]), 0)
