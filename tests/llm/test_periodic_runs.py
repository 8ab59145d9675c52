"""Runs of words by suffix automaton and link-cut access, against a plain search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from kindred.llm import periodic_runs
from kindred.llm.registry import QUERIES
from tests.llm.conftest import frame, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, powers, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, powers * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 4, 6)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(1500):
        n, k = r.randint(0, 45), r.choice([1, 2, 3, 5])
        w = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.5:
            a, p = r.randrange(n), r.randint(1, max(1, n // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert periodic_runs.runs_of(w) == plain_runs(w, 2, 2)
        assert periodic_runs.text_runs([str(x) for x in w]) == plain_runs(w, 4, 6)


def test_long_runs():
    cycle = list(range(700))
    assert periodic_runs.runs_of([-1, *cycle * 9, *cycle[:5], -2], 4, 6) == [(1, 6305, 700)]
    assert periodic_runs.runs_of([7] * 30_000, 4, 6) == [(0, 30_000, 1)]
    words = [f"w{i}" for i in range(1 << 21)] + ["a", "b"] * 4  # ids that need their pairs numbered first
    assert periodic_runs.text_runs(words) == [(1 << 21, 8, 2)]


def test_query(spark, rows, tmp_path):
    r = random.Random(9)
    more = [(i, prose(i, r.randint(1, 90), 40)) for i in range(100, 500)]
    more += [(i, " ".join(["head", *(prose(i, 3).split() * r.randint(3, 9)), "tail"] * 2)) for i in range(500, 560)]
    more += [(600, "a a a a a a"), (601, "a a a a a"), (602, "a b a b a b a b"), (603, "a b a b a b a"), (604, " ".join(["x y"] * 9 + ["x x x x x x"])), (605, "0 0 0 0 0 0 1 1 1 1 1 1"), (606, "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb")]
    every = [x for x in rows if x[0] not in (50, 51)] + more
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in every) > 20
    frame(spark, every).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(x) for x in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted((expected(*x) for x in every), key=str)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for d in docs:
        if len(d.text) < 3000:
            assert found[d.doc_id] == expected(d.doc_id, d.text)


def test_operator(spark, no_docs, docs):
    found = periodic_runs.periodic_runs(docs)
    assert [tuple(r) for r in found.where("doc_id = 45").collect()] == [(45, 0, 120, 1, "same")]
    assert found.where("doc_id = 50").isEmpty()  # 40,000 words in no order
    assert periodic_runs.periodic_runs(no_docs).count() == periodic_runs.run_digests(no_docs).count() == 0
    assert periodic_runs.run_digests(docs.drop("lang")).count() == docs.count()


@pytest.mark.parametrize("text", ["", None, " \n"])
def test_no_words(spark, text):
    row = periodic_runs.run_digests(spark.createDataFrame([(3, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_runs, row.start, row.exponent_milli) == (0, 0, None, None) and row.runs_sha256 == row.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
