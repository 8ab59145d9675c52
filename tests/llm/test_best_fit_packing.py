"""Packing: ids, pieces and places against plain versions, the reduction against optimal packings."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kindred.llm import best_fit_packing as packing
from kindred.llm.byte_pieces import BytePieces
from kindred.llm.registry import QUERIES
from tests.llm.conftest import frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for b in {r: b for b, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[b] -= items[i]
            go(i + 1, rooms)
            rooms[b] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def sequences(counts, bins, capacity):
    held = Counter()
    for b in bins:
        assert b.count > 0 and sum(n * k for n, k in b.lengths) <= capacity
        for n, k in b.lengths:
            held[n] += k * b.count
    assert held == Counter({k: n for k, n in counts.items() if n})
    return sum(b.count for b in bins)


def test_reduction_keeps_an_optimal_packing():
    r = random.Random(4)
    for _ in range(600):
        capacity, n = r.choice([10, 20, 30, 50, 100]), r.randint(1, 10)
        items = [r.randint(max(1, capacity // r.choice([4, 5, 100])), capacity) for _ in range(n)]
        own, best = packing.Instance(Counter(items), capacity), optimum(items, capacity)
        own.reduce()
        fixed = sum(b.count for b in own.bins)
        assert fixed + optimum([x for x in range(capacity + 1) for _ in range(int(own.count[x]))], capacity) == best
        own.best_fit()
        assert sequences(Counter(items), own.bins, capacity) >= best >= packing.least_sequences(Counter(items), capacity)


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        room = min((r for r in rooms if r >= x), default=None)
        if room is None:
            room = capacity
        else:
            rooms.remove(room)
        rooms.append(room - x)
    return len(rooms)


def test_best_fit_in_groups_is_best_fit():
    r = random.Random(6)
    for _ in range(300):
        items = [r.randint(1, 100) for _ in range(r.randint(0, 60))] + [r.choice([3, 34, 51])] * r.randint(0, 30)
        assert sequences(Counter(items), packing.packed(Counter(items), 100, reduce=False), 100) == plain_best_fit(items, 100)


def test_large_counts():
    r = random.Random(8)
    counts = {n: r.randint(0, 10**12) for n in range(1, 2049)}
    bins = packing.packed(counts)
    assert sequences(counts, bins, 2048) <= 1.001 * packing.least_sequences(counts) and len(packing.Slots.of(bins).length) < 10_000


def test_ids_of_odd_texts():
    own, plain, r = BytePieces(PATH, 200), Tokenizer.from_file(PATH), random.Random(3)
    odd = [*"aZİıÅéßſऩक़אּ²½Ⅷ１٣¼'’.,;!?\"#-_/", "'s", "'LL", "̈", "word", "Word", " ", " ", " ", "\n", "\n", "\t", "　", "\x0b", "\x1c", "\x85", "\xa0", " ", "\r\n", "🙂", "漢字", "<|", "|>", "<|endoftext|>", "\x01", "\x00", "12"]
    for _ in range(40):
        texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 14))) for _ in range(200)] + [" ", "", "  ", "   ", "\n\n\n", "  a", "   a", "a  ", "a   "]
        ids, n = own.encode(pa.array(texts), 7)
        assert ids.tolist() == [i for t in texts for i in [*plain.encode(t, add_special_tokens=False).ids, 7]]
        assert n.tolist() == [len(e.ids) + 1 for e in plain.encode_batch(texts, add_special_tokens=False)]


def expected(docs, capacity=2048):
    encode, out = Tokenizer.from_file(PATH).encode, []
    for doc_id, text in docs:
        ids, at, piece = [*encode(text or "", add_special_tokens=False).ids, 0], 0, 0
        while at < len(ids):
            to = at + ((len(ids) - 1) % capacity + 1 if not at else capacity)
            out.append((doc_id, piece, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())))
            at, piece = to, piece + 1
    return out


def check(rows, docs):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(expected(docs), key=str)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = Counter(r.length for r in rows)
    assert packing.least_sequences(lengths) <= len(held) <= 1.02 * packing.least_sequences(lengths) + 1


def test_query(spark, rows, tmp_path):
    docs = [*rows, *((1000 + i, t) for i, t in enumerate(["", None, "one", "one", "a b " * 3000]))]
    frame(spark, docs).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    check(QUERIES["op12_best_fit_packing"](spark, str(tmp_path)).collect(), docs)


def test_given_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(QUERIES["op12_best_fit_packing"](spark, sf_dir).collect(), docs)


def test_no_documents(spark, no_docs):
    assert packing.packed_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("capacity", [16, 300])
def test_sequences(spark, docs, rows, capacity):
    plain, got = Counter(), Counter()
    for doc_id, text in rows:
        plain.update([(doc_id, *Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0)] if doc_id == 20 else [])
    found = packing.packed_sequences(docs, PATH, capacity).collect()
    every = Counter(i for r in found for i in r.ids)
    assert every == Counter(i for _, t in rows for i in [*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 0])
    for r in found:
        assert len(r.ids) <= capacity and r.offsets[0] == 0 and len(r.doc_ids) == len(r.offsets)
        got.update(x for x in r.doc_ids if x == 20)
    assert got[20] == sum(-(-(len(x) - 1) // capacity) for x in plain)
