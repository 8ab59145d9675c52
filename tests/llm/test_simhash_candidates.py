"""The SimHash groups are candidates of near copies by themselves, and the exact sets decide about them."""

from __future__ import annotations

from kindred.llm.near_copies import near_copies, shingle_sets
from kindred.llm.simhash_dedup import simhashes
from tests.llm.conftest import prose


def test_groups_without_bands(spark):
    radius = 4
    texts = []
    for i in range(30):
        words = prose(i, 400).split()
        texts += [" ".join(words), " ".join(words[:-1]), " ".join(words[: 395 - 4 * i])]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    got = {r.key: r.root for r in near_copies(docs, bands=0, radius=radius).collect()}
    sets, prints = [set(s.tolist()) for s in shingle_sets([t.encode() for t in texts])], simhashes([t.encode() for t in texts], 5)
    root = list(range(len(texts)))
    near = far = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius:
                    near += 1
                    root = [root[j] if r == root[i] else r for r in root]
                else:
                    far += 1
    assert near >= 30 and len(got) == len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if root[i] == root[j]:
                assert got[i] == got[j]
            elif i // 3 != j // 3 or len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) and len({root[k] for k in range(i // 3 * 3, i // 3 * 3 + 3)}) == 3:
                assert got[i] != got[j]
    every = {r.key: r.root for r in near_copies(docs, radius=radius).collect()}  # with bands those that are further apart too
    assert far and all(every[i] == every[j] for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
