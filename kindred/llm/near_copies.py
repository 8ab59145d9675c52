"""Near copies by shingle similarity: SimHash groups and MinHash bands are candidates, exact sets decide.

A text is the set of its five-word shingles (A-Z lowered, words between white space), as 64-bit
hashes. Texts of one SimHash group (fingerprints of these shingles, linked by the anchor-point covering
of ``linked_prints``) are candidates; its links go straight into the candidates' components. Two texts at 0.8 differ by some ten of 64 bits, beyond any radius
that anchors can cover, so texts further apart are found by MinHash besides. Each of ``bands`` bands is the hash of five minima; texts that share a band are
candidates. A pair at a similarity of s is a candidate by bands with a probability of
1 - (1 - s^5)^bands: at 0.8 and 40 bands, all but one in eight million. Candidates make components,
and a component's texts come together once, in a task that computes the Jaccard similarity of their
shingle sets; only links at ``least`` or more count. A text is not compared with those it is already
linked to, so a dense component takes one pass. A component of more than ``most`` shingles is dealt
out into pairs of chunks of that size. Links of all tasks then make the groups.

Texts with equal sets are one node, so exact copies cost one row. Defined cases: texts without words
(null ones too) are copies of each other; fewer words than a shingle make one shingle; repeated rows
are copies; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import joined_apart, slices, whole_text, written
from kindred.llm.components import components
from kindred.llm.decontamination import shingles, word_hashes
from kindred.llm.simhash_dedup import linked_prints

ROWS = 5


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    hashes, sizes = word_hashes(texts)
    every = shingles(hashes, words) if len(hashes) >= words else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(every[at : at + n - words + 1]))
        else:
            out.append(shingles(hashes[at : at + n], n) if n else np.zeros(1, np.uint64))
        at += n
    return out


def band_hashes(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """A row of band hashes for every set."""
    r = np.random.default_rng(5)
    factors, terms = r.integers(0, 1 << 63, (2, bands, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        low = [np.minimum.reduceat(flat * f + t, starts) for f, t in zip(factors[b], terms[b])]
        out[:, b] = shingles(np.stack([np.full(len(sets), b, np.uint64), *low]), ROWS + 1)[0]
    return out


def similar(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with a Jaccard similarity of ``least`` or more."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order])
    starts = np.concatenate(([0], np.cumsum(size)))
    codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    flag = np.zeros(starts[-1], bool)
    label, out = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        to = int(np.searchsorted(size, size[i] / least + 1e-9, side="right"))
        if to <= i + 1 or (label[i + 1 : to] == label[i]).all():
            continue
        own = codes[starts[i] : starts[i + 1]]
        flag[own] = True
        both = np.add.reduceat(flag[codes[starts[i + 1] : starts[to]]], starts[i + 1 : to] - starts[i + 1], dtype=np.int64)
        flag[own] = False
        for j in (i + 1 + np.flatnonzero(both >= least * (size[i] + size[i + 1 : to] - both) - 1e-9)).tolist():
            if label[j] != label[i]:
                out.append((order[i], order[j]))
                label[label == label[j]] = label[i]
    return out


def stars(nodes: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs (of places in nodes) as stars: every linked node with the smallest that it reaches."""
    root = {i: i for pair in pairs for i in pair}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in pairs:
        low, high = sorted((top(i), top(j)), key=nodes.__getitem__)
        root[high] = low
    return [(nodes[i], nodes[top(i)]) for i in root if top(i) != i]


def sketches(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """key, node (the hash of the shingle set), n (its shingles) and bands of every row of docs (key: long, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), words)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                flat = pa.array(band_hashes(sets, bands).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), lists], ["key", "node", "n", "bands"])

    return docs.select("key", whole_text().alias("text")).mapInArrow(run, "key long, node long, n long, bands array<long>")


def verified(members: DataFrame, words: int, least: float, most: int) -> DataFrame:
    """a, b: stars of what links of at least ``least`` join, between the members (root, node, n, text) of a root that a task compares."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, links = None, [], [], []

        def close() -> None:
            if len(nodes) > 1:
                links.extend(stars(nodes, similar(sets, least)))
            nodes.clear()
            sets.clear()

        def batch_of_links() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)
            links.clear()
            return got

        for batch in batches:
            for part in slices(batch, 3, 1_000_000):
                own = shingle_sets(part.column(3).cast(pa.binary()).to_pylist(), words)
                for *key, node, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), own):
                    if key != now:
                        close()
                        now = key
                    nodes.append(node)
                    sets.append(s)
                if len(links) > 10_000:
                    yield batch_of_links()
        close()
        yield batch_of_links()

    chunks = F.col("chunks")
    hot = members.groupBy("root").agg(F.ceil(F.sum("n") / most).alias("chunks")).where("chunks > 1")
    own = F.pmod(F.xxhash64("node"), chunks)
    pairs = F.when(chunks.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.least(own, j) * chunks + F.greatest(own, j)))
    dealt = joined_apart(members, hot, "root", "left").select("root", F.explode(pairs).alias("pair"), "node", "text")
    return dealt.repartition("root", "pair").sortWithinPartitions("root", "pair").mapInArrow(compare, "a long, b long").distinct()


def simhash_links(docs: DataFrame, rows: DataFrame, words: int, radius: int) -> DataFrame:
    """a, b: links that join the nodes of every SimHash group; rows has the node of each key of docs."""
    prints, _, linked = linked_prints(docs.select(F.col("key").alias("doc_id"), "text"), words, radius)
    own = prints.select(F.col("doc_id").alias("key"), "fingerprint").distinct()
    nodes = written(rows.select("key", "node").distinct().join(own, "key").select("fingerprint", "node").distinct(), "print_nodes")
    first = written(nodes.groupBy("fingerprint").agg(F.min("node").alias("a")), "print_heads")
    same = joined_apart(nodes, first, "fingerprint").where("node <> a").select("a", F.col("node").alias("b"))
    head = lambda end, name: first.select(F.col("fingerprint").alias(end), F.col("a").alias(name))
    near = linked.join(head("a", "_a"), "a").join(head("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.unionByName(near)


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, bands: int = 40, most: int = 1_000_000, radius: int = 4) -> DataFrame:
    """key and root (one value for each group) of every key of docs (key: long, text); rows with the same key have the same text."""
    rows = written(sketches(docs, words, bands), "sketches")
    distinct = written(rows.dropDuplicates(["node"]), "nodes")
    placed = distinct.select("node", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("_last")).where("a < _last").drop("_last")
    banded = joined_apart(placed, shared, "band").where("node <> a").select("a", F.col("node").alias("b"))
    candidates = components(banded.unionByName(simhash_links(docs, rows, words, radius)).distinct())
    chosen = candidates.join(distinct.select("key", "node", "n"), "node")
    texts = docs.select("key", whole_text().alias("text")).join(chosen, "key").dropDuplicates(["node"])
    roots = components(verified(written(texts.select("root", "node", "n", "text"), "members"), words, least, most))
    return rows.select("key", "node").distinct().join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
