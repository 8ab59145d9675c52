"""Benchmark decontamination with item-sized SimHash windows.

Texts and items are sequences of words (A-Z lowered, between white space), seen as multisets of
five-word shingles. A window has as many words as the item it is compared with; a text with fewer
words is one window, and compared with all items of such a size that it can be similar to. For a weighted
Jaccard similarity of ``least`` a window of m shingles must have 2 * least / (1 + least) * m of them
in the benchmark, so only such windows get a fingerprint; this loses none. Window and item
fingerprints of 64 bits are compared through a multi-index: eight blocks of eight bits, and for
each item every value within two bits in a block. Fingerprints within 23 bits agree within two
bits in some block, so all of them are found. The weighted similarity of shingles then decides.

The documents are read once for each ``known_bytes`` of benchmark text, to find those with enough of
its shingles. Only these are compared with the items, which are spread to all tasks in parts of about
``part_bytes`` of text, since an item has some 300 entries in the index. Defined cases: null texts have no words and match nothing; items without
words and with a null item_id are left out; an item of fewer words than a shingle is one shingle;
repeated rows give one result; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import slices, text_bytes, whole_text, written
from kindred.llm.repeats import mixed
from kindred.llm.superkmer_dedup import _word_edges, span_hashes

WORDS = 5
RADIUS = 23
_NEAR = [0, *(1 << a for a in range(8)), *(1 << a | 1 << b for a, b in combinations(range(8), 2))]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())])
_DDL = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many words each text has."""
    split = [t.lower().split() for t in texts]
    flat = b" ".join(b" ".join(w) for w in split if w)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    if not flat:
        return np.zeros(0, np.uint64), sizes
    return span_hashes(np.frombuffer(flat, np.uint8), *_word_edges(flat)), sizes


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
    return mixed(out)


def _signs(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def window_prints(hashes: np.ndarray, m: int) -> np.ndarray:
    """The fingerprint of every window of m shingles."""
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_signs(hashes), axis=0, dtype=np.int32)))
    return np.packbits(total[m:] - total[:-m] > 0, axis=1, bitorder="little").view("<u8").ravel()


class Known:
    """The shingles of a part of the benchmark, by words of a shingle, and the smallest item of each."""

    def __init__(self, seen: dict[int, list[np.ndarray]]):
        self.known = {k: np.unique(np.concatenate(v)) for k, v in seen.items()}
        self.smallest = {k: min(map(len, v)) for k, v in seen.items()}
        self.filters = {}
        for k, v in self.known.items():
            bits = max(16, int(len(v) * 16).bit_length())
            self.filters[k] = np.zeros(1 << bits, bool), np.uint64(64 - bits)
            self.filters[k][0][v >> self.filters[k][1]] = True

    def hits(self, own: np.ndarray, k: int) -> np.ndarray:
        table, shift = self.filters[k]
        maybe = np.flatnonzero(table[own >> shift])
        known = self.known[k]
        at = np.minimum(np.searchsorted(known, own[maybe]), len(known) - 1)
        return maybe[known[at] == own[maybe]]

    def texts(self, texts: list[bytes], least: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(place, k, shingles) of the texts that have enough known shingles for a similarity of ``least`` with some item."""
        words, sizes = word_hashes(texts)
        ends, share = np.cumsum(sizes), 2 * least / (1 + least)
        for k in self.known:
            if len(words) < k:
                continue
            every = shingles(words, k)
            hit = self.hits(every, k)
            place = np.searchsorted(ends, hit, side="right")
            place = place[hit <= ends[place] - k]  # not over the end of a text
            doc, n = np.unique(place, return_counts=True)
            for d in doc[n >= share * np.minimum(self.smallest[k], sizes[doc] - k + 1) - 1e-9].tolist():
                yield d, k, every[int(ends[d] - sizes[d]) : int(ends[d]) - k + 1]


def item_shingles(text: str) -> tuple[int, np.ndarray] | None:
    words, _ = word_hashes([text.encode()])
    k = min(WORDS, len(words))
    return (k, shingles(words, k)) if k else None


def known_shingles(texts: list[str]) -> Known:
    seen = defaultdict(list)
    for got in filter(None, map(item_shingles, texts)):
        seen[got[0]].append(got[1])
    return Known(seen)


class Items(Known):
    """Items of such a part: shingle counts, fingerprints and the multi-index, by words of a shingle and shingles of an item."""

    def __init__(self, items: list[tuple[int, str]]):
        self.by_size: dict[tuple[int, int], list[tuple[int, Counter, int]]] = defaultdict(list)
        self.index: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = {}
        seen = defaultdict(list)
        for item_id, text in items:
            got = item_shingles(text)
            if got:
                k, own = got
                self.by_size[k, len(own)].append((item_id, Counter(own.tolist()), int(window_prints(own, len(own))[0])))
                seen[k].append(own)
        super().__init__(seen)
        for size, rows in self.by_size.items():
            index = self.index[size] = defaultdict(list)
            for i, (_, _, fp) in enumerate(rows):
                for block in range(8):
                    for flip in _NEAR:
                        index[block, fp >> 8 * block & 255 ^ flip].append(i)

    def matches(self, own: np.ndarray, k: int, least: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(item_id, first word, words, distance, similarity) of the best window for each item."""
        hits = self.hits(own, k)
        if not len(hits):
            return
        sizes = sorted(m for kk, m in self.by_size if kk == k)
        count = np.zeros(len(own) + 1, np.int32)
        flag = np.zeros(len(own), bool)
        flag[hits] = True
        np.cumsum(flag, out=count[1:])
        share = 2 * least / (1 + least)
        # Runs of hits; a window that counts lies within reach of one.
        cuts = np.flatnonzero(np.diff(hits) > sizes[-1]) + 1
        best: dict[int, tuple[float, int, int, int]] = {}
        whole = None
        for m in sizes:
            # A text with fewer shingles than the item is its one window.
            if not m > len(own) >= least * m - 1e-9 or len(hits) < least / (1 + least) * (len(own) + m) - 1e-9:
                continue
            whole = whole or (Counter(own.tolist()), int(window_prints(own, len(own))[0]))
            for item_id, counts, item_fp in self.by_size[k, m]:
                both = sum(min(n, counts[h]) for h, n in whole[0].items() if h in counts)
                similarity = both / (len(own) + m - both)
                if similarity >= least and (item_id not in best or similarity > best[item_id][0]):
                    best[item_id] = similarity, 0, len(own) + k - 1, (whole[1] ^ item_fp).bit_count()
        for run in np.split(hits, cuts):
            if len(run) < share * sizes[0] - 1e-9:
                continue
            for m in sizes:
                lo, hi = max(0, int(run[0]) - m + 1), min(len(own), int(run[-1]) + m)
                if hi - lo < m:
                    continue
                starts = np.flatnonzero(count[lo + m : hi + 1] - count[lo : hi - m + 1] >= share * m - 1e-9)
                if not len(starts):
                    continue
                rows, index = self.by_size[k, m], self.index[k, m]
                prints = window_prints(own[lo:hi], m)
                for s in starts.tolist():
                    fp = int(prints[s])
                    near = {i for block in range(8) for i in index.get((block, fp >> 8 * block & 255), ())}
                    window = None
                    for i in near:
                        item_id, counts, item_fp = rows[i]
                        distance = (fp ^ item_fp).bit_count()
                        if distance > RADIUS:
                            continue
                        window = window or Counter(own[lo + s : lo + s + m].tolist())
                        both = sum(min(n, counts[h]) for h, n in window.items() if h in counts)
                        similarity = both / (2 * m - both)
                        if similarity >= least and (item_id not in best or similarity > best[item_id][0]):
                            best[item_id] = similarity, lo + s, m + k - 1, distance
        for item_id, (similarity, start, n, distance) in best.items():
            yield item_id, start, n, distance, similarity


def _parts(items: DataFrame, n_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items dealt by id into parts of about so many bytes of text."""
    n = max(1, -(-text_bytes(items) // n_bytes))
    for part in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part)
        yield [(r["item_id"], r["text"]) for r in own.collect()]


def _union(parts: Iterator[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def suspects(docs: DataFrame, items: DataFrame, least: float = 0.8, part_bytes: int = 8_000_000) -> DataFrame:
    """doc_id and text of the rows with enough of the benchmark's shingles to be similar to an item; none is lost.

    One pass over the documents for each ``part_bytes`` of benchmark, whose shingles all tasks get;
    a row that is near several parts comes several times.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))

    def one(part: list[tuple[int, str]]) -> DataFrame:
        known = spark.sparkContext.broadcast(known_shingles([text for _, text in part]))  # part_bytes at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, 1):
                    near = sorted({d for d, _, _ in known.value.texts(piece.column(1).cast(pa.binary()).to_pylist(), least)})
                    if near:
                        yield piece.take(pa.array(near))

        return whole.mapInArrow(run, "doc_id long, text string")

    return _union(map(one, _parts(items, part_bytes)))


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, part_bytes: int = 500_000, known_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, item_id and the best window: first_word, n_words, distance and similarity."""
    spark = docs.sparkSession
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    near = written(suspects(docs, items, least, known_bytes), "suspects")

    def one(part: list[tuple[int, str]]) -> DataFrame:
        known = spark.sparkContext.broadcast(Items(part))  # part_bytes at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, 1):
                    rows = [(piece.column(0)[d].as_py(), *m) for d, k, own in known.value.texts(piece.column(1).cast(pa.binary()).to_pylist(), least) for m in known.value.matches(own, k, least)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

        return near.mapInArrow(run, _DDL)

    out = _union(map(one, _parts(items, part_bytes)))
    best = F.max_by(F.struct("first_word", "n_words", "distance", "similarity"), F.struct(F.col("similarity"), -F.col("first_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
