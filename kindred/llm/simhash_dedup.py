"""SimHash near-dedup with anchor-point covering.

A fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 hashes of the
text's word shingles, repeats included. Fingerprints are linked at ``radius`` or fewer differing
bits. To find links, the bits are cut into blocks; two linked fingerprints differ by at most
d = radius // blocks bits in some block. In a block the anchors are the words of a covering code:
a Hamming code of 2^r - 1 bits, which covers every value within one bit, times all values of the
block's other bits. Each fingerprint is at home at the anchor nearest to it, and visits every
anchor within 1 + d bits, so the home of one of two linked fingerprints is always visited by the
other. All comparisons are made anchor by anchor.

Only distinct fingerprints are compared, so exact copies cost one row. An anchor with more than
``most`` fingerprints is dealt out into pairs of chunks of that size. A group hands on a spanning
forest of its links, not the pairs. Links of all groups then make components.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words
than a shingle make one shingle; repeated rows are copies; a null doc_id counts as no id for
component_id unless its whole component has none; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import joined_apart, slices, whole_text, written
from kindred.llm.components import components

BITS = 64


def _spans(flat: bytes) -> tuple[list[int], list[int]]:
    """Where the words of a text with single spaces start and end."""
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    return [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(flat)]


def simhashes(texts: list[bytes], words: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprints of texts: A-Z lowered, words between white space, shingles joined by a space."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        flat = b" ".join(text.lower().split())
        if flat:
            starts, ends = _spans(flat)
            before = len(hashes)
            if len(starts) <= words:
                hashes.append(digest(flat, seed))
            else:
                hashes += [digest(flat[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]
            counts[i] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    own = np.flatnonzero(counts)
    first = np.cumsum(counts[own]) - counts[own]
    # Sums of up to 255 rows fit a byte each, so eight columns are added as one integer.
    runs = -(-counts[own] // 255)
    step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    part = np.add.reduceat(bits.view(np.uint64), np.repeat(first, runs) + 255 * step, axis=0).view(np.uint8)
    votes = np.add.reduceat(part, np.cumsum(runs) - runs, axis=0, dtype=np.int64)
    set_bits = votes * 2 > counts[own][:, None]
    out[own] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                got = simhashes(part.column(1).cast(pa.binary()).to_pylist(), words, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


class Covering:
    """The anchors of one block of bits: a Hamming code of 2^r - 1 bits times its other bits."""

    def __init__(self, low: int, width: int, within: int):
        r = (width + 1).bit_length() - 1
        self.low, self.width, self.code = low, width, (1 << r) - 1
        errors: dict[int, list[int]] = {s: [] for s in range(1 << r)}
        for weight in range(within + 1):
            for places in combinations(range(width), weight):
                s = 0
                for p in places:
                    s ^= p + 1 if p < self.code else 0
                errors[s].append(sum(1 << p for p in places))
        most = max(map(len, errors.values()))
        self.errors = np.array([e + [-1] * (most - len(e)) for _, e in sorted(errors.items())], np.int64)

    def visits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of (place of the fingerprint, anchor, at home); the home is the anchor within one bit."""
        value = ((prints >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)).astype(np.int64)
        syndrome = np.zeros(len(prints), np.int64)
        for p in range(self.code):
            syndrome ^= np.where(value >> p & 1, p + 1, 0)
        flips = self.errors[syndrome]
        who, which = np.nonzero(flips >= 0)
        chosen = flips[who, which]
        home = np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
        return who, value[who] ^ chosen, chosen == home[who]


def coverings(radius: int, blocks: int) -> list[Covering]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [Covering(a, b - a, 1 + radius // blocks) for a, b in zip(edges, edges[1:])]


def _forest(prints: np.ndarray, home: np.ndarray, radius: int, rows: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links between those at home and all others of a group.

    Time grows with homes times prints, in blocks of rows; links that join nothing new cost no
    Python object, so a group of very many near copies takes no more than one of strangers.
    """
    label, out = np.arange(len(prints)), []
    homes = np.flatnonzero(home)
    for at in range(0, len(homes), rows):
        part = homes[at : at + rows]
        near = np.bitwise_count(prints[part][:, None] ^ prints[None, :]) <= radius
        for k in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            i, linked = part[k], np.flatnonzero(near[k])
            apart = linked[label[linked] != label[i]]
            for root, first in zip(*np.unique(label[apart], return_index=True)) if len(apart) else ():
                out.append((int(i), int(apart[first])))
                label[label == root] = label[i]
    return out


def links(prints: DataFrame, radius: int = 4, blocks: int = 3, most: int = 20_000) -> DataFrame:
    """a, b: links that join whatever fingerprints (column fingerprint, distinct) are within radius."""
    codes = coverings(radius, blocks)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                own = batch.column(0).slice(at, 50_000).to_numpy().view(np.uint64)
                for block, code in enumerate(codes):
                    who, anchor, home = code.visits(own)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor * blocks + block), pa.array(own[who].view(np.int64)), pa.array(home)], ["anchor", "fingerprint", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def linked(t: pa.Table) -> pa.RecordBatch:
            anchor, pair, fp, home = (t.column(c).to_numpy() for c in ("anchor", "pair", "fingerprint", "home"))
            fp = fp.view(np.uint64)
            cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(pair) != 0)) + 1
            got: list[tuple[int, int]] = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)]):
                if b - a > 1 and home[a:b].any():
                    got += [(a + i, a + j) for i, j in _forest(fp[a:b], home[a:b], radius)]
            i, j = (np.array(x, np.int64) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], schema=schema)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            anchor, pair = t.column("anchor").to_numpy(), t.column("pair").to_numpy()
            last = len(anchor)  # the last group may go on in the next batch
            while last and (anchor[last - 1], pair[last - 1]) == (anchor[-1], pair[-1]):
                last = int(np.flatnonzero((anchor[:last] != anchor[-1]) | (pair[:last] != pair[-1]))[-1]) + 1 if ((anchor[:last] != anchor[-1]) | (pair[:last] != pair[-1])).any() else 0
            rest = t.slice(last)
            if last:
                yield linked(t.slice(0, last))
        if rest is not None and rest.num_rows:
            yield linked(rest)

    visits = prints.select("fingerprint").mapInArrow(visit, "anchor long, fingerprint long, home boolean")
    hot = visits.groupBy("anchor").count().where(F.col("count") > most).select("anchor", F.ceil(F.col("count") / most).alias("chunks"))
    chunks = F.col("chunks")
    own = F.pmod(F.xxhash64("fingerprint"), chunks)
    pairs = F.when(chunks.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.least(own, j) * chunks + F.greatest(own, j)))
    dealt = joined_apart(visits, hot, "anchor", "left").select("anchor", F.explode(pairs).alias("pair"), "fingerprint", "home")
    return dealt.repartition("anchor", "pair").sortWithinPartitions("anchor", "pair").mapInArrow(compare, "a long, b long").distinct()


def linked_prints(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, blocks: int | None = None, most: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id and fingerprint of every row; the distinct fingerprints with their smallest doc_id; the links between these.

    blocks: by default 3 while their anchors (2^17 a block) outnumber the fingerprints by far, and
    2 (2^27 anchors a half) beyond; either finds every link.
    """
    prints = written(fingerprints(docs, words, seed), "prints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "distinct")
    blocks = blocks or (3 if distinct.count() < 1 << 21 else 2)
    return prints, distinct, links(distinct, radius, blocks, most)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, blocks: int | None = None, most: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable); blocks: as in ``linked_prints``."""
    prints, distinct, linked = linked_prints(docs, words, radius, seed, blocks, most)
    roots = components(linked)
    grouped = distinct.join(roots, distinct.fingerprint == roots.node, "left").select("fingerprint", "doc_id", F.coalesce("root", "fingerprint").alias("root"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = joined_apart(grouped, least, "root").select("fingerprint", "component_id")
    return prints.join(ids, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    return near_duplicates(table(spark, sf_dir, "documents"))
