"""Best-fit packing of documents into sequences, after a reduction by Martello and Toth's dominance.

Documents become pieces of at most ``capacity`` tokens: only longer ones are cut, into full pieces
after a first one that takes the rest. Which pieces share a sequence depends on their lengths
alone, so the instance is a histogram with one count for each length, at most ``capacity`` numbers
however many documents there are. On it the reduction fixes sets of pieces that are provably part of
an optimal packing: a set F that holds piece j dominates if every other set with j can be traded for
F, the rest of it being split into groups that fit, each, below a piece of F. These are

- j alone, where nothing fits beside it;
- j and a piece that fills the sequence;
- j and the largest piece that fits, where no two fit beside j, or where it is no smaller than any two;
- j, the largest piece a that fits and the largest b beside both, where no three fit beside j and in
  every two that fit beside j the lesser is at most b.

Each is fixed for as many copies as the counts allow at once, lengths descending, until none
applies; best fit (decreasing) packs what is left. The plan is a list of slots, ranges of the
pieces of one length with the sequences they go to; its size depends on the capacity only.

Pieces are numbered by length inside the task that codes them, and tasks by sums of their counts, so
nothing is sorted or gathered: each piece finds its slot by its number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.byte_pieces import pieces_of
from kindred.llm.common import scratch_path, slices, whole_text

CAPACITY, END_ID = 2048, 0


@dataclass
class Bins:
    """``count`` sequences with the same lengths in the same order."""

    count: int
    lengths: list[tuple[int, int]] = field(default_factory=list)  # length, how many in a row


class Instance:
    """Counts of pieces by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.count = capacity, np.zeros(capacity + 2, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self.bins: list[Bins] = []

    def beside(self, j: int) -> np.ndarray:
        """Lengths that are left once a piece of length j is taken, ascending."""
        self.count[j] -= 1
        left = np.flatnonzero(self.count)
        self.count[j] += 1
        return left

    def fix(self, lengths: list[int]) -> None:
        """Make sequences of these lengths, as many as the counts allow."""
        every = {x: lengths.count(x) for x in lengths}
        n = min(int(self.count[x]) // k for x, k in every.items())
        for x, k in every.items():
            self.count[x] -= n * k
        self.bins.append(Bins(n, list(every.items())))

    def smallest(self, left: np.ndarray, j: int, k: int) -> int:
        """The sum of the k smallest pieces beside j, or more than fits if there are fewer."""
        total = 0
        for x in left.tolist():
            n = min(k, int(self.count[x]) - (x == j))
            total, k = total + n * x, k - n
            if not k:
                return total
        return self.capacity + 1

    def dominating(self, j: int) -> list[int] | None:
        """A set with j that dominates all others with it, if one of the tests finds it."""
        room, left = self.capacity - j, self.beside(j)
        fit = left[left <= room]
        if not len(fit):
            return [j]
        a = int(fit[-1])
        if a == room or self.smallest(left, j, 2) > room:
            return [j, a]
        if self.smallest(left, j, 3) <= room:
            return None
        pairs = []  # every x with the largest y that fits beside it, x >= y
        for x in fit.tolist():
            y = fit[: np.searchsorted(fit, min(x, room - x), side="right")]
            if len(y) and y[-1] == x and self.count[x] - (x == j) < 2:
                y = y[:-1]
            if len(y):
                pairs.append((x, int(y[-1])))
        if a >= max(x + y for x, y in pairs):
            return [j, a]
        third = [x for x in fit[fit <= room - a].tolist() if x != a or self.count[a] - (a == j) > 1]
        if third and max(y for _, y in pairs) <= third[-1]:
            return [j, a, third[-1]]
        return None

    def reduce(self) -> None:
        """Fix dominating sets, longest pieces first, until no test finds one."""
        found = True
        while found:
            found = False
            for j in np.flatnonzero(self.count)[::-1].tolist():
                while self.count[j] and (lengths := self.dominating(j)):
                    self.fix(lengths)
                    found = True

    def best_fit(self) -> None:
        """Pack what is left: longest pieces first, each into the fullest sequence that has room."""
        open_: dict[int, list[Bins]] = {}
        for length in np.flatnonzero(self.count)[::-1].tolist():
            n, self.count[length] = int(self.count[length]), 0
            for room in sorted(r for r in open_ if r >= length):
                groups, open_[room] = open_.pop(room), []
                for g in groups:
                    n = self._fill(open_, g, room, length, n)
                if not open_[room]:
                    del open_[room]
            if n:
                k = self.capacity // length
                self._fill(open_, Bins(-(-n // k)), self.capacity, length, n)
        self.bins += [g for groups in open_.values() for g in groups]

    @staticmethod
    def _fill(open_: dict[int, list[Bins]], g: Bins, room: int, length: int, n: int) -> int:
        """Put up to n pieces into the sequences of g, which have ``room`` left; how many are still to go."""
        k = room // length
        full = min(g.count, n // k)
        rest = n - full * k if full < g.count else 0
        for count, each in ((full, k), (int(rest > 0), rest), (g.count - full - (rest > 0), 0)):
            if count:
                open_.setdefault(room - each * length, []).append(Bins(count, g.lengths + [(length, each)] * (each > 0)))
        return n - full * k - rest


def packed(counts: dict[int, int], capacity: int = CAPACITY, reduce: bool = True) -> list[Bins]:
    """The sequences for pieces of these lengths: dominating sets, then best fit."""
    own = Instance(counts, capacity)
    if reduce:
        own.reduce()
    own.best_fit()
    return own.bins


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer: for each limit, pieces that cannot share, and what the others need beyond their room."""
    n = np.zeros(capacity + 1, dtype=object)
    for length, k in counts.items():
        n[length] = int(k)
    number, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(total[capacity]) // capacity)
    for least in range(half + 1):  # pieces below ``least`` are left out
        large = number[capacity] - number[capacity - least]
        middle = number[capacity - least] - number[half]
        room = middle * capacity - (total[capacity - least] - total[half])
        small = total[half] - (total[least - 1] if least else 0)
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return int(best)


@dataclass
class Slots:
    """Where the pieces of each length go: from number ``low`` of a length on, ``each`` to a sequence."""

    length: np.ndarray
    low: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, bins: list[Bins]) -> Slots:
        rows, taken, first = [], {}, 0
        for g in bins:
            at = 0
            for length, each in g.lengths:
                low = taken.get(length, 0)
                rows.append((length, low, each, first, at))
                taken[length] = low + each * g.count
                at += length * each
            first += g.count
        rows.sort()
        return cls(*(np.array(x, np.int64) for x in (zip(*rows) if rows else ([],) * 5)))

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by their number among those of their length."""
        at, first = np.empty(len(length), np.int64), np.searchsorted(self.length, length)
        last = np.searchsorted(self.length, length, side="right")
        for x in np.unique(length).tolist():
            own = np.flatnonzero(length == x)
            a, b = first[own[0]], last[own[0]]
            at[own] = a + np.searchsorted(self.low[a:b], number[own], side="right") - 1
        inside = number - self.low[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def write_pieces(docs: DataFrame, path: str, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache: int = 500_000, with_ids: bool = False) -> None:
    """The pieces of all documents: place in the document, crc32 of the ids, number among the task's pieces of their length.

    with_ids adds the ids themselves, as little-endian 32-bit integers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, seen = pieces_of(tokenizer_path, cache), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, 1, 6_000_000):
                ids, n = pieces.encode(some.column(1), end_id)
                many = -(-n // capacity)  # every document has its end id, so one piece at least
                doc, before = np.repeat(np.arange(len(n)), many), np.cumsum(many) - many
                piece = np.arange(len(doc)) - before[doc]
                first = n - (many - 1) * capacity
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                at = np.cumsum(length) - length
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = [raw[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                same = length[order]
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.searchsorted(same, same) + seen[same]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [some.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, spans)), pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, _columns(PIECES) + ["ids"] * with_ids)
        pieces.rest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids).write.option("compression", "zstd").parquet(path)


def placed(spark: SparkSession, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The written pieces with sequence_id and offset, gapless inside a sequence from 0 on.

    Counts by task and length come together for each length (a row a task); the driver gets one
    count for each length, ``capacity`` at most, and sends back the slots: their number is bounded
    by the capacity too (best fit splits at most one group of sequences for each length).
    """
    pieces = spark.read.parquet(path)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots.of(packed(histogram, capacity)))
    rest = [c for c in pieces.columns if c not in ("part", "nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
                sequence, offset = slots.value.place(length, number)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sequence), pa.array(offset)], [*rest, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    numbered = pieces.join(base, ["part", "length"]).select(*rest, (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document, with the sequence and place it is packed at.

    A null or empty text is one piece, its end id; null doc_ids stay null and rows with the same
    doc_id are documents of their own; other columns of docs, whatever their names, are not read;
    an empty table gives no rows; a very long text gives as many full pieces as it needs.
    """
    path = scratch_path(docs.sparkSession, "pieces")
    write_pieces(docs, path, tokenizer_path, capacity, end_id)
    return placed(docs.sparkSession, path, capacity)


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and where each document starts in them."""
    path = scratch_path(docs.sparkSession, "pieces")
    write_pieces(docs, path, tokenizer_path, capacity, end_id, with_ids=True)
    rows = placed(docs.sparkSession, path, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("own"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(b"".join(x["ids"] for x in row["own"]), "<u4")
                out = {"sequence_id": row["sequence_id"], "ids": ids.tolist(), "doc_ids": [x["doc_id"] for x in row["own"]], "offsets": [x["offset"] for x in row["own"]]}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))]))

    return rows.mapInArrow(join, "sequence_id long, ids array<int>, doc_ids array<bigint>, offsets array<bigint>")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kindred.llm.registry import table

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(*_columns(PLACED))
