"""Periodic run detection: a suffix automaton whose suffix-link tree is accessed as a link-cut tree.

Words of a text are appended one by one to a suffix automaton. Its link tree is kept as a link-cut
tree, in which a preferred path is a set of suffixes with one last end: appending word i accesses
the path from the new prefix to the root, and each segment that this recolours, lengths lo to hi
with the last end j, says that the suffixes of these lengths ended at j before. Where lo < i - j <=
hi, the last 2 (i - j) words are a square whose half has no smaller period, since a smaller one
would have given its length a later end. The squares of a run end at each of its words from the
2 q-th on, so squares of one period with consecutive ends are extended to one run.

Only runs of at least ``powers`` periods and ``least`` words are asked for. Every three words in
a row of such a run occur three times in the text (a run of period q and 4 q words has 4 q - 2
threes in q classes; one of period 1 has six words), so a text is first cut to the stretches that
such threes cover. A run lies in one stretch with all words that could extend it: nothing is lost,
and texts that repeat nothing need no automaton. ``runs_of`` itself takes any words.

Documents are independent, so there is no shuffle; a task holds one text's automaton at a time,
some 600 bytes for each word of a stretch.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import slices, whole_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
POWERS, LEAST = 4, 6


class LastEnds:
    """The suffix automaton of a growing sequence; ``append`` gives the primitive squares at its end."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        self.up, self.left, self.right = [-1], [-1], [-1]  # splay trees of preferred paths, by depth
        self.color = [-1]  # the last end of a path, kept at the root of its splay tree
        self.last, self.n = 0, 0

    def append(self, word: int) -> list[int]:
        """Periods of the primitive squares that end with this word."""
        length, link, following = self.length, self.link, self.next
        end, new = self.n, self._state(self.n + 1, {})
        self.n += 1
        at = self.last
        while at >= 0 and word not in following[at]:
            following[at][word] = new
            at = link[at]
        if at < 0:
            parent = 0
        else:
            parent = following[at][word]
            if length[at] + 1 != length[parent]:
                parent = self._split(at, word, parent)
        link[new] = self.up[new] = parent
        self.last = new
        return self._access(new, end)

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.next.append(following)
        self.up.append(-1)
        self.left.append(-1)
        self.right.append(-1)
        self.color.append(-1)
        return len(self.length) - 1

    def _split(self, at: int, word: int, whole: int) -> int:
        """A state for the shorter suffixes of ``whole``; it joins that one's path, right above it."""
        following, link = self.next, self.link
        short = self._state(self.length[at] + 1, following[whole].copy())
        link[short], link[whole] = link[whole], short
        while at >= 0 and following[at].get(word) == whole:
            following[at][word] = short
            at = link[at]
        self._splay(whole)
        above = self.left[whole]
        self.left[short], self.up[short], self.left[whole] = above, whole, short
        if above >= 0:
            self.up[above] = short
        return short

    def _access(self, new: int, end: int) -> list[int]:
        """Recolour the path from ``new`` to the root with ``end``."""
        up, right, color, length, found = self.up, self.right, self.color, self.length, []
        below, at = new, up[new]
        while at >= 0:
            self._splay(at)
            cut = right[at]
            if cut >= 0:
                color[cut] = color[at]
            top = up[at]
            period = end - color[at]
            if color[at] >= 0 and (length[top] if top >= 0 else 0) < period <= length[at]:
                found.append(period)
            right[at] = below
            below, at = at, top
        self._splay(new)
        color[new] = end
        return found

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        if y < 0 or (left[y] != x and right[y] != x):
            return
        root = x
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                break
            z = up[y]
            root = y
            if z >= 0 and (left[z] == y or right[z] == y):
                root = z
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            self._rotate(x)
        self.color[x] = self.color[root]

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        up[y] = x
        up[x] = z
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x


def runs_of(words: Sequence[int], powers: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """start, length and smallest period of the maximal runs of ``powers`` periods and ``least`` words at least."""
    ends, open_, out = LastEnds(), {}, []

    def close(period: int, first: int, last: int) -> None:
        length = last - first + 2 * period
        if length >= max(least, powers * period):
            out.append((first - 2 * period + 1, length, period))

    for i, word in enumerate(words):
        for period in ends.append(word):
            first, last = open_.get(period, (i, i))
            if last < i - 1:
                close(period, first, last)
                first = i
            open_[period] = first, i
    for period, (first, last) in open_.items():
        close(period, first, last)
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The parts of a text that threes of words with three occurrences cover, of LEAST words at least."""
    if len(ids) < LEAST:
        return []
    base = int(ids.max()) + 1
    pairs = ids[:-1] * base + ids[1:]
    if base > 1 << 20:  # a three must fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    threes = pairs[:-1] * base + ids[2:]
    order = np.argsort(threes)
    same = threes[order]
    third = np.flatnonzero(same[2:] == same[:-2])
    if not len(third):
        return []
    often = np.zeros(len(ids) + 1, bool)
    for k in range(3):
        hit = order[third + k]
        for j in range(3):
            often[hit + j] = True
    edges = np.flatnonzero(np.diff(often.astype(np.int8), prepend=0))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= LEAST]


def text_runs(words: Sequence[str]) -> list[tuple[int, int, int]]:
    """The runs of at least POWERS periods and LEAST words, by start and period."""
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return [(a + start, length, period) for a, b in stretches(ids) for start, length, period in runs_of(ids[a:b].tolist(), POWERS, LEAST)]


def collapsed(words: Sequence[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return list(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words of the contract's query: those of every tenth document, by the hash of its id, repeat from some word on."""
    n, h = len(words), 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    head, cycle = words[:a], words[a : a + period]
    return head + (cycle * ((n - a) // period + 1))[: n - a]


SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS_SCHEMA = "doc_id long, start long, length long, period long, words string"


def _documents(batches: Iterator[pa.RecordBatch], change) -> Iterator[list[tuple]]:
    """doc_id, words and runs of the documents, a slice at a time."""
    for batch in batches:
        for part in slices(batch, 1):
            out = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = WORD.findall(text)
                if change:
                    words = change(words, doc_id)
                out.append((doc_id, words, text_runs(words)))
            yield out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row for each run of each document: where it is, its period and the words of one period.

    A null text is empty and has none; rows with the same doc_id are documents of their own.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for documents in _documents(batches, None):
            rows = [(d, s, n, q, " ".join(words[s : s + q])) for d, words, runs in documents for s, n, q in runs]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 4 else pa.int64()) for i in range(5)], ["doc_id", "start", "length", "period", "words"])

    return _rows(docs).mapInArrow(find, RUNS_SCHEMA)


def run_digests(docs: DataFrame, change=None) -> DataFrame:
    """A row for each document: its number of runs, the longest, and digests of all and of the collapsed text.

    ``change(words, doc_id)`` may replace the words first. A null or empty text has no words and no
    runs; a null doc_id stays null; rows with the same doc_id each give a row; other columns of
    docs, whatever their names, are not read; an empty table gives no rows. A very long text takes
    memory for its own words only.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for documents in _documents(batches, change):
            rows = []
            for doc_id, words, runs in documents:
                start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                rows.append((doc_id, len(words), len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i > 6 else pa.int64()) for i in range(9)], names)

    return _rows(docs).mapInArrow(digest, SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    return run_digests(table(spark, sf_dir, "documents"), planted)
