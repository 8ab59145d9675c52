"""Suffix-array dedup: maximal repeats of bytes by common-prefix intervals.

The suffixes that start at repeated anchors are sorted by what follows, each with what stands
before it. A scan of the common prefixes of neighbours with a stack gives the tree of
common-prefix intervals. Inside an interval of depth r the suffixes are ordered by what stands
before them, and a second scan gives the groups that also share l bytes to the left and are
diverse beyond: with l + r of ``length`` bytes or more they are a maximal repeat with all its
occurrences. In a group every occurrence but the first is removed.

Sparse anchors keep this exact: each window of ``length`` bytes has one anchor, chosen by its
content alone, and a suffix carries all windows that it is the anchor of. See repeats.py for how
the work is dealt out.

Defined cases: a null text has no bytes; rows with the same doc_id follow each other by text; a
text shorter than ``length`` is kept whole; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import unpack, written
from kindred.llm.repeats import Finder, carried_passages, mixed, removed_spans, window_minima

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def byte_hashes(buffer: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k bytes, k a power of two."""
    h, span = _BYTES[buffer], 1
    while span < k:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + h[span:]
        span *= 2
    return mixed(h)


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many first bytes neighbouring rows share."""
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def intervals(common: list[int], least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (first, last, depth) of depth ``least`` or more, by a scan with a stack."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (where it began, depth)
    for i, depth in enumerate([*common, -1]):
        began = i
        while stack and stack[-1][1] > depth:
            began, d = stack.pop()
            out.append((began, i, d))
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((began, depth))
    return out


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(parts), width), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    row = np.repeat(np.arange(len(parts)), sizes)
    out[row, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(b"".join(parts), np.uint8)
    return out


def maximal_repeats(left: list[bytes], right: list[bytes], length: int, least: int) -> list[tuple[np.ndarray, int, int]]:
    """Groups of suffixes: (members, bytes shared to the left, to the right), together ``length`` or more.

    left holds what stands before each suffix, nearest byte first; suffixes that are to group
    share their first ``least`` bytes.
    """
    order = np.array(sorted(range(len(right)), key=right.__getitem__), np.int64)
    width = length - least
    lefts = _matrix(left, width)
    left_size = np.fromiter(map(len, left), np.int64, len(left))
    left_rank = np.empty(len(left), np.int64)
    left_rank[sorted(range(len(left)), key=left.__getitem__)] = np.arange(len(left))
    sizes = np.fromiter(map(len, right), np.int64, len(right))[order]
    common = _common(_matrix([right[i] for i in order.tolist()], length), sizes)
    tree = intervals(common.tolist(), least)
    out = []
    two = np.array([(a, d) for a, b, d in tree if b - a == 1], np.int64).reshape(-1, 2)
    i, j = order[two[:, 0]], order[two[:, 0] + 1]
    differ = lefts[i] != lefts[j]
    shared = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(left_size[i], left_size[j]))
    for k in np.flatnonzero(shared + two[:, 1] >= length).tolist():
        out.append((np.array([i[k], j[k]]), int(shared[k]), int(two[k, 1])))
    for a, b, depth in tree:
        if b - a < 2:
            continue
        place = np.arange(a, b + 1)[np.argsort(left_rank[order[a : b + 1]])]
        who = order[place]
        before = _common(lefts[who], left_size[who])
        for x, y, extent in intervals(before.tolist(), length - depth):
            inside = place[x : y + 1]
            lo, hi = int(inside.min()), int(inside.max())
            if common[lo:hi].min() == depth:  # else all share more to the right: a deeper interval's group
                out.append((who[x : y + 1], extent, depth))
    return out


class ByteFinder(Finder):
    ordered = True

    def __init__(self, length: int, k: int = 32):
        if length < 2 * k:
            raise ValueError(f"repeats must have {2 * k} bytes at least")
        self.length, self.k = length, k

    def anchors(self, ids, texts):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        buffer = b"".join(texts)
        none = np.zeros(0, np.int64)
        if len(buffer) < self.length:
            return np.zeros(0, np.uint64), (ids, buffer, ends - sizes, none, none, none, none)
        hashes = byte_hashes(np.frombuffer(buffer, np.uint8), self.k)
        place = window_minima(hashes, self.length - self.k + 1)
        last = ends - self.length  # of window starts, by document
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[: len(place)]
        start = np.flatnonzero(np.arange(len(place)) <= last[doc])
        if not len(start):
            return np.zeros(0, np.uint64), (ids, buffer, ends - sizes, none, none, none, none)
        at, doc = place[start], doc[start]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(doc) != 0))))
        stop = np.concatenate((new[1:], [len(start)])) - 1
        return hashes[at[new]], (ids, buffer, ends - sizes, at[new].astype(np.int64), start[new], start[stop], doc[new].astype(np.int64))

    def passages(self, state, again, hot):
        ids, buffer, base, at, first, last, doc = state
        seen: set[tuple[int, bytes]] = set()
        rows, to, settled = [], [], []

        def one(a: int, s: int, e: int, d: int, alone: bool) -> None:
            x = buffer[s : e + self.length]
            if (a - s, x) in seen:
                settled.append((d, s - base[d], e + self.length - base[d]))
                return
            seen.add((a - s, x))
            rows.append((ids[d], d, s - base[d], a - s, x))
            to.append(xxhash.xxh64_intdigest(x if alone else buffer[a : a + self.k]))

        for i in np.flatnonzero(again | hot).tolist():
            a, s, e, d = int(at[i]), int(first[i]), int(last[i]), int(doc[i])
            if hot[i]:
                for p in range(s, e + 1):
                    one(a, p, p, d, True)
            else:
                one(a, s, e, d, False)
        x = np.empty(len(rows), object)
        x[:] = [r[4] for r in rows]
        column = lambda k, kind: np.array([r[k] for r in rows], kind)
        return np.array(to, np.uint64), {"id": column(0, np.int64), "place": column(1, np.int32), "start": column(2, np.int64), "left": column(3, np.uint16), "x": x}, np.array(settled, np.int64).reshape(-1, 3)

    def repeats(self, rows, batches):
        ids, place, start, left = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in ("id", "place", "start", "left"))
        batch = np.repeat(batches, [len(r["id"]) for r in rows])
        xs = [x for r in rows for x in r["x"]]
        # By document and place: the first occurrence of a group is the one of least rank. Rows that repeat a document share its batch.
        rank = np.empty(len(xs), np.int64)
        ties = np.concatenate([r["tie"] for r in rows]) if "tie" in rows[0] else np.zeros(len(xs), np.int64)
        by = np.lexsort((start + left, place, ties, ids))
        rank[by] = np.arange(len(xs))
        spans, owner = [], []

        def remove(members: np.ndarray, lefts: int, rights: int) -> None:
            rest = members[members != members[np.argmin(rank[members])]]
            begin = start[rest] + left[rest] - lefts
            spans.append(np.stack([place[rest], begin, begin + lefts + rights], axis=1))
            owner.append(batch[rest])

        same: dict[tuple[int, bytes], list[int]] = {}
        for i in by.tolist():  # equal passages of several batches: one stands for all
            same.setdefault((int(left[i]), xs[i]), []).append(i)
        for (n, x), members in same.items():
            if len(members) > 1:
                remove(np.array(members), n, len(x) - n)
        own = np.array([m[0] for m in same.values()], np.int64)
        before = [x[:n][::-1] for n, x in same]
        after = [x[n:] for n, x in same]
        for members, lefts, rights in maximal_repeats(before, after, self.length, self.k):
            remove(own[members], lefts, rights)
        if not spans:
            return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        return np.concatenate(spans), np.concatenate(owner)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes) and kept (the remaining bytes).

    A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a
    document with a smaller doc_id or before in the same one.
    """

    def apply(doc_id, text, spans):
        runs = spans.tolist()
        kept = text
        if runs:
            edges = [0, *(x for run in runs for x in run), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        return doc_id, len(text), [{"start": a, "stop": b} for a, b in runs], kept

    return removed_spans(docs, ByteFinder(length), apply, _KEPT, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary", **options)


class GroupFinder(ByteFinder):
    """Keeps every occurrence of a passage, by the passage's hash."""

    def passages(self, state, again, hot):
        ids, buffer, base, at, first, last, doc = state
        to, rows, _ = super().passages(state, again, hot)
        members = []
        for i in np.flatnonzero(again | hot).tolist():
            for s, e in [(p, p) for p in range(first[i], last[i] + 1)] if hot[i] else [(first[i], last[i])]:
                members.append((*_passage(int(at[i] - s), buffer[s : e + self.length]), ids[doc[i]], at[i] - base[doc[i]]))
        return to, rows, np.array(members, np.int64).reshape(-1, 4)

    def own(self, settled):
        return {"members": settled}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _passage(left: int, x: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(left.to_bytes(4, "little") + x)
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def repeat_groups(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """Groups of repeats of ``length`` bytes or more with all their occurrences: repeat (the group), n_bytes, doc_id, start.

    A group is maximal among the passages that its anchor carries: no byte before or after is
    shared by all its occurrences there. Occurrences come from a join of the groups' passages with
    all places of a passage, which no task holds together.
    """
    finder = GroupFinder(length)
    c = written(carried_passages(docs, finder, **options), "passages")

    def members(t: pa.Table) -> pa.Table:
        m = np.concatenate([unpack(x)["members"] for x in t.column("data").to_pylist()])
        return pa.Table.from_arrays([pa.array(m[:, i]) for i in range(4)], ["high", "low", "doc_id", "anchor"])

    def groups(t: pa.Table) -> pa.Table:
        rows = [unpack(x) for x in t.column("data").to_pylist()]
        same = list(dict.fromkeys((int(n), x) for r in rows for n, x in zip(r["left"], r["x"])))
        out = []
        for who, left, right in maximal_repeats([x[:n][::-1] for n, x in same], [x[n:] for n, x in same], length, finder.k):
            n, x = same[who[0]]
            name = _signed(xxhash.xxh64_intdigest(x[n - left : n + right]))
            out += [(name, left, right, *_passage(*same[i])) for i in who.tolist()]
        for n, x in same:  # a passage that occurs again as a whole
            out.append((_signed(xxhash.xxh64_intdigest(x)), n, len(x) - n, *_passage(n, x)))
        columns = list(zip(*out)) or [()] * 5
        return pa.Table.from_arrays([pa.array(v, pa.int64()) for v in columns], ["repeat", "left", "right", "high", "low"])

    places = c.where("key < 0").groupBy("key").applyInArrow(members, "high long, low long, doc_id long, anchor long")
    found = c.where("key >= 0").groupBy("key").applyInArrow(groups, "repeat long, left long, right long, high long, low long").distinct()
    every = found.join(places, ["high", "low"]).select("repeat", (F.col("left") + F.col("right")).alias("n_bytes"), "doc_id", (F.col("anchor") - F.col("left")).alias("start")).distinct()
    again = every.groupBy("repeat", "n_bytes").count().where("count > 1").select("repeat", "n_bytes")
    lowest = F.lit(int(np.iinfo(np.int64).min))
    return every.join(again, ["repeat", "n_bytes"], "left_semi").withColumn("doc_id", F.nullif("doc_id", lowest))


# Brute force: all windows of 100 bytes, by hashes of 64 bytes made from two of 32 and so on, against the first place that has them.
ORACLE = rf"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r, doc_id, regexp_extract_all(hex(coalesce(text, '')), '..') AS x FROM documents),
    h0 AS (SELECT r, len(x) AS n, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS p, hash(c) AS h FROM d),
    {", ".join(f"h{i + 1} AS (SELECT r, n, c, p, hash(h, lead(h, {1 << i}) OVER (PARTITION BY r ORDER BY p)) AS h FROM h{i})" for i in range(6))},
    windows AS (SELECT r, n, c, p, h, lead(h, 36) OVER (PARTITION BY r ORDER BY p) AS g FROM h6),
    again AS (SELECT r, c, p, p <= n - 99 AND row_number() OVER (PARTITION BY h, g, p <= n - 99 ORDER BY r, p) > 1 AS later FROM windows),
    gone AS (SELECT r, c, p, bool_or(later) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM again),
    runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), FALSE) AS starts FROM gone),
    kept AS (SELECT r, string_agg(c, '' ORDER BY p) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans FROM runs GROUP BY r)
    SELECT doc_id, len(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    got = remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
