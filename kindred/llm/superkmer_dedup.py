"""Substring dedup of word windows by super-k-mer partitioning.

Windows of ``length`` words that follow each other and share a minimiser (the smallest hash of a
run of ``k`` words) travel as one packed string to the minimiser's bucket. There all windows of
the bucket's strings are sorted and counted exactly: by a 64-bit hash, then equal hashes by their
text. A word is removed if a window covers it whose words also start in a document with a smaller
doc_id. See repeats.py for how the work is dealt out: minimisers that occur once do not travel.

Defined cases: a null text has no words; repeated rows have the same doc_id, so they do not remove
each other; texts of fewer words are kept whole; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.repeats import Finder, mixed, removed_spans, window_minima

_BYTES = mixed(np.arange(301, 557, dtype=np.uint64))
_POWER = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_TABLES: dict[str, np.ndarray] = {}


def _powers(of: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to n - 1 modulo 2^64, kept by the worker."""
    got = _TABLES.get(str(of))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 20), of, np.uint64)
        got[0] = 1
        got = _TABLES[str(of)] = np.multiply.accumulate(got)
    return got[:n]


def span_hashes(buffer: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of buffer[start:stop] for each span, by differences of a running sum."""
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTES[buffer] * _powers(_POWER, len(buffer)), out=total[1:])
    return mixed((total[stops] - total[starts]) * _powers(_INVERSE, len(buffer) + 1)[starts])


def _word_edges(flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of a buffer with one space between words."""
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(flat)]))


class WindowFinder(Finder):
    def __init__(self, length: int, k: int = 8):
        if length < 2 * k:
            raise ValueError(f"windows must have {2 * k} words at least")
        self.length, self.k = length, k

    def anchors(self, ids, texts):
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = b" ".join(b" ".join(w) for w in split if w)
        base = np.cumsum(sizes) - sizes
        none = np.zeros(0, np.int64)
        empty = np.zeros(0, np.uint64), (ids, flat, base, none, none, none, none, none, none)
        if sizes.sum() < self.length:
            return empty
        starts, stops = _word_edges(flat)
        words = span_hashes(np.frombuffer(flat, np.uint8), starts, stops)
        grams, span = words, 1
        while span < self.k:
            grams = grams[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + grams[span:]
            span *= 2
        grams = mixed(grams)
        place = window_minima(grams, self.length - self.k + 1)
        doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[: len(place)]
        first = np.flatnonzero(np.arange(len(place)) <= (base + sizes - self.length)[doc])
        if not len(first):
            return empty
        at, doc = place[first], doc[first]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(doc) != 0))))
        stop = np.concatenate((new[1:], [len(first)])) - 1
        return grams[at[new]], (ids, flat, base, starts, stops, at[new], first[new], first[stop], doc[new])

    def passages(self, state, again, hot):
        ids, flat, base, starts, stops, at, first, last, doc = state
        seen: dict[bytes, int] = {}
        rows, to, settled = [], [], []

        def one(a: int, s: int, e: int, d: int, alone: bool) -> None:
            x = flat[starts[s] : stops[e + self.length - 1]]
            if seen.setdefault(x, ids[d]) < ids[d]:
                settled.append((d, s - base[d], e + self.length - base[d]))
                return
            rows.append((ids[d], d, s - base[d], x))
            to.append(xxhash.xxh64_intdigest(x if alone else flat[starts[a] : stops[a + self.k - 1]]))

        for i in np.flatnonzero(again | hot).tolist():
            a, s, e, d = int(at[i]), int(first[i]), int(last[i]), int(doc[i])
            if hot[i]:
                for p in range(s, e + 1):
                    one(a, p, p, d, True)
            else:
                one(a, s, e, d, False)
        x = np.empty(len(rows), object)
        x[:] = [r[3] for r in rows]
        column = lambda k, kind: np.array([r[k] for r in rows], kind)
        return np.array(to, np.uint64), {"id": column(0, np.int64), "place": column(1, np.int32), "start": column(2, np.int64), "x": x}, np.array(settled, np.int64).reshape(-1, 3)

    def repeats(self, rows, batches):
        ids, place, begin = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in ("id", "place", "start"))
        batch = np.repeat(batches, [len(r["id"]) for r in rows])
        xs = [x for r in rows for x in r["x"]]
        flat = b" ".join(xs)
        starts, stops = _word_edges(flat)
        n_words = np.fromiter((x.count(b" ") + 1 for x in xs), np.int64, len(xs))
        windows = n_words - self.length + 1
        row = np.repeat(np.arange(len(xs)), windows)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = (np.cumsum(n_words) - n_words)[row] + offset
        a, b = starts[first], stops[first + self.length - 1]
        hashes = span_hashes(np.frombuffer(flat, np.uint8), a, b)
        order = np.lexsort((ids[row], hashes))
        hashes, a, b, row, offset = hashes[order], a[order], b[order], row[order], offset[order]
        head = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        # Equal hashes are equal windows only if their text is: a window that differs starts over.
        differs = [i for i, j, p, q in zip(*(np.flatnonzero(~head).tolist(), lead[~head].tolist()), a[~head].tolist(), b[~head].tolist()) if flat[p:q] != flat[a[j] : b[j]]]
        least = ids[row[lead]]
        for i in differs:
            text = flat[a[i] : b[i]]
            least[i] = min(ids[row[j]] for j in range(int(lead[i]), len(row)) if hashes[j] == hashes[i] and flat[a[j] : b[j]] == text)
        gone = np.flatnonzero(ids[row] > least)
        row, offset = row[gone], offset[gone]
        span = np.stack([place[row], begin[row] + offset, begin[row] + offset + self.length], axis=1)
        return span, batch[row]


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.string())])


def remove_windows(docs: DataFrame, length: int = 50, **options) -> DataFrame:
    """doc_id, n_words, spans (removed runs of words) and kept (the remaining words, joined by a space)."""

    def apply(doc_id, text, spans):
        words, runs = text.split(), spans.tolist()
        kept = words
        if runs:
            edges = [0, *(x for run in runs for x in run), len(words)]
            kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
        return doc_id, len(words), [{"start": a, "stop": b} for a, b in runs], b" ".join(kept).decode()

    return removed_spans(docs, WindowFinder(length), apply, _KEPT, "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, kept string", **options)


# Brute force: the 50 words of every window against the smallest doc_id that has them.
ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    windows AS (SELECT r, id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
    again AS (SELECT r, p FROM (SELECT *, min(id) OVER (PARTITION BY h) AS least FROM windows) WHERE id > least),
    gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS i FROM again),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def op5_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    got = remove_windows(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return got.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
