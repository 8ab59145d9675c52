"""What the two substring operators share: finding repeats through anchors, in five steps.

Documents are dealt by doc_id and text into batches of a few MB, so that rows without an id, or with
one that many have, fill many batches; only rows that repeat a document wholly share its batch.
Every window of a fixed length has an
anchor that depends on its content alone (the smallest hash in it), so equal windows have equal
anchors. The steps, each a Spark group over packed rows:

A  a batch sends the hashes of its anchors, each once with its count, to the hashes' buckets;
B  a bucket answers each batch which of them occur once, several times, or very often;
C  a batch sends what stands around anchors that occur again to their buckets; around very
   frequent ones it sends single windows, so that equal ones meet and different ones part;
   equal passages of one batch travel once, as the earliest, and the others are settled there;
D  a bucket finds the repeats and sends every batch the spans to remove;
E  a batch applies the spans of its documents.

A batch or bucket is a few MB at any size of the input; their number grows. No group is made of
one key's rows: a bucket holds a hot anchor's windows at most once from each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import pack, text_bytes, unpack, whole_text, written

ONCE, AGAIN, HOT = 0, 1, 2
_ROW = pa.schema([("key", pa.int64()), ("batch", pa.int64()), ("data", pa.binary())])
_DDL = "key long, batch long, data binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest hash in each run of ``width``, the first one of equals."""
    n = len(hashes) - width + 1
    place = np.arange(len(hashes), dtype=np.int32)
    span = 1
    while span * 2 <= width:
        a, b = place[:-span], place[span:]
        place = np.where(hashes[b] < hashes[a], b, a)
        span *= 2
    if span < width:
        a, b = place[:n], place[width - span : width - span + n]
        place = np.where(hashes[b] < hashes[a], b, a)
    return place[:n]


class Finder:
    """What an operator says about its windows; methods run in tasks."""

    #: whether documents with one doc_id are told apart; rows of passages then get ``tie``, their texts' order
    ordered = False

    #: (anchor hashes, state for later) of a batch
    def anchors(self, ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, object]:
        raise NotImplementedError

    #: (bucket hashes, rows as arrays, spans settled at once) for the anchors that occur again
    def passages(self, state: object, again: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        raise NotImplementedError

    #: what a batch keeps of what it settled
    def own(self, settled: np.ndarray) -> dict[str, np.ndarray]:
        return {"spans": _sorted_spans(settled)}

    #: spans (place of the document in its batch, start, stop) and the batch that each belongs to
    def repeats(self, rows: list[dict[str, np.ndarray]], batches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


def _sorted_spans(spans: np.ndarray) -> np.ndarray:
    """Spans (doc, start, stop) of each document merged where they touch."""
    if not len(spans):
        return spans.reshape(0, 3)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    doc, start, stop = spans.T
    base = np.cumsum(np.concatenate(([0], np.diff(doc) != 0))).astype(np.int64) << 40
    reach = np.maximum.accumulate(base + stop)
    new = np.concatenate(([True], (base + start)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(new)])) - 1
    return np.stack([doc[first], start[first], reach[last] - base[last]], axis=1)


def _out(keys: np.ndarray, batches: np.ndarray, data: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(keys, pa.int64()), pa.array(batches, pa.int64()), pa.array(data, pa.binary())], schema=_ROW)


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(keys[part[0]]), part


def text_order(docs: DataFrame) -> DataFrame | None:
    """doc_id, two hashes of the text and tie, the order of the texts, for documents whose doc_id others have too; None if there are none.

    Texts are dealt by ranges of doc_id and their first letters, so that one doc_id fills many tasks.
    """
    own = docs.select("doc_id", "text")
    again = written(own.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "ids")
    if again.isEmpty():
        return None
    sorted_ = own.join(again, "doc_id", "left_semi").distinct().repartitionByRange("doc_id", F.substring("text", 1, 100)).sortWithinPartitions("doc_id", "text")
    return written(sorted_.select("doc_id", *_hashes(), F.monotonically_increasing_id().alias("tie")), "ties")


def _hashes() -> list[Column]:
    return [F.xxhash64("text").alias("_h0"), F.xxhash64(F.lit(1), "text").alias("_h1")]


def removed_spans(docs: DataFrame, finder: Finder, apply: Callable[[int, bytes, np.ndarray], tuple], schema: pa.Schema, ddl: str, batch_bytes: int = 4_000_000, hot_count: int = 50_000) -> DataFrame:
    """Run the five steps; ``apply(doc_id, text, spans)`` makes one row of each document.

    docs has doc_id and text. Nulls: a null text is empty, a null doc_id comes before all others.
    """
    dealt, read, lowest, c = _carried(docs, finder, batch_bytes, hot_count)

    def step_d(t: pa.Table) -> pa.Table:
        if t.column("key")[0].as_py() < 0:
            return t.select(["key", "batch", "data"])
        batches = t.column("batch").to_numpy()
        spans, owner = finder.repeats([unpack(x) for x in t.column("data").to_pylist()], batches)
        parts = list(_by(owner))
        return _out(np.full(len(parts), t.column("key")[0].as_py()), np.array([k for k, _ in parts]), [pack(spans=_sorted_spans(spans[p])) for _, p in parts])

    def step_e(text: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts = read(text)
        spans = [unpack(x)["spans"] for x in told.column("data").to_pylist()]
        merged = _sorted_spans(np.concatenate(spans)) if spans else np.zeros((0, 3), np.int64)
        rows, doc = [], merged[:, 0]  # a span's document is its place in the batch's order
        for i, (d, x) in enumerate(zip(ids.tolist(), texts)):
            a, b = np.searchsorted(doc, [i, i + 1])
            rows.append(apply(None if d == lowest else d, x, merged[a:b, 1:]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    d = c.groupBy("key").applyInArrow(step_d, _DDL)
    return dealt.groupBy("batch").cogroup(d.groupBy("batch")).applyInArrow(step_e, ddl)


def carried_passages(docs: DataFrame, finder: Finder, batch_bytes: int = 4_000_000, hot_count: int = 50_000) -> DataFrame:
    """Steps A to C: rows (key, batch, data) of packed passages by bucket; those with key < 0 hold what a batch settles on its own."""
    return _carried(docs, finder, batch_bytes, hot_count)[3]


def _carried(docs: DataFrame, finder: Finder, batch_bytes: int, hot_count: int) -> tuple[DataFrame, Callable, int, DataFrame]:
    n_batches = max(1, -(-text_bytes(docs) // batch_bytes))
    n_buckets = n_batches
    lowest = np.iinfo(np.int64).min
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(lowest)))
    own = docs.select(doc_id.alias("doc_id"), whole_text().alias("text"))
    ties = text_order(own) if finder.ordered else None
    tied = ["tie"] if ties is not None else []
    if ties is not None:
        own = own.select("doc_id", "text", *_hashes()).join(ties, ["doc_id", "_h0", "_h1"], "left").withColumn("tie", F.coalesce("tie", F.lit(0).cast("long")))
    dealt = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).alias("batch"), "doc_id", *tied, F.col("text").cast("binary").alias("text")).repartition(min(-(-n_batches // 2), 100_000), "batch")

    def in_order(t: pa.Table) -> pa.Table:
        return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def read(t: pa.Table) -> tuple[np.ndarray, list[bytes]]:
        t = in_order(t)
        return t.column("doc_id").to_numpy(), t.column("text").to_pylist()

    def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(hashes, return_counts=True)

    def bucket_of(hashes: np.ndarray) -> np.ndarray:
        return (mixed(hashes) % np.uint64(n_buckets)).astype(np.int64)

    def step_a(t: pa.Table) -> pa.Table:
        hashes, counts = counted(finder.anchors(*read(t))[0])
        parts = list(_by(bucket_of(hashes)))
        return _out(np.array([k for k, _ in parts]), np.full(len(parts), t.column("batch")[0].as_py()), [pack(h=hashes[p], n=counts[p].astype(np.uint32)) for _, p in parts])

    def step_b(t: pa.Table) -> pa.Table:
        rows = [unpack(x) for x in t.column("data").to_pylist()]
        every = np.concatenate([r["h"] for r in rows])
        counts = np.concatenate([r["n"] for r in rows]).astype(np.int64)
        own, which = np.unique(every, return_inverse=True)
        total = np.bincount(which, counts, len(own)).astype(np.int64)
        kind = np.where(total > hot_count, HOT, np.where(total > 1, AGAIN, ONCE)).astype(np.uint8)[which]
        cut = np.cumsum([len(r["h"]) for r in rows])[:-1]
        return _out(t.column("key").to_numpy(), t.column("batch").to_numpy(), [pack(k=k) for k in np.split(kind, cut)])

    def step_c(text: pa.Table, answers: pa.Table) -> pa.Table:
        if not text.num_rows:
            return _out(np.zeros(0), np.zeros(0), [])
        batch = text.column("batch")[0].as_py()
        found, state = finder.anchors(*read(text))
        hashes, which = np.unique(found, return_inverse=True)
        kind = np.zeros(len(hashes), np.uint8)
        told = dict(zip(answers.column("key").to_pylist(), answers.column("data").to_pylist()))
        for key, part in _by(bucket_of(hashes)):
            kind[part] = unpack(told[key])["k"]
        kind = kind[which]
        to, rows, settled = finder.passages(state, kind == AGAIN, kind == HOT)
        if tied:
            rows["tie"] = in_order(text).column("tie").to_numpy()[rows["place"]]
        parts = list(_by(bucket_of(to)))
        keys = [k for k, _ in parts]
        data = [pack(**{name: v[p] for name, v in rows.items()}) for _, p in parts]
        if len(settled):  # these pass through to step E under a key of the batch's own
            keys.append(-1 - batch)
            data.append(pack(**finder.own(settled)))
        return _out(np.array(keys), np.full(len(keys), batch), data)

    a = dealt.groupBy("batch").applyInArrow(step_a, _DDL)
    b = a.groupBy("key").applyInArrow(step_b, _DDL)
    c = dealt.groupBy("batch").cogroup(b.groupBy("batch")).applyInArrow(step_c, _DDL)
    return dealt, read, lowest, c
