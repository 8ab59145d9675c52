"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted by cell (source, language, topic) in tokens. The cells' weights are raked in
turn until the token totals of every source, language and topic meet their targets. A document can
be drawn once only, so probabilities are raked by themselves: each is a product of the same kind
with a bound of 1, and each step solves for the factor that, under that bound, meets a value's part
of the budget. A value whose tokens are fewer than its part (``short``) is drawn whole, and the
others of its dimension share what that leaves in proportion to their targets. Draws compare a hash of doc_id and text with the probability: they do not depend on
the order or the partitions, and a task that runs again draws the same.

Topics are clusters of word vectors: words hashed to ``dims`` counts, weighted by rarity, of unit
length. Their centres are fitted on all distinct texts (spherical k-means from a fixed seed, one
Spark job a pass); every text then goes to the centre that fits it best.

Word counts are shuffled once, to count equal texts once, else only sums of centres and cells, each task's
already added up; the raking runs on the table of cells.
Defined cases: a null source, language or topic is a value of its own; a text without tokens
weighs nothing and is drawn with its cell's probability, its topic is ``none``; where no weights
meet all marginals, raking stops after ``rounds`` with the last dimension met and the others off,
a warning says how far, and rows of a value that is off name it (``missed``); an empty table gives no rows; repeated rows are drawn together; other columns are kept, but
those named like a result are replaced by it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from kindred.llm.common import slices, whole_text, written
from kindred.llm.decontamination import word_hashes
from kindred.llm.repeats import mixed

DIMENSIONS = ("source", "lang", "topic")
RESULTS = ("topic", "n_tokens", "weight", "probability", "drawn", "short", "missed")
#: A value whose expected share is further off its goal is said to be missed.
MISSED = 1e-3
TOPICS = 8
#: The lengths of texts' vectors and of centres, in whole numbers: products of the two are below 2^53.
UNIT, CENTRE = 1 << 14, 1 << 20
log = logging.getLogger(__name__)


def _places(texts: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word in a vector of ``dims`` (a power of two), and the words of each text."""
    hashes, sizes = word_hashes(texts)
    return (hashes >> np.uint64(64 - (dims.bit_length() - 1))).astype(np.int64), sizes


def text_counts(docs: DataFrame, dims: int) -> DataFrame:
    """h (the hash of a text) and counts (of its words by place, ``dims`` numbers of one or four bytes) of every distinct text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                at, sizes = _places(part.column(1).cast(pa.binary()).to_pylist(), dims)
                counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dims + at, minlength=len(sizes) * dims).reshape(-1, dims)
                own = np.flatnonzero(sizes)
                packed = [counts[i].astype(np.uint8 if counts[i].max() < 256 else np.uint32).tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(packed, pa.binary())], ["h", "counts"])

    texts = docs.select(whole_text().alias("_text")).select(F.xxhash64("_text").alias("h"), "_text")
    return texts.mapInArrow(run, "h long, counts binary").dropDuplicates(["h"])


def _unpacked(counts: pa.Array, dims: int) -> np.ndarray:
    return np.array([np.frombuffer(c, np.uint8 if len(c) == dims else np.uint32) for c in counts.to_pylist()], np.int64).reshape(-1, dims)


def _units(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Vectors of length UNIT in whole numbers; products and sums of these are exact, in whatever order and parts they are made."""
    x = counts * rarity
    return np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * UNIT).astype(np.int16)


def _chances(h: np.ndarray, step: int, seed: int) -> np.ndarray:
    """A number above 0 and up to 1 for each hash, the same in every run."""
    with np.errstate(over="ignore"):
        return ((mixed(h.view(np.uint64) + np.uint64((seed * 1009 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


def _summed(rows: DataFrame, column: str, of: Callable[[pa.Array], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of the table of whole numbers of this shape that ``of`` makes of a batch's column; Spark adds up the tasks' tables by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                got = of(batch.column(column).slice(at, 2048))
                total = got if total is None else total + got
        if total is not None:
            flat = total.ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(flat)), pa.array(flat[np.flatnonzero(flat)])], ["at", "n"])

    got = rows.select(column).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # topics x dims numbers at most
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(shape)


def spread_topics(docs: DataFrame, topics: int, dims: int, seed: int = 1, rounds: int = 30) -> np.ndarray:
    """What a word of each place adds to each topic's score: centres of spherical k-means over all distinct texts, weighted by rarity.

    Each pass is a Spark job over the texts' vectors; the driver holds the centres. The first
    centres are texts drawn one after another, likelier where the nearest centre is far: of
    exponential waiting times, whose rates are the distances, the least wins. Rounds end when
    nothing moves, or after ``rounds``. All sums are of whole numbers, so the centres do not depend
    on partitions or order.
    """
    counts = written(text_counts(docs, dims), "counts")
    seen = _summed(counts, "counts", lambda c: np.concatenate((np.array([len(c)]), (_unpacked(c, dims) > 0).sum(axis=0))), (1 + dims,))
    n, rarity = int(seen[0]), np.log((seen[0] + 1) / (seen[1:] + 1)) + 1
    if not n:
        return np.zeros((dims, topics), np.float32)

    def as_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([u.tobytes() for u in _units(_unpacked(part.column(1), dims), rarity)], pa.binary())], ["h", "unit"])

    few = 2 * docs.sparkSession.sparkContext.defaultParallelism  # tasks stream their rows, so that fewer ones only save the starts of a pass
    units = written(counts.mapInArrow(as_units, "h long, unit binary").coalesce(few), "units")
    vectors = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.int16).reshape(-1, dims).astype(np.float64)
    centres = np.zeros((0, dims))
    while len(centres) < min(topics, n):
        step, held = len(centres), centres.copy()

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    h = part.column(0).to_numpy()
                    far = np.ones(len(h)) if not step else np.clip(1 - (vectors(part.column(1)) @ held.T).max(axis=1) / UNIT / CENTRE, 0, None) + 1e-12  # noqa: B023
                    wait = -np.log(_chances(h, step, seed)) / far  # noqa: B023
                    i = np.lexsort((h, wait))[:1]
                    yield pa.RecordBatch.from_arrays([pa.array(wait[i]), part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i))], ["wait", "h", "unit"])

        first = units.mapInArrow(drawn, "wait double, h long, unit binary").orderBy("wait", "h").first()
        centres = np.vstack((centres, _centred(np.frombuffer(first["unit"], np.int16).astype(np.float64)[None, :])))
    for _ in range(rounds):
        held = centres.copy()

        def sums(c: pa.Array) -> np.ndarray:
            x = vectors(c)
            own = (x @ held.T).argmax(axis=1)  # noqa: B023
            return (own[None, :] == np.arange(len(held))[:, None]).astype(np.float64) @ x  # noqa: B023

        total = _summed(units, "unit", sums, centres.shape)
        centres = np.where(total.any(axis=1, keepdims=True), _centred(total.astype(np.float64)), centres)
        if (centres == held).all():
            break
    return (centres / CENTRE * rarity).T.astype(np.float32)


def _centred(x: np.ndarray) -> np.ndarray:
    return np.rint(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1) * CENTRE)


def fitted_topics(counts: np.ndarray, topics: int, seed: int = 1, rounds: int = 30) -> np.ndarray:
    """As ``spread_topics``, of an array with a row of counts for each text."""
    rarity = np.log((len(counts) + 1) / ((counts > 0).sum(axis=0) + 1)).astype(np.float32) + 1
    x = counts * rarity
    x = x[x.any(axis=1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if not len(x):
        return np.zeros((counts.shape[1], topics), np.float32)
    r = np.random.default_rng(seed)
    centres = x[[r.integers(len(x))]]
    while len(centres) < min(topics, len(x)):  # further ones are likelier where the nearest is far
        far = np.clip(1 - (x @ centres.T).max(axis=1), 0, None).astype(np.float64) + 1e-12
        centres = np.vstack((centres, x[[r.choice(len(x), p=far / far.sum())]]))
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == t].sum(axis=0) if (own == t).any() else c for t, c in enumerate(centres)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return (centres * rarity).T.astype(np.float32)


def with_topic(docs: DataFrame, model: np.ndarray, tokens: str | None = None) -> DataFrame:
    """Every row of docs as a struct doc, with topic and n_tokens: words between white space, or what the column ``tokens`` says."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    known = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = known.value
        dims, topics = score_of.shape
        names = np.array([f"topic{i}" for i in range(topics)] + ["none"], object)
        for batch in batches:
            text = batch.column(0).field("text").cast(pa.string()).fill_null("")
            for part in slices(pa.RecordBatch.from_arrays([text, batch.column(0)], ["text", "doc"]), 0, 1_000_000):
                at, sizes = _places(part.column(0).cast(pa.binary()).to_pylist(), dims)
                best, own = np.full(len(sizes), topics), np.flatnonzero(sizes)
                if len(own):
                    best[own] = np.add.reduceat(score_of[at], (np.cumsum(sizes) - sizes)[own], axis=0).argmax(axis=1)
                n = pa.array(sizes) if tokens is None else part.column(1).field(tokens).cast(pa.int64()).fill_null(0)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(names[best], pa.string()), n], ["doc", "topic", "n_tokens"])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("topic", StringType()).add("n_tokens", LongType()))


def flattened(cells: DataFrame, power: float) -> list[DataFrame]:
    """Target shares of every dimension: each value's token share to a power, made to add up to one."""
    out = []
    for d in DIMENSIONS:
        t = cells.groupBy(d).agg(F.sum("tokens").alias("n")).where("n > 0").withColumn("n", F.pow("n", F.lit(power)))
        out.append(t.select(d, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("target")))
    return out


def attainable(cells: DataFrame, targets: list[DataFrame], share: float) -> list[DataFrame]:
    """Targets that ``share`` of all tokens can meet: d, target, stated and short.

    A value has min(what it has, c * stated target), c the same for all values of a dimension; short
    says that it has less than the stated target asks for.
    """
    total, out = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0.0, []
    for d, t in zip(DIMENSIONS, targets):
        has = cells.groupBy(F.col(d).alias("_v")).agg((F.sum("tokens") / F.lit(max(share * total, 1e-300))).alias("tokens"))
        both = written(has.join(t, F.col(d).eqNullSafe(F.col("_v"))).where("tokens > 0").select(d, "tokens", F.col("target").alias("stated"), (F.col("target") / F.col("tokens")).alias("weight")), "supply")
        c = budget_factor(both, 1.0)
        out.append(both.select(d, F.least(F.col("tokens"), F.lit(c) * F.col("stated")).alias("target"), "stated", (F.col("weight") > 1 + 1e-9).alias("short")))
    return out


def raked(cells: DataFrame, targets: list[DataFrame], rounds: int = 60, tolerance: float = 1e-6, most_local: int = 100_000, most: float = float("inf")) -> DataFrame:
    """cells with weight: tokens * weight has the target shares of every dimension.

    cells has the dimensions and tokens; a target has one dimension and target. Values without a
    target get none of the weight. No weight is above ``most``. Up to ``most_local`` cells are
    fitted on the driver, more by Spark; both end at the same weights.
    """
    if len(cells.limit(most_local + 1).select("tokens").collect()) <= most_local:
        return _raked_on_driver(cells, targets, rounds, tolerance, most)
    return _raked_in_spark(cells, targets, rounds, tolerance, most)


def _missed(off: float, rounds: int) -> None:
    log.warning("raking stopped after %d rounds; the share of some value is off by %.2g", rounds, off)


def _raked_in_spark(cells: DataFrame, targets: list[DataFrame], rounds: int, tolerance: float, most: float) -> DataFrame:
    """Up to ``most`` a weight is the product of a factor for each of the cell's values, so a step is one aggregate of the cells and a new table of one dimension's factors."""
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    cells = written(cells.select(*DIMENSIONS, "tokens"), "cells")
    wanted = [written(t.select(F.col(d).alias("v"), (F.col("target") * total).alias("want")), "wanted") for d, t in zip(DIMENSIONS, targets)]
    factors = [written(cells.select(F.col(d).alias("v")).distinct().withColumn("factor", F.lit(1.0)), "factors") for d in DIMENSIONS]

    def weighed() -> DataFrame:
        df, weight = cells, F.lit(1.0)
        for i, (d, f) in enumerate(zip(DIMENSIONS, factors)):
            f = f.select(F.col("v").alias(f"_v{i}"), F.col("factor").alias(f"_f{i}"))
            df, weight = df.join(f, F.col(d).eqNullSafe(F.col(f"_v{i}")), "left"), weight * F.col(f"_f{i}")
        return df.select(*DIMENSIONS, "tokens", F.least(weight, F.lit(most)).alias("weight"), (weight >= most).alias("full"))

    def totals(i: int) -> DataFrame:
        part = F.col("tokens") * F.col("weight")
        have = weighed().groupBy(F.col(DIMENSIONS[i]).alias("h")).agg(F.sum(part).alias("have"), F.sum(F.when(F.col("full"), part).otherwise(0.0)).alias("full"))
        return have.join(wanted[i], F.col("h").eqNullSafe(F.col("v")), "left").select("h", "have", "full", F.coalesce("want", F.lit(0.0)).alias("want"))

    off = 0.0
    for n in range(1, rounds + 1):
        for i in range(len(DIMENSIONS)):
            # What is full stays so while the rest meets what is left; where that is not enough, all of the value come down.
            room = (F.col("want") > F.col("full")) & (F.col("have") > F.col("full"))
            by = F.when(room, F.try_divide(F.col("want") - F.col("full"), F.col("have") - F.col("full"))).when(F.col("have") == F.col("full"), F.least(F.lit(1.0), F.try_divide("want", "have"))).otherwise(F.try_divide("want", "have"))
            step = totals(i).select("h", F.coalesce(by, F.lit(0.0)).alias("by"))
            factors[i] = written(factors[i].join(step, F.col("v").eqNullSafe(F.col("h"))).select("v", (F.col("factor") * F.col("by")).alias("factor")), "factors")
        if n % 4 == 0 or n == rounds:
            off = max(totals(i).agg(F.max(F.abs(F.col("have") - F.col("want"))).alias("e")).first()["e"] or 0.0 for i in range(len(DIMENSIONS)))
            if off <= tolerance * max(total, 1):
                return weighed().drop("full")
    _missed(off / max(total, 1), rounds)
    return weighed().drop("full")


def _factors(code: np.ndarray, tokens: np.ndarray, weight: np.ndarray, want: np.ndarray, most: float) -> np.ndarray:
    """For each value the m for which its tokens * min(most, m * weight) add up to what it wants, or fill it."""
    m, full = np.ones(len(want)), np.zeros(len(code), bool)
    while True:  # each pass fills more cells, or it is the last
        rest, fixed = np.bincount(code, np.where(full, 0, tokens * weight), len(want)), np.bincount(code, np.where(full, tokens, 0), len(want)) * (most if full.any() else 0)
        m = np.divide(np.maximum(want - fixed, 0), rest, out=m, where=rest > 0) if full.any() else np.divide(want, rest, out=np.zeros(len(want)), where=rest > 0)
        now = full | (weight * m[code] >= most)
        if (now == full).all():
            return m
        full = now


def _raked_on_driver(cells: DataFrame, targets: list[DataFrame], rounds: int, tolerance: float, most: float) -> DataFrame:
    rows = cells.select(*DIMENSIONS, "tokens").collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    weight, total = np.ones(len(rows)), tokens.sum()
    codes, wanted = [], []
    for d, t in zip(DIMENSIONS, targets):
        values = {v: i for i, v in enumerate(dict.fromkeys(r[d] for r in rows))}
        goal = {r[d]: r["target"] for r in t.collect() if r[d] in values}  # no more rows than cells
        codes.append(np.array([values[r[d]] for r in rows], np.int64))
        wanted.append(np.array([goal.get(v, 0.0) * total for v in values]))
    off = 0.0
    for n in range(1, rounds + 1 if rows else 0):
        for code, want in zip(codes, wanted):
            weight = np.minimum(weight * _factors(code, tokens, weight, want, most)[code], 1e250)
        if n % 4 == 0 or n == rounds:
            off = max(np.abs(np.bincount(c, tokens * np.minimum(weight, most), len(w)) - w).max() for c, w in zip(codes, wanted))
            if off <= tolerance * max(total, 1):
                break
    else:
        if rows:
            _missed(off / max(total, 1), rounds)
    return cells.sparkSession.createDataFrame([(*(r[d] for d in DIMENSIONS), r["tokens"], float(w)) for r, w in zip(rows, np.minimum(weight, most))], ", ".join([f"{d} string" for d in DIMENSIONS] + ["tokens double", "weight double"]))


def budget_factor(cells: DataFrame, budget: float) -> float:
    """c such that the sum of tokens * min(1, c * weight) is the budget.

    Weights may lie any number of powers of ten apart, so c is searched by ratio. Once no weight is
    left whose cell may or may not be full (c * weight of 1 or more), c follows from the sums. If
    the budget is more than all tokens with a weight, c fills all their cells.
    """
    cells = cells.where("weight > 0 AND tokens > 0")
    seen = cells.agg(F.min("weight").alias("w"), F.sum(F.col("tokens") * F.col("weight")).alias("mass"), F.sum("tokens").alias("tokens")).first()
    if not seen["mass"] or budget <= 0:
        return 0.0
    low, high = budget / seen["mass"], min(1.0 / seen["w"], 1e300)  # the first is met if no cell is full, the second fills all
    if budget >= seen["tokens"] or low >= high:
        return high
    for _ in range(64):  # each pass cuts the range to its 32nd root
        grid = [low, *(low * (high / low) ** (i / 32) for i in range(1, 32)), high]
        full = lambda c: F.col("weight") * c >= 1
        sums = [f(F.when(full(c) if k == "full" else ~full(c), x)).alias(f"{k}{i}") for i, c in enumerate(grid) for k, f, x in (("full", F.sum, F.col("tokens")), ("rest", F.sum, F.col("tokens") * F.col("weight")), ("n", F.count, F.col("weight")))]
        got = cells.agg(*sums).first()
        i = max((i for i, c in enumerate(grid) if (got[f"full{i}"] or 0.0) + c * (got[f"rest{i}"] or 0.0) <= budget), default=0)
        low, high = grid[i], grid[min(i + 1, 32)]
        if got[f"n{i}"] == got[f"n{min(i + 1, 32)}"] or high <= low * (1 + 1e-12):
            rest = got[f"rest{i}"] or 0.0
            return min(max((budget - (got[f"full{i}"] or 0.0)) / rest, low), high) if rest else low
    return low


def sampled_rows(docs: DataFrame, targets: list[DataFrame] | None = None, power: float = 0.5, share: float = 0.5, seed: int = 1, topics: int = TOPICS, dims: int = 512, tokens: str | None = None, rounds: int = 500) -> DataFrame:
    """Every row of docs as a struct doc, with topic, n_tokens, weight, probability, short, missed and drawn.

    short names the dimensions whose value of the row has fewer tokens than its target asks for,
    missed those whose value's expected share is off its goal, since the goals of the dimensions
    exclude each other.

    targets: by default each dimension's token shares to ``power``. share: the part of all tokens
    to draw, in expectation. tokens: a column of docs with token counts, in place of words. rounds:
    of raking, at most.
    """
    model = spread_topics(docs, topics, dims)
    own = {"source": F.col("doc.source").cast("string"), "lang": F.col("doc.lang").cast("string"), "topic": F.col("topic")}
    counted = with_topic(docs.select("text", "source", "lang", *([tokens] if tokens else [])), model, tokens)
    cells = written(counted.groupBy(*(c.alias(d) for d, c in own.items())).agg(F.sum("n_tokens").cast("double").alias("tokens")), "counted")
    targets = targets or flattened(cells, power)
    goals = attainable(cells, targets, share)
    fitted = raked(cells, targets, rounds).select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "weight")
    limited = written(raked(cells, goals, rounds, most=1 / share), "limited")
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0.0
    c = budget_factor(limited, share * total)  # the share itself, unless the goals exclude each other
    limited = limited.withColumn("probability", F.least(F.lit(1.0), F.lit(c) * F.col("weight")))
    cell = fitted.join(limited.select(*(F.col(d).alias(f"__{d}") for d in DIMENSIONS), "probability"), [F.col(f"_{d}").eqNullSafe(F.col(f"__{d}")) for d in DIMENSIONS])
    said = {"short": [], "missed": []}
    for d, goal in zip(DIMENSIONS, goals):
        got = limited.groupBy(F.col(d).alias("_of")).agg((F.sum(F.col("tokens") * F.col("probability")) / F.lit(max(share * total, 1e-300))).alias("got"))
        off = F.abs(F.coalesce("target", F.lit(0.0)) - F.col("got")) > MISSED
        marks = got.join(goal, F.col("_of").eqNullSafe(F.col(d)), "left").select(F.col("_of").alias(f"_of_{d}"), F.when(F.col("short"), d).alias(f"_short_{d}"), F.when(off, d).alias(f"_missed_{d}"))
        cell = cell.join(marks, F.col(f"_{d}").eqNullSafe(F.col(f"_of_{d}")), "left")
        for k, names in said.items():
            names.append(F.col(f"_{k}_{d}"))
    cell = written(cell.select(*(f"_{d}" for d in DIMENSIONS), "weight", "probability", *(F.concat_ws(",", *names).alias(k) for k, names in said.items())), "weights")
    same = [own[d].eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS]
    draw = F.pmod(F.xxhash64(F.col("doc.doc_id"), F.col("doc.text"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return (with_topic(docs, model, tokens).join(cell, same[0] & same[1] & same[2], "left")
        .select("doc", "topic", "n_tokens", zero("weight"), zero("probability"), *(F.coalesce(k, F.lit("")).alias(k) for k in said)).withColumn("drawn", draw < F.col("probability")))


def mixed_sample(docs: DataFrame, **options) -> DataFrame:
    """docs with topic, n_tokens, weight, probability, drawn, short and missed; the options are those of sampled_rows."""
    return sampled_rows(docs, **options).select(*(F.col("doc")[c].alias(c) for c in docs.columns if c not in RESULTS), *RESULTS)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    docs = table(spark, sf_dir, "documents")
    return mixed_sample(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "drawn", "short", "missed")
