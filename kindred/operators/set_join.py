"""The k most similar sets of each query, exactly, without all pairs that share a frequent tag.

Rows are (id, tag, w); w is a positive integer and the same in every row of a tag, so that sums are
exact and ties are ties. The search goes by sets of tags, the rarest first, level by level:

1. A key of level 1 is one tag. What holds a key that at most ``limit`` items have is joined with
   these items. Of a key that more items have, only its k + 1 items of least total weight are met.
2. Pairs whose only common tags are those of one such key are settled by that: what they share is
   the same for all, so the score falls as the total grows, and k items that the key has met are
   before all the others. What is left shares more tags, all of them frequent, so the next level's keys add
   a frequent tag to a frequent key, and so on until no key is frequent.

A query goes on to a key only if the best that it could still share there, with a set that holds no more
than that, reaches the k-th score found so far. Every join thus has ``limit`` rows or k + 1 of one key
for a query; the work grows with the keys that are frequent, not with the square of their items.

Where ids are whole numbers and the frequent tags make few different sets (``most_kinds`` at most, as flags and
states do), there is a shorter way to the same rows (``_by_kinds``): sets with the same frequent tags are of one kind,
and what a query shares with a set beside rare tags is the same for a whole kind. Each task knows the kinds and the
k + 1 sets of least total of each (a bounded number), and hands on the k best of them for a query. Pairs that
share a rare tag are added up by one join, in which a query meets all that hold a tag in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.session import spread, work_path

CELLS = 2_000_000  # scores made at a time


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _score(metric: str, shared: Column, total: Column) -> Column:
    """total is the sum of both sides' weights."""
    return shared / (total - shared) if metric == "jaccard" else 2 * shared / total


def _met(asked: DataFrame, held: DataFrame, sizes: DataFrame, k: int, limit: int) -> DataFrame:
    """q and c that meet under a key: all that hold a rare one, the k + 1 of least total of a frequent one."""
    with_size = held.join(sizes, "key")
    least = Window.partitionBy("key").orderBy("t", "id")  # a rank with a bound, which Spark cuts before the shuffle
    first = with_size.where(F.col("n") > limit).withColumn("_place", F.row_number().over(least)).where(F.col("_place") <= k + 1)
    items = with_size.where(F.col("n") <= limit).select("key", F.col("id").alias("c")).unionByName(first.select("key", F.col("id").alias("c")))
    return asked.select(F.col("id").alias("q"), "key").join(items, "key").where("q <> c").select("q", "c").distinct()


def _extended(rows: DataFrame) -> DataFrame:
    """rows (id, t, key, s: the key's weight, rest: frequent tags after its last) with one tag more."""
    more = rows.select("id", "t", "key", "s", "rest", F.posexplode("rest").alias("_i", "_x"))
    return more.select("id", "t", F.concat("key", F.array("_x.tag")).alias("key"), (F.col("s") + F.col("_x.w")).alias("s"), F.slice("rest", F.col("_i") + 2, F.size("rest")).alias("rest"))


class _Kinds:
    """Kinds of sets by the numbers of their frequent tags, and of each kind the few sets of least total: what a task knows of all sets."""

    def __init__(self, tags: list[list[int]], weights: np.ndarray, least: pa.Table, k: int) -> None:
        sizes = np.array([len(x) for x in tags], np.int64)
        self.flat, self.ends = np.array([i for x in tags for i in x], np.int64), np.cumsum(sizes)
        self.starts, self.weights = self.ends - sizes, weights
        least = least.sort_by("c")
        self.kind, self.total, self.id = (least.column(n).to_numpy() for n in ("kind", "t", "c"))
        place = least.column("place").to_numpy()
        self.last = np.full(len(tags), np.iinfo(np.int64).max)  # the total of a kind's set k + 1, if it has so many
        self.last[self.kind[place == k + 1]] = self.total[place == k + 1]

    def shared(self, kind: int) -> np.ndarray:
        """The weight of the frequent tags that a kind shares with each kind."""
        own, held = self.flat[self.starts[kind] : self.ends[kind]], np.zeros(len(self.weights), np.int64)
        held[own] = self.weights[own]
        sums = np.concatenate([[0], np.cumsum(held[self.flat])])
        return sums[self.ends] - sums[self.starts]

    def nearest(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is shared, total and id (in order) of sets that include, but for rare tags, the k + 1 best of any query of this kind.

        A set is left out if a kind that shares as much or more has k + 1 sets of less total: for any query these are before it.
        """
        shared = self.shared(kind)
        order = np.argsort(-shared, kind="stable")
        bound = np.empty_like(self.last)
        bound[order] = np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(self.last[order])[:-1]])
        keep = (shared[self.kind] > 0) & (self.total <= bound[self.kind])
        return shared[self.kind[keep]], self.total[keep], self.id[keep]


def _best(q: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of each q."""
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1))
    keep = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < k
    return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(c[keep]), pa.array(score[keep])], ["q", "c", "score"])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False) for x in batch.columns]


def _by_kinds(asked: DataFrame, placed: DataFrame, hot: DataFrame, k: int, metric: str, most: int) -> DataFrame | None:
    """The result of nearest_sets, of sets as _sets makes them; None where kinds are too many."""
    spark = placed.sparkSession
    kinds = placed.select("hot").unionByName(asked.select("hot")).distinct()
    if kinds.limit(most + 1).count() > most:
        return None
    kinds = _written(kinds.withColumn("kind", F.row_number().over(Window.orderBy("hot")) - 1), "kinds")
    asked, placed = (x.join(F.broadcast(kinds), "hot").drop("hot") for x in (asked, placed))
    own = Window.partitionBy("kind").orderBy("t", "id")
    least = placed.select("kind", "t", "id").withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1).withColumnRenamed("id", "c")
    tags = [[63 * j + i for j, x in enumerate(r.hot) for i in range(63) if x >> i & 1] for r in kinds.orderBy("kind").collect()]
    known = spark.sparkContext.broadcast(_Kinds(tags, np.array([r.w for r in hot.orderBy("i").collect()], np.int64), least.toArrow(), k))

    # Sets that share a rare tag: a query meets all that hold it in one row.
    held = placed.select(F.explode("rare").alias("x"), F.col("id").alias("c"), F.col("t").alias("ct"), F.col("kind").alias("ckind")).select("x.tag", "c", "ct", "ckind")
    held = held.repartition("tag").groupBy("tag").agg(F.collect_list(F.struct("c", "ct", "ckind")).alias("x"))
    met = asked.select(F.explode("rare").alias("x"), F.col("id").alias("q"), F.col("t").alias("qt"), F.col("kind").alias("qkind")).select("x.tag", "x.w", "q", "qt", "qkind").join(held, "tag")
    met = met.select("q", "qt", "qkind", "w", *(F.col(f"x.{n}").alias(n) for n in ("c", "ct", "ckind"))).repartition("q")
    met = met.select("q", "qt", "qkind", "w", F.explode(F.arrays_zip("c", "ct", "ckind")).alias("x")).select("q", "qt", "qkind", "w", "x.*").where("q <> c")
    met = met.groupBy("q", "c").agg(F.sum("w").alias("rare"), *(F.first(n).alias(n) for n in ("qt", "ct", "qkind", "ckind"))).sortWithinPartitions("q")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, c, shared, qt, ct, qkind, ckind = _columns(batch)
            shared = shared.copy()
            order = np.argsort(qkind, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(qkind[order])) + 1):
                if len(at):
                    shared[at] += known.value.shared(qkind[at[0]])[ckind[at]]
            yield _best(q, c, _score(metric, shared, qt + ct), k)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, sets = None, None
        for batch in batches:
            q, qt, qkind = _columns(batch)
            for of_kind in np.split(np.arange(len(q)), np.flatnonzero(np.diff(qkind)) + 1):
                if not len(of_kind):
                    continue
                if qkind[of_kind[0]] != kind:
                    kind = qkind[of_kind[0]]
                    sets = known.value.nearest(kind)
                shared, total, c = sets
                for at in np.array_split(of_kind, 1 + len(of_kind) * len(c) // CELLS):
                    if not len(c) or not len(at):
                        continue
                    score = np.where(q[at, None] != c, _score(metric, shared, qt[at, None] + total), -1.0)
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids are in order, so ties are too
                    score, best = np.take_along_axis(score, best, 1), c[best]
                    row, place = np.nonzero(score >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(q[at][row]), pa.array(best[row, place]), pa.array(score[row, place])], ["q", "c", "score"])

    # A kind of many queries is dealt to several tasks.
    by_kind = spread(asked.select(F.col("id").alias("q"), F.col("t").alias("qt"), "kind"), "kind", F.pmod(F.col("q"), F.lit(7))).sortWithinPartitions("kind")
    schema = f"q {asked.schema['id'].dataType.simpleString()}, c {placed.schema['id'].dataType.simpleString()}, score double"
    found = met.mapInArrow(near, schema).unionByName(by_kind.mapInArrow(far, schema))
    # A set that is met in both ways has the higher score where a rare tag counts too.
    best = found.repartition("q").groupBy("q", "c").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("q", "c", "score", "rank")


def _numbered(frequent: DataFrame) -> DataFrame:
    """Each frequent tag with its number i and place among bits: the word and what is set there."""
    numbered = frequent.withColumn("i", F.row_number().over(Window.orderBy("tag")) - 1)
    return _written(numbered.withColumns({"word": F.expr("i DIV 63"), "bit": F.expr("shiftleft(1L, i % 63)")}), "numbered")


def _bits(words: int) -> Column:
    """The frequent tags of a group of rows: an aggregate of a fixed size, whatever a set holds."""
    return F.array(*(F.coalesce(F.bit_or(F.when(F.col("word") == j, F.col("bit"))), F.lit(0).cast("long")) for j in range(words)))


def _numbers(bits: Column, words: int) -> Column:
    """The numbers of the frequent tags in bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(63 * words - 1)), lambda i: F.getbit(F.get(bits, F.floor(i / 63).cast("int")), i % 63) == 1)


def _sets(rows: DataFrame, hot: DataFrame, words: int) -> DataFrame:
    """id, t (total), hot (bits of its frequent tags) and rare (tag and w of the others) of each set; rows have w."""
    rare = F.collect_list(F.when(F.col("i").isNull(), F.struct("tag", "w")))
    return rows.join(F.broadcast(hot.drop("w")), "tag", "left").groupBy("id").agg(F.sum("w").alias("t"), _bits(words).alias("hot"), rare.alias("rare"))


def _sets_weighed(rows: DataFrame, hot: DataFrame, words: int, weigh: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame] | None:
    """_sets, and hot with w, of rows without w, which may repeat; frequent tags are never dealt by tag. None where kinds are more than ``most``."""
    marked = _written(rows.join(F.broadcast(hot), "tag").groupBy("id").agg(_bits(words).alias("hot")), "hot")
    kinds = marked.groupBy("hot").agg(F.count("*").alias("n"))
    if kinds.limit(most + 1).count() > most:
        return None
    each = _written(kinds.select("hot", "n", F.explode(_numbers(F.col("hot"), words)).alias("i")), "kinds")
    hot = _written(hot.join(each.groupBy("i").agg(weigh(F.sum("n")).alias("w")), "i"), "weights")
    sums = each.join(F.broadcast(hot), "i").groupBy("hot").agg(F.sum("w").alias("hot_t"))
    rare = rows.join(F.broadcast(hot), "tag", "left_anti").repartition("tag").distinct()
    rare = rare.withColumn("w", weigh(F.count("*").over(Window.partitionBy("tag")))).repartition("id")
    rare = rare.groupBy("id").agg(F.sum("w").alias("rare_t"), F.collect_list(F.struct("tag", "w")).alias("rare"))
    both = marked.join(F.broadcast(sums), "hot").join(rare, "id", "full")
    none = F.array_repeat(F.lit(0).cast("long"), words)
    t = F.coalesce("hot_t", F.lit(0)) + F.coalesce("rare_t", F.lit(0))
    return _written(both.select("id", t.alias("t"), F.coalesce("hot", none).alias("hot"), F.coalesce("rare", F.array().cast(both.schema["rare"].dataType)).alias("rare")), "placed"), hot


def nearest_sets(queries: DataFrame | str, items: DataFrame, k: int, metric: str = "dice", limit: int = 1000, most_kinds: int = 4000, weigh: Callable[[Column], Column] | None = None) -> DataFrame:
    """q, c, score and rank (score descending, then c) of the k best pairs of each query that share a tag; q <> c.

    queries are rows of items, or sets of their own with the same weights. Rows with a null id or tag do not
    count, rows that repeat count once. With ``weigh`` rows have no w: it makes the weight of a tag (a positive integer)
    of the number of items that hold it, and queries is a condition on the ids of items.
    """
    if metric not in ("jaccard", "dice"):
        raise ValueError(f"unknown metric: {metric!r}")
    if k < 1 or limit < 1:
        raise ValueError("k and limit are 1 or more")

    def side(df: DataFrame) -> DataFrame:
        df = df.where("id IS NOT NULL AND tag IS NOT NULL")
        return df.select("id", "tag") if weigh else df.select("id", "tag", F.col("w").cast("long").alias("w")).distinct()

    own_c = side(items) if weigh else _written(side(items), "sets")
    own_q = None if weigh else _written(side(queries), "sets")
    # Rows that repeat count here each time with weigh; which tags are taken as frequent does not change the result.
    counts = F.count("*").alias("n")
    tag_sizes = own_c.groupBy("tag").agg(counts) if weigh else own_c.groupBy("tag").agg(counts, F.first("w").alias("w"))
    frequent = _written(tag_sizes.where(F.col("n") > limit), "frequent")
    whole_ids = all(isinstance(df.schema["id"].dataType, T.IntegralType) for df in ([own_c] if weigh else [own_c, own_q]))
    if most_kinds and whole_ids and frequent.limit(most_kinds + 1).count() <= most_kinds:
        hot = _numbered(frequent.drop("n"))
        words = hot.count() // 63 + 1
        if weigh:
            made = _sets_weighed(own_c, hot, words, weigh, most_kinds)
            got = made and _by_kinds(made[0].where(queries), *made, k, metric, most_kinds)
        else:
            got = _by_kinds(_written(_sets(own_q, hot, words), "asked"), _written(_sets(own_c, hot, words), "placed"), hot, k, metric, most_kinds)
        if got is not None:
            return got
    if weigh:
        own_c = own_c.distinct()
        own_c = _written(own_c.join(own_c.groupBy("tag").agg(weigh(F.count("*")).alias("w")), "tag").select("id", "tag", "w"), "sets")
        own_q = own_c.where(queries)
    tag_sizes = own_c.groupBy("tag").agg(F.count("*").alias("n"))
    frequent = _written(tag_sizes.where(F.col("n") > limit), "frequent")
    whole = lambda df: df.groupBy("id").agg(F.sum("w").alias("t"), F.collect_list(F.struct("tag", "w")).alias("x"))
    sets_q, sets_c = _written(whole(own_q), "sets"), _written(whole(own_c), "sets")

    def start(df: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Keys of one tag, and frequent tags of each set, rarest first, as what may extend no key."""
        rest = F.transform(F.array_sort(F.collect_list(F.struct("n", "tag", "w"))), lambda x: F.struct(x["tag"].alias("tag"), x["w"].alias("w")))
        none = df.join(frequent, "tag").groupBy("id").agg(rest.alias("rest")).join(sets.select("id", "t"), "id")
        return df.join(sets.select("id", "t"), "id").select("id", "t", F.array("tag").alias("key")), none.select("id", "t", F.array().cast(df.select(F.array("tag").alias("x")).schema["x"].dataType).alias("key"), F.lit(0).cast("long").alias("s"), "rest")

    def scored(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(sets_q.select(F.col("id").alias("q"), F.col("t").alias("qt"), F.col("x").alias("qx")), "q").join(sets_c.select(F.col("id").alias("c"), F.col("t").alias("ct"), F.col("x").alias("cx")), "c")
        shared = F.aggregate(F.array_intersect("qx", "cx"), F.lit(0).cast("long"), lambda s, x: s + x["w"])
        return sides.select("q", "c", _score(metric, shared, F.col("qt") + F.col("ct")).cast("double").alias("score"))

    def best(scores: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
        return _written(scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")

    (asked, q_keys), (held, c_keys) = start(own_q, sets_q), start(own_c, sets_c)
    sizes = tag_sizes.select(F.array("tag").alias("key"), "n")
    top = best(scored(_met(asked, held, sizes, k, limit)))
    q_keys, c_keys = _written(_extended(q_keys), "keys"), _written(_extended(c_keys), "keys")  # single frequent tags
    while True:
        # What a query may still share under a key: the key and all frequent tags after it.
        most = F.col("s") + F.aggregate("rest", F.lit(0).cast("long"), lambda s, x: s + x["w"])
        bound = _score(metric, most, F.col("t") + most).cast("double")
        last = top.where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("score").alias("_last"))
        hopeful = q_keys.where(F.size("rest") > 0).join(last, "id", "left").where(F.col("_last").isNull() | (bound >= F.col("_last"))).drop("_last")
        q_keys = _written(_extended(hopeful), "keys")
        if q_keys.isEmpty():
            return top.select("q", "c", "score", F.col("rank").cast("long").alias("rank"))
        wanted = q_keys.select("key").distinct()
        c_keys = _written(_extended(c_keys.where(F.size("rest") > 0)).join(wanted, "key", "left_semi"), "keys")
        sizes = _written(c_keys.groupBy("key").agg(F.count("*").alias("n")), "sizes")
        found = scored(_met(q_keys, c_keys, sizes, k, limit)).unionByName(top.drop("rank")).dropDuplicates(["q", "c"])
        top = best(found)
        still = sizes.where(F.col("n") > limit).select("key")
        q_keys, c_keys = (x.join(still, "key", "left_semi") for x in (q_keys, c_keys))
