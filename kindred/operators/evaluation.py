"""Retrieval metrics over ranked neighbours and ground-truth edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ground_truth(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct edges (q, t) between names (id), without self-edges."""
    e = edges.where("q <> t").distinct()
    return e.join(names.select(F.col("id").alias("q")), "q", "left_semi").join(names.select(F.col("id").alias("t")), "t", "left_semi").select("q", "t")


def unordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def by_legitimacy(edges: DataFrame, labels: DataFrame, kept: list[str], keep_unjudged: bool) -> DataFrame:
    """Edges whose unordered pair is labelled as one of ``kept``; unjudged ones as told."""
    e = edges.select("q", "t", *unordered("q", "t")).join(labels.select("lo", "hi", "label"), ["lo", "hi"], "left")
    return e.where(F.col("label").isin(kept) | (F.col("label").isNull() & F.lit(keep_unjudged))).select("q", "t")


def hits_by_query(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """k, q, hits among the first k, and relevant: the size of q's truth. Queries without a ranking are left out."""
    relevant = truth.groupBy("q").agg(F.count("*").alias("relevant")).join(ranked.select("q").distinct(), "q", "left_semi")
    found = ranked.join(truth.withColumnRenamed("t", "c"), ["q", "c"], "left_semi").select("q", "rank")
    counted = relevant.join(found, "q", "left").groupBy("q", "relevant").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    return counted.select("q", "relevant", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks))).alias("x")).select("x.k", "q", "x.hits", "relevant")


def metrics(hits: DataFrame) -> DataFrame:
    """k, n_queries, hit_rate, recall (mean of queries) and pooled_recall (of all edges)."""
    return hits.groupBy("k").agg(
        F.count("*").alias("n_queries"), F.round(F.avg((F.col("hits") > 0).cast("double")), 9).alias("hit_rate"),
        F.round(F.avg(F.col("hits") / F.col("relevant")), 9).alias("recall"), F.round(F.sum("hits") / F.sum("relevant"), 9).alias("pooled_recall"))


def average_rank(scores: DataFrame, score: str, by: str = "q") -> DataFrame:
    """Ranks by falling score in which ties share their mean."""
    w = Window.partitionBy(by)
    return scores.withColumn("avg_rank", F.rank().over(w.orderBy(F.desc(score))) + (F.count("*").over(Window.partitionBy(by, score)) - 1) / 2.0)


def quantiles(scores: DataFrame, by: str, score: str, at: dict[str, float], width: float = 0.001) -> DataFrame:
    """by, n, mean, low, high and, by name, the quantiles in ``at`` of every group; exact, interpolated.

    Equal scores are counted first. Bins of ``width`` show where the wanted places lie, and only
    those bins are put in order: with scores to nine places, none has over a million different ones.
    So no task holds all scores of a group. Null scores do not count; a null group is a group.
    """
    own, x = F.col(by).alias("_by"), F.col(score)
    counts = scores.where(x.isNotNull()).groupBy(own, F.floor(x / width).alias("_bin"), x.alias("_x")).agg(F.count("*").alias("_n"))
    bins = counts.groupBy("_by", "_bin").agg(F.sum("_n").alias("_size"), F.sum(F.col("_x") * F.col("_n")).alias("_sum"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    totals = bins.groupBy("_by").agg(F.sum("_size").alias("n"), (F.sum("_sum") / F.sum("_size")).alias("mean"), F.min("_low").alias("low"), F.max("_high").alias("high"))
    found = place_values(counts, wanted_bins(bins, at), at)
    return totals.join(found, F.col("_by").eqNullSafe(F.col("_g"))).select(F.col("_by").alias(by), "n", "mean", "low", "high", *at)


def _within(a: Column, b: Column):
    return lambda s: (s["place"] >= a) & (s["place"] < b)


def wanted_bins(bins: DataFrame, at: dict[str, float]) -> DataFrame:
    """_g, _b, _start, _places: the bins that hold a wanted place of their group; bins has _by, _bin and _size."""
    group = Window.partitionBy("_by")
    last = F.sum("_size").over(group) - 1
    places = []
    for name, p in at.items():
        low, part = F.floor(last * p), last * p - F.floor(last * p)
        places += [F.struct(F.lit(name).alias("name"), low.alias("place"), (1 - part).alias("share")), F.struct(F.lit(name).alias("name"), F.ceil(last * p).alias("place"), part.alias("share"))]
    end = F.sum("_size").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    ended = bins.select(F.col("_by").alias("_g"), F.col("_bin").alias("_b"), (end - F.col("_size")).alias("_start"), end.alias("_end"), F.array(*places).alias("_places"))
    return ended.select("_g", "_b", "_start", F.filter("_places", _within(F.col("_start"), F.col("_end"))).alias("_places")).where(F.size("_places") > 0)


def place_values(counts: DataFrame, wanted: DataFrame, at: dict[str, float]) -> DataFrame:
    """_g and the quantiles by name; counts has _by, _bin, _x and _n, of the wanted bins at least."""
    inside = counts.join(wanted, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_bin") == F.col("_b")))
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy("_by", "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    hits = inside.withColumn("_upto", upto).select("_g", "_x", F.explode(F.filter("_places", _within(F.col("_upto") - F.col("_n"), F.col("_upto")))).alias("_p"))
    return hits.groupBy("_g").agg(*(F.sum(F.when(F.col("_p.name") == name, F.col("_x") * F.col("_p.share"))).alias(name) for name in at))
