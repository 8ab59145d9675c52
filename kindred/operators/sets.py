"""Similarity of sets and multisets by inverted index; pairs that share nothing score 0 and are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_idf(tags: DataFrame, n_items: int) -> DataFrame:
    """tag and idf = ln(n / df) + 1, over distinct (id, tag); n counts items without tags too."""
    return tags.select("id", "tag").distinct().groupBy("tag").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(n_items)) / F.col("df")) + 1)


def shared(queries: DataFrame, items: DataFrame, measure: Column | None = None) -> DataFrame:
    """q, c and what the two share; rows are (id, tag, w). Joined on the tag, added up by pair.

    measure combines the two weights qw and cw of a tag; by default the query's.
    """
    a = queries.select(F.col("id").alias("q"), "tag", F.col("w").alias("qw"))
    b = items.select(F.col("id").alias("c"), "tag", F.col("w").alias("cw"))
    return a.join(b, "tag").where("q <> c").groupBy("q", "c").agg(F.sum(F.col("qw") if measure is None else measure).alias("shared"))


def pair_sums(queries: DataFrame, items: DataFrame, values: list[str], sums: dict[str, Column]) -> DataFrame:
    """q, c, the sums over the tags that the two share, and each side's values (q and c before their names).

    Rows are (id, tag, ...); a value is the same in all rows of an id. Pairs are dealt by q once and not
    joined again: an item's values travel with its tags, and those of a query come to where its pairs are. What
    ranks or groups by q afterwards needs no further shuffle. A sum is over columns of both sides (qw, cw, ...).
    """
    side = lambda df, x: df.select(F.col("id").alias(x), "tag", *(F.col(n).alias(f"{x}{n}") for n in df.columns if n not in ("id", "tag")))
    met = side(queries.drop(*values), "q").join(side(items, "c"), "tag").where("q <> c")
    met = met.select("q", "c", *(x.alias(n) for n, x in sums.items()), *(f"c{n}" for n in values)).repartition("q")
    both = met.groupBy("q", "c").agg(*(F.sum(n).alias(n) for n in sums), *(F.first(f"c{n}").alias(f"c{n}") for n in values))
    own = queries.groupBy(F.col("id").alias("q")).agg(*(F.first(n).alias(f"q{n}") for n in values))
    return both.join(own, "q")


def pair_scores(queries: DataFrame, items: DataFrame, metric: str, measure: Column | None = None) -> DataFrame:
    """q, c and score: jaccard (shared over union) or dice (twice shared over both sums) of weighted sets.

    With weights of 1 these are the plain measures, with idf the weighted ones; with counts and the
    smaller of two as measure, jaccard is the Ruzicka similarity. A set's sum is that of items.
    """
    score = pair_score(metric, F.col("shared"), F.col("qt") + F.col("ct"))
    total = items.groupBy("id").agg(F.sum("w").alias("t"))
    both = pair_sums(queries.select("id", "tag", "w").join(total, "id"), items.select("id", "tag", "w").join(total, "id"), ["t"], {"shared": F.col("qw") if measure is None else measure})
    return both.select("q", "c", score.alias("score"))


def pair_score(metric: str, shared: Column, sums: Column) -> Column:
    """The score of two sets from what they share and the sum of both sides."""
    if metric not in ("jaccard", "dice"):
        raise ValueError(f"unknown metric: {metric!r}")
    return (shared / (sums - shared) if metric == "jaccard" else 2 * shared / sums).cast("double")


def matrix(queries: DataFrame, items: DataFrame, ids: DataFrame, metric: str, measure: Column | None = None) -> DataFrame:
    """pair_scores and a diagonal of ones for all ids (id), also of those without tags; what is not in it is 0."""
    one = ids.select(F.col("id").alias("q"), F.col("id").alias("c"), F.lit(1.0).alias("score")).distinct()
    return pair_scores(queries, items, metric, measure).unionByName(one)


def combined(tag: Column, signature: Column, difficulty: Column | None = None, tag_weight: float = 0.8, signature_weight: float = 0.2, difficulty_weight: float = 0.0) -> Column:
    """The weighted blend; difficulty counts only with a weight."""
    out = F.lit(tag_weight) * tag + F.lit(signature_weight) * signature
    if difficulty is not None and difficulty_weight:
        out = F.lit(1 - difficulty_weight) * out + F.lit(difficulty_weight) * difficulty
    return out


def corroboration_status(q_tags: Column, c_tags: Column, score: Column, least: int = 8, agree: float = 0.5) -> Column:
    """What a second signal says of a pair, by how many tags each side has."""
    return (F.when(q_tags < least, "no_signal").when(c_tags < least, "candidate_sparse").when(score >= agree, "corroborated").otherwise("contradicted"))


def gated(q_tags: Column, c_tags: Column, score: Column, least: int = 8) -> Column:
    return F.when((q_tags >= least) & (c_tags >= least), score).otherwise(0.0)
