"""Keyed tables: what is pending, new, published, overridden or reconciled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import work_path


def pending(keys: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Keys that are not done, in order, the first ``limit`` of them."""
    out = keys.join(done.select(key), key, "left_anti").orderBy(key)
    return out if limit is None else out.limit(limit)


def published(production: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Production, and of the staged rows those whose key it lacks."""
    return production.unionByName(staged.join(production.select(key), key, "left_anti"))


def without(staged: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Staged rows whose key has no row in ``needed``, a null key included."""
    return staged.join(needed.select(key), key, "left_anti")


def published_complete(production: DataFrame, staged: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """As ``published``, but refused (KeyError, with one such key) if a staged row lacks what it needs."""
    first = without(staged, needed, key).select(key).first()
    if first is not None:
        raise KeyError(f"a staged row has nothing it needs: {key} = {first[0]!r}")
    return published(production, staged, key)


def overridden(layers: list[DataFrame], key: str) -> DataFrame:
    """One row for every key of any layer, from the last layer that has it; layer counts from 0."""
    every = reduce(DataFrame.unionByName, [d.withColumn("layer", F.lit(i)) for i, d in enumerate(layers)])
    rest = [c for c in every.columns if c not in (key, "layer")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest, "layer"), "layer").alias("x")).select(key, "x.*")


def pool(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), tables[1:], tables[0].select(key).distinct())


def first_row(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of every key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def last_row(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of every key in an order, as where later writes of a key replace earlier ones; rows that are equal by it end by their other columns. One aggregate, so a hot key is added up where it is read."""
    rest = [c for c in df.columns if c not in order]
    last = df.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return last.select(*(F.col("_row")[c].alias(c) for c in df.columns))


def chunked(df: DataFrame, size: int, by: str, *order: str | Column) -> DataFrame:
    """df with chunk: rows of each ``by`` numbered by the columns of order, ascending, ``size`` to a chunk.

    The rows are dealt by ranges of by and order, so a ``by`` with a third of them is numbered in
    many tasks: inside its ranges, plus the rows of the ranges before. The dealt rows are a written
    table, since a range must hold the same rows in both steps. A column chunk of df's is replaced.
    """
    at, keys = work_path(df.sparkSession, "chunked"), [f"_key{i}" for i in range(len(order))]
    marked = [F.col(by).alias("_by"), F.spark_partition_id().alias("_range"), *((F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys))]
    df.repartitionByRange(by, *order).select(F.struct("*").alias("_row"), *marked).write.parquet(at)
    dealt = df.sparkSession.read.parquet(at)
    sums = dealt.groupBy(F.col("_by").alias("_of"), F.col("_range").alias("_at")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select("_of", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_by", "_range").orderBy(*keys))
    numbered = dealt.withColumn("_place", inside).join(sums, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    return numbered.select(*(F.col("_row")[c].alias(c) for c in df.columns if c != "chunk"), F.floor((F.col("_before") + F.col("_place") - 1) / size).cast("long").alias("chunk"))
