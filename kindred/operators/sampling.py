"""Samples that a re-run draws again: order comes from hashes, not from a generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import work_path


def stratified(tags: DataFrame, quota: int, salt: str = "") -> DataFrame:
    """id and tag of a sample that has ``quota`` items of every tag, rarest tags first.

    tags has id and tag; rows without either do not count. An item is picked for one tag only; a tag
    that has fewer items left gives what it has.

    Taken tag by tag, each would pick the items of least hash that no rarer tag has picked. The same
    comes out when all items ask at once (deferred acceptance): each asks its rarest tag, a tag
    keeps the ``quota`` least hashes that have asked it, and who is turned away asks on. Items rank
    the tags alike, so after round n the n rarest tags that are asked at all are settled. A round is one
    pass over those turned away: tags hold at most quota rows each, and who cannot beat the last of a
    full tag, which only gets harder, is turned away there for good.
    """
    spark, key = tags.sparkSession, F.md5(F.concat(F.col("id").cast("string"), F.lit(salt)).cast("binary"))

    def written(df: DataFrame) -> DataFrame:
        path = work_path(spark, "asking")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    own = tags.select("id", "tag").where("id IS NOT NULL AND tag IS NOT NULL").distinct()
    sizes = own.groupBy("tag").agg(F.count("*").alias("_n"))
    ranked = F.array_sort(F.collect_list(F.struct("_n", "tag")))
    asking = own.join(sizes, "tag").groupBy("id").agg(ranked.alias("_left")).select("id", key.alias("_key"), F.transform("_left", lambda x: x["tag"]).alias("_left"))
    asking = written(asking)
    held = asking.limit(0)
    while True:
        asked = asking.unionByName(held).withColumn("_tag", F.get("_left", F.lit(0)))
        order = Window.partitionBy("_tag").orderBy("_key", "id")
        kept = written(asked.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= quota).drop("_place"))
        last = kept.groupBy("_tag").agg(F.count("*").alias("_n"), F.max(F.struct("_key", "id")).alias("_last")).where(F.col("_n") >= quota).select("_tag", "_last")
        turned = asked.join(last, "_tag").where(F.struct("_key", "id") > F.col("_last"))
        on = turned.select("id", "_key", F.slice("_left", 2, F.size("_left")).alias("_left")).where(F.size("_left") > 0)
        asking, held = written(on), kept.drop("_tag")
        if asking.isEmpty():
            return kept.select("id", F.col("_tag").alias("tag"))


def banded(df: DataFrame, band: str, quota: int, key: str) -> DataFrame:
    """``quota`` rows of every band, in the order of key's hash."""
    w = Window.partitionBy(band).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")
