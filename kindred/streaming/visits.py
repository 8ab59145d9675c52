"""A counter of visits by key, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.functions.text import visitor_key
from kindred.sources.tables import upserted
from kindred.streaming.state import started


def on_route(events: DataFrame, method: str | Column, path: str | Column, ip: str | Column, salt: str | None) -> DataFrame:
    """Requests that count: GET of the root by a known address; none without a salt."""
    method, path, ip = (F.col(c) if isinstance(c, str) else c for c in (method, path, ip))
    return events.where((method == "GET") & (path == "/") & ip.isNotNull() & F.lit(bool(salt)))


def visits(events: DataFrame, ip: str, ts: str, salt: str) -> DataFrame:
    """key, visit_count, first_seen and last_seen; works on a table and on a stream. Rows without an ip do not count."""
    return events.where(F.col(ip).isNotNull()).groupBy(visitor_key(F.col(ip).cast("string"), salt).alias("visitor")).agg(F.count("*").alias("visit_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def run_visits(stream: DataFrame, ip: str, ts: str, salt: str, path: str, checkpoint: str) -> StreamingQuery:
    """Count what has come since the last run; each batch's changed keys go to a folder of their own.

    A batch that runs again writes the same folder, so the newest row of a key is its state.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch:010d}")

    return started(visits(stream, ip, ts, salt).writeStream.outputMode("update").foreachBatch(put), stream.sparkSession, checkpoint)


def run_visit_table(stream: DataFrame, ip: str, ts: str, salt: str, path: str, checkpoint: str) -> StreamingQuery:
    """The same counts as one table with a row for each key, a table of commits at path.

    The counts are kept in the state store; a batch hands on the keys that it changed, which become
    one more folder of the table, so its work grows with these keys. A batch that runs again is
    recognised by its number.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        upserted(batch, path, "visitor", "visit_count", checkpoint, epoch)

    return started(visits(stream, ip, ts, salt).writeStream.outputMode("update").foreachBatch(put), stream.sparkSession, checkpoint)
