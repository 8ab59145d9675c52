"""Event-time windows over a stream: tumbling windows, sessions and first rows within a watermark.

A row is late when its window has ended by the watermark, the latest time of the batches before less the
delay; late rows do not count. A window is handed on once, when the watermark has passed its end,
and its state goes then, so state is bounded by the rows within the delay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.streaming.state import started


def tumbling(stream: DataFrame, ts: str, width: str, delay: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """begins, ends, keys and aggregates of each window and key."""
    w = F.window(ts, width).alias("_w")
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).groupBy(w, *keys).agg(*aggregates)
    return rows.select(F.col("_w.start").alias("begins"), F.col("_w.end").alias("ends"), *(c for c in rows.columns if c != "_w"))


def sessions(stream: DataFrame, ts: str, gap: str, delay: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """begins, ends (the last row's time and the gap), keys and aggregates of each session: rows of a key less than a gap apart."""
    w = F.session_window(ts, gap).alias("_w")
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).groupBy(w, *keys).agg(*aggregates)
    return rows.select(F.col("_w.start").alias("begins"), F.col("_w.end").alias("ends"), *(c for c in rows.columns if c != "_w"))


def first_within(stream: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    """One row of each key; the key may come again once the watermark has passed its first row by the delay."""
    return stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_to_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what a run closes to the files at path; each row is written once, over restarts too."""
    return started(rows.writeStream.outputMode("append").format("parquet").option("path", path), rows.sparkSession, checkpoint)
