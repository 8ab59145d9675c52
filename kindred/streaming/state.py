"""State by key in the state store: the last value of each key, handed on only where it changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from kindred.sources.tables import upserted

#: State lives in files of the executor and changelogs in the checkpoint, not on the heap.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def started(writer: DataStreamWriter, spark: SparkSession, checkpoint: str) -> StreamingQuery:
    """Run what has come since the last run, with state in RocksDB; the session's own provider stays set."""
    name, wanted = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


VALUE = StructType([StructField("value", StringType()), StructField("since", TimestampType()), StructField("seen", TimestampType()), StructField("changes", LongType())])
#: Groups of keys whose state is read and written at once; a thousandth of a million keys is a small list.
BUCKETS = 512
CHANGED = StructType([StructField("key", StringType()), *VALUE.fields])


class LastValue(StatefulProcessor):
    """The value of each key's latest row, since when it holds, and how often it has changed, for all keys of a bucket at once.

    Rows are taken by time, then by value; a row that is older than what the state has seen of its key
    changes nothing. A key is handed on once a batch, and only if its value changed. The state of a
    bucket is a list with a row for each key: one read, one sort and one write for each bucket and
    batch, in place of a call, two reads and a write for each key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("last", CHANGED)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.state.get()) if self.state.exists() else [], columns=CHANGED.names)
        before = held.set_index("key")
        new = pd.concat([part[["key", "ts", "value"]] for part in rows], ignore_index=True)
        seen = pd.to_datetime(new["key"].map(before["seen"]))
        new = new[seen.isna() | (new["ts"] >= seen)].sort_values(["key", "ts", "value"], kind="stable", ignore_index=True)
        if new.empty:
            return
        first = new["key"] != new["key"].shift()
        fresh = first & ~new["key"].isin(before.index)
        last = new["value"].shift().where(~first, new["key"].map(before["value"]))
        new["changed"] = fresh | (new["value"] != last)
        new["since"] = new["ts"].where(new["changed"])
        got = new.assign(steps=new["changed"] & ~fresh).groupby("key", sort=False).agg(value=("value", "last"), since=("since", "max"), seen=("ts", "last"), steps=("steps", "sum"), changed=("changed", "any"))
        got["since"] = got["since"].fillna(pd.to_datetime(got.index.to_series().map(before["since"])))
        got["changes"] = got["steps"].astype("int64") + got.index.to_series().map(before["changes"]).fillna(0).astype("int64")
        got = got.reset_index()
        kept = held[~held["key"].isin(got["key"])]
        own = [*kept.itertuples(index=False, name=None), *got[CHANGED.names].itertuples(index=False, name=None)]
        self.state.put([(k, v, pd.Timestamp(a).to_pydatetime(), pd.Timestamp(b).to_pydatetime(), int(n)) for k, v, a, b, n in own])
        out = got.loc[got["changed"], CHANGED.names]
        if len(out):
            yield out

    def close(self) -> None:
        pass


def last_values(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """key, value, since, seen and changes of the keys whose value a batch changed; stream has key, ts and value. Null keys and times do not count.

    Keys are dealt by hash into buckets, whose number must not change while a checkpoint is used.
    """
    rows = stream.where("key IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").selectExpr("cast(key AS string) AS key", "ts", "cast(value AS string) AS value")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(LastValue(), CHANGED, "Update", "None")


def run_last_values(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The changed keys of every batch put into the table of commits at path; a batch that changes none writes nothing."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # the state is worked on once, not again for each use of the batch
        try:
            if not batch.isEmpty():
                upserted(batch, path, "key", "changes", checkpoint, epoch)
        finally:
            batch.unpersist()

    return started(last_values(stream).writeStream.outputMode("update").foreachBatch(put), stream.sparkSession, checkpoint)
