"""State by key and event-time windows, over several runs of a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kindred.sources.commits import Table
from kindred.streaming.state import PROVIDER, run_last_values
from kindred.streaming.windows import first_within, run_to_files, sessions, tumbling

START = datetime(2024, 5, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def put(spark, tmp_path, *rows):
    spark.createDataFrame([(k, None if m is None else at(m), v) for k, m, v in rows], "key string, ts timestamp, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema("key string, ts timestamp, value string").parquet(f"{tmp_path}/in")


def test_last_values(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/out", "key", "changes")
    run = lambda *rows: run_last_values(put(spark, tmp_path, *rows), table.path, f"{tmp_path}/state").awaitTermination()
    held = lambda: {r.key: (r.value, r.since, r.changes) for r in table.read().collect()}
    run(("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 3, "y"), (None, 1, "x"), ("c", None, "x"))
    assert held() == {"a": ("x", at(1), 0), "b": ("y", at(3), 1)}
    version = table.head().version
    run(("a", 5, "x"), ("b", 2, "z"))  # no change, and a row from before
    assert held() == {"a": ("x", at(1), 0), "b": ("y", at(3), 1)} and table.head().version == version
    run(("a", 6, "w"), ("d", 1, "n"))
    assert held() == {"a": ("w", at(6), 1), "b": ("y", at(3), 1), "d": ("n", at(1), 0)}
    last = spark.read.parquet(f"{tmp_path}/out/data/{table.head().deltas[-1]}")
    assert sorted(r.key for r in last.collect()) == ["a", "d"]  # only what changed was written
    assert spark.conf.get(PROVIDER[0], None) != PROVIDER[1]


def test_tumbling_windows_and_late_rows(spark, tmp_path):
    def run(*rows):
        stream = tumbling(put(spark, tmp_path, *rows), "ts", "10 minutes", "15 minutes", ["key"], F.count("*").alias("n"))
        run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted((r.key, r.begins, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run(("a", 1, "x"), ("a", 9, "x"), ("b", 30, "x"), ("a", None, "x")) == [("a", at(0), 2)]
    assert run(("a", 2, "late"), ("a", 16, "in time"), ("b", 50, "x")) == [("a", at(0), 2), ("a", at(10), 1)]
    assert run(("b", 90, "x")) == [("a", at(0), 2), ("a", at(10), 1), ("b", at(30), 1), ("b", at(50), 1)]


def test_sessions(spark, tmp_path):
    def run(*rows):
        stream = sessions(put(spark, tmp_path, *rows), "ts", "10 minutes", "20 minutes", ["key"], F.count("*").alias("n"))
        run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted((r.key, r.begins, r.ends, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    run(("a", 0, "x"), ("a", 8, "x"), ("a", 20, "x"), ("b", 1, "x"))
    run(("a", 15, "joins two"), ("b", 60, "x"))
    assert run(("c", 200, "x")) == [("a", at(0), at(30), 4), ("b", at(1), at(11), 1), ("b", at(60), at(70), 1)]


def test_first_within(spark, tmp_path):
    def run(*rows):
        run_to_files(first_within(put(spark, tmp_path, *rows), "ts", "30 minutes", ["key"]), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted((r.key, r.ts) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run(("a", 1, "x"), ("a", 1, "x"), ("b", 2, "x")) == [("a", at(1)), ("b", at(2))]
    assert run(("a", 5, "again"), ("c", 100, "x")) == [("a", at(1)), ("b", at(2)), ("c", at(100))]
    assert run(("a", 101, "later"))[:2] == [("a", at(1)), ("a", at(101))]
