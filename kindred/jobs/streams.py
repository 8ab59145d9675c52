"""Queries that are streams over the events, run in three parts with a restart before each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.jobs.registry import query, table
from kindred.session import work_path
from kindred.sources.commits import Table
from kindred.streaming.state import run_last_values
from kindred.streaming.windows import run_to_files, sessions, tumbling

#: Events come in three parts by their time; every fifth by id comes a part later, and is late where its window has ended.
DAY = "day(ts)"
SQL_PARTS = f"e AS (SELECT *, least(CASE WHEN {DAY} <= 10 THEN 1 WHEN {DAY} <= 20 THEN 2 ELSE 3 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END, 3) AS part FROM events WHERE ts IS NOT NULL)"


def plain_times(df: DataFrame, *columns: str) -> DataFrame:
    """Times without a zone, as the events have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def in_parts(spark: SparkSession, sf_dir: str, run: Callable[[DataFrame], StreamingQuery], late: bool = True) -> None:
    """Write the events of each part to a folder, and run the stream over what is new there."""
    source, by_time = work_path(spark, "events"), F.when(F.dayofmonth("ts") <= 10, 1).when(F.dayofmonth("ts") <= 20, 2).otherwise(3)
    part = F.least(by_time + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0), F.lit(3)) if late else by_time
    events = table(spark, sf_dir, "events").where("ts IS NOT NULL").withColumns({"part": part, "ts": F.col("ts").cast("timestamp")})
    for n in (1, 2, 3):
        events.where(F.col("part") == n).drop("part").write.mode("append").parquet(source)
        run(spark.readStream.schema(events.drop("part").schema).parquet(source)).awaitTermination()


@query("event_windows", f"""WITH {SQL_PARTS}, w AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS begins FROM e),
m AS (SELECT part, max(ts) AS most FROM e GROUP BY part), marks AS (SELECT p.part, (SELECT max(most) FROM m WHERE m.part < p.part) - INTERVAL 2 DAYS AS mark FROM (SELECT 1 AS part UNION ALL SELECT 2 UNION ALL SELECT 3) p)
SELECT begins, begins + INTERVAL 6 HOURS AS ends, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w JOIN marks USING (part)
WHERE (mark IS NULL OR begins + INTERVAL 6 HOURS > date_trunc('milliseconds', mark)) AND begins + INTERVAL 6 HOURS <= date_trunc('milliseconds', (SELECT max(ts) FROM e) - INTERVAL 2 DAYS) GROUP BY ALL""")
def event_windows(spark, sf_dir):
    """Events and their values by kind in windows of six hours, rows that come over two days late left out, windows that are still open too."""
    path, state = work_path(spark, "windows"), work_path(spark, "state")
    in_parts(spark, sf_dir, lambda s: run_to_files(tumbling(s, "ts", "6 hours", "2 days", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total")), path, state))
    return plain_times(spark.read.parquet(path).withColumn("total", F.round("total", 2)), "begins", "ends")


@query("event_sessions", """WITH e AS (SELECT user_id, ts, value FROM events WHERE ts IS NOT NULL), g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS AS apart FROM e),
s AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g)
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 6 HOURS AS ends, count(*) AS n FROM s GROUP BY user_id, nth HAVING max(ts) + INTERVAL 6 HOURS <= date_trunc('milliseconds', (SELECT max(ts) FROM e) - INTERVAL 1 DAY)""")
def event_sessions(spark, sf_dir):
    """Sessions of each user, ended by six hours without an event; those that are still open are left out."""
    path, state = work_path(spark, "sessions"), work_path(spark, "state")
    in_parts(spark, sf_dir, lambda s: run_to_files(sessions(s, "ts", "6 hours", "1 day", ["user_id"], F.count("*").alias("n")), path, state), late=False)
    return plain_times(spark.read.parquet(path), "begins", "ends")


@query("state_changes", """WITH e AS (SELECT user_id::VARCHAR AS key, event_type AS value, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
c AS (SELECT *, coalesce(lag(value) OVER w <> value, true) AS changed FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, value))
SELECT key, arg_max(value, (ts, value)) AS value, max(ts) FILTER (changed) AS since, count(*) FILTER (changed) - 1 AS changes FROM c GROUP BY key""")
def state_changes(spark, sf_dir):
    """Each user's last kind of event, since when, and how often it changed, from a state store; only changed users are put."""
    path, state = work_path(spark, "values"), work_path(spark, "state")
    in_parts(spark, sf_dir, lambda s: run_last_values(s.select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("value")), path, state), late=False)
    held = Table(spark, path, "key", "changes").read("key string, value string, since timestamp, seen timestamp, changes long")
    return plain_times(held.drop("seen"), "since")
