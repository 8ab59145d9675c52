"""Exact nearest neighbours for query sets of any size: cells around pivots, and blocks of queries against blocks of rows.

Rows are dealt to the cell of their nearest pivot. By the triangle inequality on angles a row of a
cell is no nearer to a query than the query's angle to the pivot differs from what the cell's rows have; a
query first looks at one block of its own cell, whose k-th best is a bound, and then only asks cells
that may hold something better. A task meets one block of queries with one block of rows, both of at
most about ``block`` vectors, so what it holds depends neither on the number of queries nor of rows.

Only the pivots (``pivots`` rows at most) and a line for each cell pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.vectors import _unit, cosine_scores, ranked
from kindred.session import work_path

#: Cosines are compared with bounds less this, as sums end in other last bits.
SLACK = 1e-9


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _angles(v: pa.Array, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(v) @ pivots.T, -1, 1))


def _best(queries: pa.Table, rows: pa.Table, k: int, tile: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """q, c and cosine of the k best rows of each query; of equal scores the k least ids are enough."""
    rows = rows.sort_by("id")
    q, c = queries.column("id").to_numpy(), rows.column("id").to_numpy()
    if not len(q) or not len(c):
        return
    qv, cv = _unit(queries.column("v")), _unit(rows.column("v"))
    step = max(1, tile // len(c))
    for at in range(0, len(q), step):
        score = qv[at : at + step] @ cv.T
        keep = q[at : at + step, None] != c[None, :]
        if len(c) > k:
            bound = np.partition(np.where(keep, score, -2), -k, axis=1)[:, -k]
            tied = keep & (np.abs(score - bound[:, None]) <= SLACK)
            keep &= score >= bound[:, None] - SLACK
            for own in np.flatnonzero(tied.sum(axis=1) > 2 * k):  # as in a group of equal rows
                at_bound = np.flatnonzero(tied[own])
                order = np.argsort(score[own, at_bound], kind="stable")
                same = score[own, at_bound][order]
                place = np.arange(len(same)) - np.searchsorted(same, same)
                keep[own, at_bound[order[place >= k]]] = False
        i, j = np.nonzero(keep)
        yield q[at + i], c[j], score[i, j]


def nearest(queries: DataFrame, rows: DataFrame, k: int, pivots: int = 64, block: int = 8192) -> DataFrame:
    """q, c and cosine of at least the k best other rows of every query; both have id (unique) and v (array of floats).

    What each block has of its own best comes too; ``ranked`` cuts it. Rows and
    queries without a vector are left out; a vector of zeros has a cosine of 0 with all.
    """
    spark = rows.sparkSession
    rows, queries = (df.select("id", "v").where("id IS NOT NULL AND v IS NOT NULL") for df in (rows, queries))
    chosen = _unit(rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toArrow().column("v").combine_chunks())
    if not len(chosen):
        return spark.createDataFrame([], "q long, c long, cosine double")
    known = spark.sparkContext.broadcast(chosen)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = _angles(batch.column(1), known.value)
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell])], ["id", "v", "cell", "angle"])

    placed = _written(rows.mapInArrow(place, f"id long, v {dict(rows.dtypes)['v']}, cell int, angle double"), "cells")
    cells = sorted(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect())
    name, n, low, high = (np.array(x) for x in zip(*cells))
    chunks = -(-n // block)
    of_cell = spark.sparkContext.broadcast((name, chunks, low, high))
    n_parts = max(1, -(-queries.count() // block))
    many = F.get(F.array(*(F.lit(int(x)) for x in np.bincount(name, chunks, len(chosen)))), F.col("cell"))
    dealt = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id"), many).cast("int").alias("chunk"))
    asked = queries.select("id", "v", F.pmod(F.hash("id"), F.lit(n_parts)).alias("part"))
    kind = dict(queries.dtypes)["v"]

    def ask(bounded: bool):
        """Each query with the blocks it has to see: one of its own cell, or all that its bound does not rule out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, many, least, most = of_cell.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    angle = _angles(part.column(1), known.value)[:, own]
                    if bounded:
                        apart = np.maximum(0, np.maximum(angle - most, least - angle))
                        at_best = np.where(apart > 1e-9, np.cos(np.minimum(apart, np.pi)), 1.0)
                        i, j = np.nonzero(at_best >= part.column(3).to_numpy()[:, None] - SLACK)
                        i, j, chunk = np.repeat(i, many[j]), np.repeat(j, many[j]), np.concatenate([np.arange(x) for x in many[j]] or [np.zeros(0, int)])
                    else:
                        i, j = np.arange(len(angle)), angle.argmin(axis=1)
                        chunk = np.zeros(len(i), int)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), part.column(2).take(pa.array(i)), pa.array(own[j], pa.int32()), pa.array(chunk, pa.int32())], ["id", "v", "part", "cell", "chunk"])

        return run

    def compared(asking: DataFrame, against: DataFrame) -> DataFrame:
        def compare(a: pa.Table, b: pa.Table) -> pa.Table:
            found = list(_best(a, b, k))
            q, c, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            return pa.table([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(score)], names=["q", "c", "cosine"])

        keys = ["cell", "chunk", "part"]
        for_parts = against.select("id", "v", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
        return asking.groupBy(*keys).cogroup(for_parts.groupBy(*keys)).applyInArrow(compare, "q long, c long, cosine double")

    schema = f"id long, v {kind}, part int, cell int, chunk int"
    first = compared(asked.mapInArrow(ask(False), schema), dealt.where("chunk = 0"))
    # The k-th best of one block bounds the k-th best of all; fewer than k give no bound.
    bounds = first.groupBy("q").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("s")).select(F.col("q").alias("id"), F.get("s", F.lit(k - 1)).alias("bound"))
    bounded = asked.join(bounds, "id", "left").select("id", "v", "part", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
    return compared(_written(bounded, "bounds").mapInArrow(ask(True), schema), dealt)


def top_neighbours(queries: DataFrame, rows: DataFrame, k: int, broadcast_bytes: int = 64_000_000, **options) -> DataFrame:
    """q, c, cosine and rank of the k best other rows of every query, by cosine to nine places, then id.

    Queries whose vectors take ``broadcast_bytes`` at most are sent to all tasks, which scan the rows
    once; more are dealt in blocks (``nearest``). Both give the same rows.
    """
    size = queries.select(F.sum(F.size("v") * 8).alias("b")).first()["b"] or 0
    near = cosine_scores(queries, rows, top=k) if size <= broadcast_bytes else nearest(queries, rows, k, **options)
    return ranked(near, "cosine", k)
