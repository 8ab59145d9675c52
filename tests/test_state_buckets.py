"""Keyed state by buckets of keys: the same rows as key by key, and few calls."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd

from kindred.sources.commits import Table
from kindred.streaming.state import LastValue, run_last_values

START = datetime(2024, 5, 1)


class Held:
    """A list state in memory."""

    rows: list = []

    def getListState(self, name, schema):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def plain(batches):
    """Key by key: the state in the end, and the keys that each batch hands on."""
    state, handed = {}, []
    for batch in batches:
        changed = set()
        for k, ts, v in sorted(batch):
            value, since, seen, n = state.get(k, (None, None, None, -1))
            if seen is not None and ts < seen:
                continue
            if n < 0 or v != value:
                value, since, n = v, ts, n + 1
                changed.add(k)
            state[k] = (value, since, ts, n)
        handed.append(changed)
    return state, handed


def made(seed, n_batches=4):
    r = random.Random(seed)
    return [[(f"k{r.randrange(40)}", START + timedelta(microseconds=r.randrange(50) + 30 * b), r.choice("xyz")) for _ in range(60)] for b in range(n_batches)]


def test_one_bucket_against_key_by_key():
    for seed in range(30):
        held, one, batches = Held(), LastValue(), made(seed)
        one.init(held)
        state, handed = plain(batches)
        for batch, keys in zip(batches, handed):
            random.Random(1).shuffle(batch)
            parts = [pd.DataFrame(batch[a : a + 25], columns=["key", "ts", "value"]) for a in range(0, 60, 25)]
            out = list(one.handleInputRows((0,), iter(parts), None))
            assert {k for x in out for k in x["key"]} == keys and len(out) <= 1
        assert {k: (v, a, b, n) for k, v, a, b, n in held.rows} == state and len(held.rows) == len(state)


def test_stream_against_key_by_key(spark, tmp_path):
    table, batches = Table(spark, f"file://{tmp_path}/out", "key", "changes"), made(99, 3)
    for batch in batches:
        spark.createDataFrame(batch, "key string, ts timestamp, value string").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        run_last_values(spark.readStream.schema("key string, ts timestamp, value string").parquet(f"{tmp_path}/in"), table.path, f"{tmp_path}/state").awaitTermination()
    assert {r.key: (r.value, r.since, r.changes) for r in table.read().collect()} == {k: (v, a, n) for k, (v, a, _, n) in plain(batches)[0].items()}
