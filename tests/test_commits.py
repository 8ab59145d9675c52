"""Tables with commits: whatever step a write breaks off at, the old or the new table is there."""

from __future__ import annotations

import random

import pytest

from kindred.sources.commits import CommitConflict, Table

SCHEMA = "k long, v long, s string"


class Killed(Exception):
    pass


class Breaking(Table):
    """A table whose driver dies at the n-th step."""

    left = 99

    def _step(self, name):
        self.left -= 1
        if self.left < 0:
            raise Killed(name)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(table):
    return sorted(map(tuple, table.read(SCHEMA).collect()))


def test_never_written(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k", "v")
    assert not t.exists() and t.head() is None and held(t) == []
    with pytest.raises(ValueError):
        t.read()
    t.overwrite(rows(spark))
    assert t.exists() and held(t) == [] and t.read().columns == ["k", "v", "s"]


def test_upserts_merge_and_history(spark, tmp_path):
    t, r, expected = Table(spark, f"file://{tmp_path}/t", "k", "v", most_deltas=3), random.Random(2), {}
    for i in range(9):
        changes = {k: (k, r.randrange(4), f"{i}") for k in r.sample(range(6), 3)}
        t.upsert(rows(spark, *changes.values()))
        for k, c in changes.items():
            if k not in expected or c[1] >= expected[k][1]:
                expected[k] = c
        assert held(t) == sorted(expected.values()) and len(t.head().deltas) <= 3
    assert [x.note for x in t.history().orderBy("version").collect()].count("upsert and merge") == 2
    before = t.head().version
    t.merge()
    assert held(t) == sorted(expected.values()) and t.head().deltas == [] and t.head().version == before + 1
    assert held(t) == sorted(map(tuple, t.read(version=before).collect()))
    assert t.vacuum() > 0 and held(t) == sorted(expected.values()) and t.history().count() == 1


def test_ties_and_repeated_changes(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k", "v")
    t.upsert(rows(spark, (1, 1, "a"), (2, 5, "b"), (None, 1, "none")))
    t.upsert(rows(spark, (1, 1, "tie"), (2, 4, "older"), (3, 1, None), (3, 2, "x"), (3, 2, "y"), (None, 2, "null")))
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted([(1, 1, "tie"), (2, 5, "b"), (3, 2, "y"), (None, 2, "null")], key=str)


@pytest.mark.parametrize("action", ["overwrite", "upsert", "upsert and merge", "vacuum"])
def test_killed_at_each_step(spark, tmp_path, action):
    old = [(1, 1, "a"), (2, 1, "b")]
    changes = rows(spark, (2, 2, "c"), (3, 1, "d"))
    new = {"overwrite": [(2, 2, "c"), (3, 1, "d")], "vacuum": old}.get(action, [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")])
    broken = 0
    for n in range(20):
        t = Breaking(spark, f"file://{tmp_path}/t{n}", "k", "v", most_deltas=0 if action.endswith("merge") else 8)
        Table.overwrite(t, rows(spark, (1, 1, "x")))
        Table.overwrite(t, rows(spark, *old))
        t.left = n
        run = {"overwrite": lambda: t.overwrite(changes, "w", 7), "vacuum": t.vacuum}.get(action, lambda: t.upsert(changes, "w", 7))  # noqa: B023
        try:
            run()
        except Killed as e:
            broken += 1
            after = Table(spark, t.path, "k", "v")
            assert held(after) == (new if str(e) == "committed" else old)
            t.left = 99
            run()  # the driver comes again with the same epoch
            assert held(after) == new
            assert after.head().version == (2 if action == "vacuum" else 3)
            after.vacuum()
            assert held(after) == new and set(after._names("data")) == set(after.head().folders) and len(after._names("commits")) == 1
        else:
            assert held(Table(spark, t.path, "k", "v")) == new
            break
    assert broken >= 2


def test_epochs(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k", "v")
    t.upsert(rows(spark, (1, 1, "a")), "stream", 0)
    t.upsert(rows(spark, (1, 2, "b")), "stream", 1)
    version = t.head().version
    t.upsert(rows(spark, (1, 9, "again")), "stream", 0)
    t.upsert(rows(spark, (1, 9, "again")), "stream", 1)
    assert held(t) == [(1, 2, "b")] and t.head().version == version
    t.upsert(rows(spark, (2, 1, "other")), "another", 0)
    assert held(t) == [(1, 2, "b"), (2, 1, "other")]


def test_two_writers(spark, tmp_path):
    a = Table(spark, f"file://{tmp_path}/t", "k", "v")
    a.overwrite(rows(spark, (1, 1, "a")))

    class Slow(Table):
        def _step(self, name):
            if name == "manifest written":
                a.upsert(rows(spark, (2, 1, "first")))

    with pytest.raises(CommitConflict):
        Slow(spark, a.path, "k", "v").upsert(rows(spark, (3, 1, "second")))
    assert held(a) == [(1, 1, "a"), (2, 1, "first")]
    fs = a._at("")[1]
    fs.create(a._at("commits/new-x")[0], False).close()
    assert not a._renamed(fs, a._at("commits/new-x")[0], a._at(f"commits/{a.head().version:020d}")[0])  # a taken name stays


def test_missing_folder_is_an_error(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k", "v")
    t.upsert(rows(spark, (1, 1, "a")))
    t._delete(f"data/{t.head().folders[0]}")
    with pytest.raises(FileNotFoundError):
        t.read()
    with pytest.raises(FileNotFoundError):
        t.upsert(rows(spark, (2, 1, "b")))
