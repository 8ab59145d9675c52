"""The scan of pages: whole catalogs, and pages that are missing, cut off or of another shape."""

from __future__ import annotations

import json

import pytest

from kindred.operators import corpus as ops
from kindred.sources.pages import scan_pages


def catalog(at, pages: dict[int, str]):
    for n, text in pages.items():
        (at / f"page={n}").mkdir()
        (at / f"page={n}" / "part-0.txt").write_text(text)
    return f"file://{at}"


def page(n, size=3, total=8):
    return json.dumps({"total": total, "rows": [{"id": i, "name": f"n{i}"} for i in range(n * size, min(total, (n + 1) * size))]})


@pytest.mark.parametrize("change, n_rows", [({}, 8), ({1: "{"}, 3), ({2: "[]"}, 6), ({0: ""}, 0), ({2: '{"total": 8}'}, 6), ({1: None}, 3), ({0: None}, 0), ({0: '{"total": 0, "rows": []}'}, 0)])
def test_scan(spark, tmp_path, change, n_rows):
    pages = {n: change.get(n, page(n)) for n in range(3)}
    path = catalog(tmp_path, {n: x for n, x in pages.items() if x is not None} | {7: page(0)})  # beyond the total
    got = scan_pages(spark, path, "id long, name string").collect()
    assert sorted(map(tuple, got)) == [(i, f"n{i}") for i in range(n_rows)]


def test_one_partition_a_page(spark, tmp_path):
    path = catalog(tmp_path, {n: page(n) for n in range(3)})
    assert scan_pages(spark, path, "id long").rdd.getNumPartitions() == 3
    assert scan_pages(spark, f"file://{tmp_path}/none", "id long").count() == 0


def test_many_pages_share_partitions(spark, tmp_path):
    pages = {n: page(n, 3, 33) for n in range(11)}
    got = scan_pages(spark, catalog(tmp_path, pages), "id long, name string", partitions=4)
    assert sorted(r.id for r in got.collect()) == list(range(33)) and got.rdd.getNumPartitions() == 4
    (tmp_path / "page=7" / "part-0.txt").write_text("{")
    assert sorted(r.id for r in scan_pages(spark, f"file://{tmp_path}", "id long", partitions=4).collect()) == list(range(21))


def test_publish_is_refused_without_vectors(spark):
    staged, vectors = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(1,), (1,)], "k long")
    with pytest.raises(KeyError, match="k = 2"):
        ops.published_complete(staged.limit(0), staged, vectors, "k")
    done = ops.published_complete(staged.where("k = 2"), staged.where("k = 1"), vectors, "k")
    assert sorted(map(tuple, done.collect())) == [(1, "a"), (2, "b")]
