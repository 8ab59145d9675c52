"""Documents that share a doc_id, or have none, are kept or dropped row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import frame, prose


def test_near_dedup_by_row(spark):
    own = [prose(2000 + i, 80) for i in range(5)]
    rows = [(None, own[0]), (None, own[1]), (None, own[2]), (None, own[2]), (1, own[2]), (5, own[3]), (5, own[4]), (5, own[4]), (6, own[4])]
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, own[0]), (None, own[1]), (1, own[2]), (5, own[3]), (5, own[4])], key=str)


def test_decontamination_by_row(spark, tmp_path):
    own, leak = [prose(2100 + i, 60) for i in range(3)], prose(2200, 30)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, own[0]), (None, leak + " " + own[1]), (7, own[2]), (7, own[1] + " " + leak)]
    kept = corpus_pipeline.decontamination(spark, frame(spark, rows), str(tmp_path)).orderBy(F.col("doc_id").asc_nulls_first()).select("doc_id", "text").collect()
    assert list(map(tuple, kept)) == [(None, own[0]), (7, own[2])]


def test_columns_of_any_name_stay(spark, tmp_path):
    spark.createDataFrame([(1, "an item of the benchmark that no text holds at all, not even in part")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, prose(i, 60), i, -i, f"d{i}", 2) for i in range(6)] + [(10, prose(3, 60), 1, 2, "copy", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key long, _full long, _doc string, key int")
    near = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert near.columns == docs.columns and sorted(map(tuple, near.collect())) == sorted(rows[:6])
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted(rows)


def test_hot_and_missing_ids_are_dealt_to_many_parts(spark, tmp_path):
    import public_tokenizers

    from kindred.llm.token_output import digest_token_files, write_token_files

    docs = spark.createDataFrame([(None if i % 3 else 7 if i % 2 else i, prose(i, 30)) for i in range(600)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_token_files(docs, f"{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [r.n for r in spark.read.parquet(f"{tmp_path}/t").selectExpr("shard", "size(doc_ids) AS n").groupBy("shard").sum("n").toDF("shard", "n").collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 600 / 4
    assert digest_token_files(spark, f"{tmp_path}/t").count() == 600
