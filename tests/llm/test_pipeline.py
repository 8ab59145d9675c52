"""The pipeline's stages against brute-force versions, each on its own input."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kindred.llm import quality_rules
from kindred.llm.common import written
from tests.llm.conftest import frame, prose
from tests.llm.test_operators import fingerprint, linked


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: good texts, junk, copies, leaks, labels and a benchmark."""
    at = tmp_path_factory.mktemp("sf")
    rows = [(i, prose(i, 60 + i)) for i in range(60)]
    rows += [(100 + i, " ".join(w + "$#" for w in prose(300 + i, 50).split())) for i in range(30)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, "short text"), (301, None), (302, ""), (None, prose(900, 70)), (303, rows[5][1] + "\n" + " ".join(prose(500, 30).split()))]
    frame(spark, rows).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(1, prose(500, 30)), (2, None)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, folder), name)
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name != "tokens":
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
        if name == "quality":
            kept = quality_rules.judged(before.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).where("kept")
            assert ids(docs) == ids(kept) and not [i for i in ids(docs) if i is not None and (100 <= i < 130 or i in (300, 301, 302))] and set(range(60)) <= set(ids(docs))
        if name == "near_dedup":
            first = {}
            for (d, _), r in zip(rows, linked([fingerprint(t) for _, t in rows])):
                first.setdefault(r, []).append(d)
            assert ids(docs) == sorted((min((x for x in g if x is not None), default=None) for g in first.values()), key=str) and not set(range(200, 210)) & set(ids(docs))
        if name == "decontamination":
            leak = " ".join(prose(500, 30).lower().split())
            assert ids(docs) == sorted((d for d, t in rows if leak not in " ".join(t.lower().split())), key=str) and 303 not in ids(docs)
        if name == "mixing":
            assert 0 < docs.count() <= before.count()
        if name == "tokens":
            encode, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode, 0, []
            for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
                own = [*encode(t or "", add_special_tokens=False).ids, 2]
                expected.append((d, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
                start += len(own)
            assert sorted(map(tuple, docs.collect()), key=lambda r: r[1]) == expected


def test_run_agrees_with_itself(spark, folder):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) for _ in range(2))
    assert a == b and a


def test_empty_documents(spark, folder, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
