"""A corpus pipeline: quality rules, near-dedup, decontamination, mixing and token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of docs, whatever they are. A document that a stage drops is gone for those after it:

quality          the base rules and a decision list learned from labels reject documents
near_dedup       SimHash groups, and MinHash bands for what lies beyond their radius, give candidates; of texts
                 linked by an exact similarity of 0.8 (five-word shingles) the first document stays
decontamination  documents with a window similar to a benchmark item go
mixing           documents are drawn with probabilities raked to source, language and topic targets
tokens           ids are written as Simple-8b files in doc_id order; a row for each document is read back

Nulls: a null text is empty (and fails the base rules); a document without a doc_id comes after all
others. Rows with the same doc_id and text are one document from near_dedup on; different texts that
share a doc_id, or have none, are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import scratch_path, written
from kindred.llm.decontamination import contaminated
from kindred.llm.near_copies import near_copies
from kindred.llm.quality_rules import judged
from kindred.llm.registry import table
from kindred.llm.source_mixing import sampled_rows
from kindred.llm.token_output import digest_token_files, write_token_files
from kindred.session import ship

#: The share of all tokens that mixing draws, in expectation.
DRAWN_SHARE = 0.8

ORACLE_SQL = None  # stages learn, hash and draw; tests hold them against brute-force versions


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The row travels as a struct, so that no column of it meets one of the statistics.
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))
    return judged(rows, table(spark, sf_dir, "labels")).where("kept").select("_doc.*")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """_doc (the whole row, so that no column of it meets those added here), _key (of doc_id and text, which may be missing or repeat) and _full (of all columns)."""
    return docs.select(F.struct(*docs.columns).alias("_doc"), F.xxhash64("doc_id", "text").alias("_key"), F.xxhash64(*sorted(docs.columns)).alias("_full"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with the same doc_id and text, the one stays whose other columns have the lesser hash."""
    ship(spark)
    keyed = keyed_rows(docs)
    ids = keyed.groupBy(F.col("_key").alias("key")).agg(F.first("_doc.doc_id").alias("doc_id"), F.min("_full").alias("_full"))
    groups = near_copies(keyed.select(F.col("_key").alias("key"), F.col("_doc.text").alias("text"))).join(ids, "key")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "_full")).alias("_first")).select(F.col("_first.key").alias("_key"), F.col("_first._full").alias("_full"))
    return keyed.join(first, ["_key", "_full"], "left_semi").dropDuplicates(["_key"]).select("_doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    keyed = keyed_rows(docs)
    found = contaminated(keyed.select(F.col("_key").alias("doc_id"), F.col("_doc.text").alias("text")), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(found, "_key", "left_anti").select("_doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sampled_rows(docs, share=DRAWN_SHARE).where("drawn").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return digest_token_files(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
