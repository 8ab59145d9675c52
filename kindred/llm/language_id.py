"""Language ID with a language-bitmask n-gram filter.

Texts are lowered, all that is no letter becomes a space, and the UTF-8 bytes are read as runs of
four. Over all training texts Spark counts each run by language. A language holds a run if it
has it at least ``least`` times and at a tenth or more of the rate of the language that has it
most. Held runs go into bit-sliced Bloom filters: one table for each of two hash functions, a
bitmask of languages in every slot, so that one probe of both returns all languages that hold a
run. A text's languages are ranked by how many of its runs they hold, less what false positives
add at the filter's fill.

The filter has a fixed size for each 63 languages (two tables of ``slots`` masks, a word for each
63 languages), which bounds what the driver gathers and broadcasts. Defined cases: a text that is
null or has no letter (Unicode's L) is ``und`` with score 0, as is every text if there is nothing to
learn from; a text of one letter has runs with the spaces around it; ties, and texts of which no
language holds a run, go to the first language in order; repeated rows are predicted each; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import slices, whole_text, written
from kindred.llm.repeats import mixed

SLOTS = 1 << 20
UNKNOWN = "und"
#: Languages in a word of a mask; the sign is left alone.
WORD_LANGS = 63
_LETTER = regex.compile(r"\p{L}")
_NO_LETTER = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SPACES = int.from_bytes(b"    ", "little")


def _runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of four bytes of texts that have a letter, and the text of each."""
    parts = [(b"  " + t.lower().encode().translate(_NO_LETTER) + b" ") if t and _LETTER.search(t) else b"" for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(flat) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    runs = flat[:-3] | flat[1:-2] << np.uint32(8) | flat[2:-1] << np.uint32(16) | flat[3:] << np.uint32(24)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    good = (owner[:-3] == owner[3:]) & (runs & np.uint32(0xFFFFFF) != np.uint32(_SPACES & 0xFFFFFF)) & (runs >> np.uint32(8) != np.uint32(_SPACES & 0xFFFFFF))
    return runs[good], owner[:-3][good]


def _slots(runs: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(runs.astype(np.uint64))
    return (h % np.uint64(slots)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def count_runs(texts: DataFrame) -> DataFrame:
    """lang, run and n over all rows of texts (lang, text); added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4_000_000):
                langs = part.column(0).to_pylist()
                names = sorted(set(langs))
                runs, owner = _runs(part.column(1).to_pylist())
                code = np.array([names.index(x) for x in langs], np.uint64)
                keys, n = np.unique(code[owner] << np.uint64(32) | runs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[(keys >> np.uint64(32)).astype(np.int64)], pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "run", "n"])

    return texts.mapInArrow(run, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def learn_filter(training: DataFrame, least: int = 3, share: float = 0.1, slots: int = SLOTS) -> tuple[list[str], np.ndarray]:
    """The languages and the two tables of masks, learned from training (lang, text)."""
    counts = written(count_runs(training.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string"), whole_text().alias("text"))), "runs")
    totals = sorted((r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())  # one row for each language
    langs = [lang for lang, _ in totals]
    words = max(1, -(-len(langs) // WORD_LANGS))
    tables = np.zeros((2, slots, words), np.uint64)
    if not langs:
        return langs, tables
    known = training.sparkSession.createDataFrame([(lang, float(n), i // WORD_LANGS, 1 << i % WORD_LANGS) for i, (lang, n) in enumerate(totals)], "lang string, total double, word int, bit long")
    rated = counts.join(F.broadcast(known), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = counts.join(F.broadcast(known), "lang").groupBy("run").agg(F.max(F.col("n") / F.col("total")).alias("most"))
    held = rated.join(best, "run").where((F.col("n") >= least) & (F.col("rate") >= share * F.col("most"))).groupBy("run", "word").agg(F.bit_or("bit").alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at in enumerate(_slots(batch.column(0).to_numpy().astype(np.uint32), slots)):
                yield pa.RecordBatch.from_arrays([pa.array((at + i * slots) * words + batch.column(1).to_numpy()), batch.column(2)], ["slot", "mask"])

    got = held.select("run", "word", "mask").mapInArrow(place, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2 * slots * words rows at most
    tables.reshape(-1)[got.column("slot").to_numpy()] = got.column("mask").to_numpy().astype(np.uint64)
    return langs, tables


def predict(docs: DataFrame, langs: list[str], tables: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score."""
    slots = tables.shape[1]
    known = docs.sparkSession.sparkContext.broadcast(tables)  # of fixed size
    of = [(i // WORD_LANGS, np.uint64(i % WORD_LANGS)) for i in range(len(langs))]
    false = [float(np.prod([(t[:, w] >> i & np.uint64(1)).mean() for t in tables])) for w, i in of]
    names = np.array([*langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                runs, owner = _runs(part.column(2).to_pylist())
                a, b = _slots(runs, slots)
                masks = known.value[0][a] & known.value[1][b]
                total = np.bincount(owner, minlength=part.num_rows)
                score = np.zeros((part.num_rows, len(langs) + 1))
                for i, (w, bit) in enumerate(of):
                    hit = np.bincount(owner, (masks[:, w] >> bit & np.uint64(1)).astype(np.float64), part.num_rows)
                    score[:, i] = np.clip((hit - false[i] * total) / max(1e-9, 1 - false[i]), 0, None) / np.maximum(total, 1)
                best = np.where(total > 0, score[:, : max(1, len(langs))].argmax(axis=1), len(langs))
                top = score[np.arange(part.num_rows), best]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names[best], pa.string()), pa.array(np.clip(top, 0.0, 1.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), whole_text().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    docs = table(spark, sf_dir, "documents")
    return predict(docs, *learn_filter(docs.where(~F.coalesce(held_out(), F.lit(False)))))
