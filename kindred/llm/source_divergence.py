"""Source divergence audit: terms of (lang, source) groups compared on a k2-tree of their counts.

The terms that a language keeps form a matrix with a row for each of its sources and a column for
each term. It is dealt into blocks of columns by a hash of the term; in a block the matrix is a
k2-tree (k = 2): a square is split into four quadrants, a bit says which hold a count, and only
these are split again, so that a place in the tree is found by counting bits. All pairs of rows go
down their trees together: a quadrant that is empty for both is priced at once, its columns times the
difference of the two probabilities that a count of zero gives; what is left at the leaves is
priced term by term. Sums of blocks are added by pair in Spark.

Counts of (lang, source, term) are summed in the tasks that read texts, then by Spark. Probabilities
are integers in units of 1e-9, from decimals of 38 digits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.common import slices, whole_text, written

#: Letters of ASCII and all bytes of characters beyond it.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST_DOCUMENTS, TOP, SMOOTHING, UNIT = 30, 50, 5, 1_000_000_000
#: Counted terms a task holds before it hands them on; cells of a block; rows of a block, squared for pairs; places on one level.
HELD, CELLS, ROWS, PLACES = 300_000, 250_000, 512, 1 << 17


class K2Tree:
    """The cells (row, column) of a matrix, as a square of ``size`` or more: a level of quadrant bits after another, and the values by their leaf."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, size: int):
        self.height = max(1, (size - 1).bit_length())
        code = np.zeros(len(row), np.int64)  # the quadrants on the way to a cell, two bits each
        for bit in range(self.height - 1, -1, -1):
            code = (code << 2) | ((row >> bit & 1) << 1) | (column >> bit & 1)
        order = np.argsort(code)
        code, self.value = code[order], value[order]
        self.levels, parents = [], np.zeros(1, np.int64) if len(code) else code
        for level in range(self.height):
            nodes = np.unique(code >> 2 * (self.height - 1 - level))
            bits = np.zeros(4 * len(parents), bool)
            bits[4 * np.searchsorted(parents, nodes >> 2) + (nodes & 3)] = True
            self.levels.append((bits, np.cumsum(bits) - 1))  # the child of a set bit is the one of its rank
            parents = nodes

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The nodes in a quadrant of nodes of a level; -1 where it, or the node, is empty."""
        bits, rank = self.levels[level]
        at = np.maximum(4 * node + quadrant, 0)
        return np.where((node >= 0) & bits[at], rank[at], -1)


def pair_sums(tree: K2Tree, zero: np.ndarray, columns: int, first: np.ndarray, second: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The sum over all columns of the difference between rows first and second; ``zero`` is the value of an empty cell by row.

    A level is left in parts of at most ``places`` places, so that a few parts for each level are open at a time.
    """
    sums, apart, most = np.zeros(len(first), np.int64), np.abs(zero[first] - zero[second]), tree.height
    if not len(tree.value):
        return apart * columns
    waiting = [(0, p, np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)) for p in _parts(np.arange(len(first)), places)]
    while waiting:
        level, pair, a, b, column = waiting.pop()
        shift = most - level - 1
        sides = []
        for half in (0, 1):
            start = column + (half << shift)
            left, right = (tree.child(level, node, ((rows[pair] >> shift & 1) << 1) | half) for node, rows in ((a, first), (b, second)))
            width = np.clip(columns - start, 0, 1 << shift)
            held = (left >= 0) | (right >= 0)
            bare = ~held
            sums += _exact(pair[bare], apart[pair[bare]] * width[bare], len(sums))
            if level + 1 < most:
                sides.append((pair[held], left[held], right[held], start[held]))
            else:
                own, left, right = pair[held], left[held], right[held]
                x = np.where(left >= 0, tree.value[left], zero[first[own]])
                y = np.where(right >= 0, tree.value[right], zero[second[own]])
                sums += _exact(own, np.abs(x - y), len(sums))
        if sides:
            pair, a, b, column = (np.concatenate(x) for x in zip(*sides))
            waiting += [(level + 1, pair[p], a[p], b[p], column[p]) for p in _parts(np.arange(len(pair)), places)]
    return sums


def _parts(at: np.ndarray, most: int) -> list[np.ndarray]:
    return np.array_split(at, -(-len(at) // most)) if len(at) else []


def _exact(place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place, as bincount but without doubles."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, value)
    return out


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and n_docs (documents that hold it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, n_docs) in held.items():
                if n:
                    same = pa.array(np.zeros(len(n), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(same), pa.array([source]).take(same), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([n_docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "n_docs"])
            held.clear()

        for batch in batches:
            for part in slices(batch, 2):
                texts = pc.ascii_lower(part.column(2)).cast(pa.binary()).to_pylist()
                for key, text in zip(zip(part.column(0).to_pylist(), part.column(1).to_pylist()), texts):
                    terms = TERM.findall(text)
                    if terms:
                        n, n_docs = held.setdefault(key, (Counter(), Counter()))
                        n.update(terms)
                        n_docs.update(set(terms))
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), whole_text().alias("text"))
    found = rows.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (count + SMOOTHING) / (total + SMOOTHING terms)), exactly; null where there are no terms."""
    over = f"cast({UNIT} AS decimal(10,0)) * cast({count} + {SMOOTHING} AS decimal(19,0))"
    return F.expr(f"1 + ({over}) div nullif(cast({total} + {SMOOTHING} * {terms} AS decimal(19,0)), 0)").cast("long")


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Counts of the terms that ``least`` documents of a language hold: lang, source, term, n, n_lang and, once for each term, opens."""
    own = Window.partitionBy("lang", "term")  # a row for each source
    every = term_counts(docs).withColumns({"n_lang": F.sum("n").over(own), "_docs": F.sum("n_docs").over(own), "_least": F.min("source").over(own)})
    return every.where(F.col("_docs") >= least).select("lang", "source", "term", "n", "n_lang", (F.col("source") == F.col("_least")).alias("opens"))


def group_table(docs: DataFrame, kept: DataFrame, cells: int = CELLS) -> DataFrame:
    """A row for each (lang, source) of docs: its number in the language, counts, the probability of a count of zero, and the language's blocks."""
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"), F.sum(F.col("opens").cast("long")).alias("opened"))
    of_lang = Window.partitionBy("lang")  # a row for each source
    out = every.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "cells", "opened"])
    out = out.withColumns({"place": F.row_number().over(of_lang.orderBy("source")) - 1, "n_groups": F.count("*").over(of_lang), "n_terms": F.sum("opened").over(of_lang), "total_lang": F.sum("total").over(of_lang), "blocks": F.ceil(F.sum("cells").over(of_lang) / F.lit(cells)).cast("int")})
    return out.withColumn("zero", probability("0L", "total", "n_terms")).drop("cells", "opened")


def block_sums(kept: DataFrame, groups: DataFrame, rows: int = ROWS) -> DataFrame:
    """lang, a, b (numbers of sources, a < b), value and terms: sums by pair over the terms of a block.

    Of a block come the terms that its sources have; the others are empty columns.
    Where a language has more than ``rows`` sources, these are dealt into parts, and each pair of
    parts is a task of its own.
    """
    part, parts = F.floor(F.col("place") / rows).cast("int"), F.ceil(F.col("n_groups") / F.lit(rows)).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other")

    def dealt(df: DataFrame, *columns: str) -> DataFrame:
        keyed = df.withColumn("_part", part).select("*", other)
        named = (F.col(c).alias(c) for c in ("lang", "block", *columns))  # columns of its own on each side of the cogroup
        return keyed.select(*named, F.least("_part", "_other").alias("left"), F.greatest("_part", "_other").alias("right"))

    numbered = kept.join(groups.select("lang", "source", "place", "n_groups", "total", "n_terms", "blocks"), ["lang", "source"])
    cells = dealt(numbered.withColumns({"block": F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"), "p": probability("n", "total", "n_terms")}), "place", "term", "p")
    ends = dealt(groups.where("n_terms > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "place", "zero")
    keys = ["lang", "block", "left", "right"]

    def compare(held: pa.Table, of: pa.Table) -> pa.Table:
        at = of.column("place").to_numpy()
        order = np.argsort(at)
        at, zero = at[order], of.column("zero").to_numpy()[order]
        left, right = of.column("left")[0].as_py(), of.column("right")[0].as_py()
        term = held.column("term").combine_chunks().dictionary_encode() if held.num_rows else pa.array([], pa.string()).dictionary_encode()
        term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
        tree = K2Tree(np.searchsorted(at, held.column("place").to_numpy()), term.indices.to_numpy().astype(np.int64), held.column("p").to_numpy(), max(len(at), len(term.dictionary)))
        if left == right:
            first, second = np.triu_indices(len(at), 1)
        else:
            low, high = np.flatnonzero(at // rows == left), np.flatnonzero(at // rows == right)
            first, second = np.repeat(low, len(high)), np.tile(high, len(low))
        value = pair_sums(tree, zero, len(term.dictionary), first, second)
        lang = pa.array([of.column("lang")[0].as_py()]).take(pa.array(np.zeros(len(first), np.int32)))
        return pa.table([lang, pa.array(at[first], pa.int32()), pa.array(at[second], pa.int32()), pa.array(value), pa.array(np.full(len(first), len(term.dictionary)))], names=["lang", "a", "b", "value", "terms"])

    return cells.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInArrow(compare, "lang string, a int, b int, value long, terms long")


def divergence_audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair`` has every other source of the language with the sum of the differences over all
    kept terms; part ``term`` the ``top`` terms that are likelier in the group than in its language.
    Null texts, languages and sources are empty strings, each a value like others; a group without
    terms is compared by the probabilities of zero counts; in a language that keeps no terms all
    values are 0. Every row is a document, whatever its doc_id; other columns are not read; an
    empty table gives no rows. Ties are ordered by the item's bytes.
    """
    kept = written(kept_counts(docs, least), "kept-counts")
    groups = written(group_table(docs, kept, cells), "groups")
    sums = block_sums(kept, groups, rows).groupBy("lang", "a", "b").agg(F.sum("value").alias("held"), F.sum("terms").alias("terms"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "held", "terms"))
    own = groups.select("lang", "source", "n_terms", F.col("place").alias("a"), F.col("zero").alias("_own"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("zero").alias("_other"))
    pairs = own.join(other, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")  # a row of the result for each
    empty = (F.col("n_terms") - F.coalesce("terms", F.lit(0))) * F.abs(F.col("_own") - F.col("_other"))
    value = F.coalesce("held", F.lit(0)) + F.coalesce(empty, F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    likelier = kept.join(groups, ["lang", "source"]).withColumns({"_p": probability("n", "total", "n_terms"), "_q": probability("n_lang", "total_lang", "n_terms")}).where("_p > _q")
    terms = likelier.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("_p") - F.col("_q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    return divergence_audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
of_lang AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, k.n AS n_lang, coalesce(c.n, 0) AS n
          FROM g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)) // (s.total + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (c.n_lang + 5)) // (o.total + 5 * v)::HUGEINT AS q
      FROM cells c JOIN sums s USING (lang, source) JOIN of_lang o USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
