"""Line dedup: a suffix array over sequences of line ids by distributed prefix doubling.

A line's id is a 128-bit hash of its text. The suffixes are the lines of every document up to its
end; ids that occur once in the corpus end a run, so suffixes are kept only where a line occurs
again. Rank r_0 is the order of the ids; round k ranks the pairs (r_k of a line, r_k of the line 2^k
later), which is the order of runs of 2^(k+1) lines. Ranks keep order without any global step:
distinct pairs are range-partitioned and sorted, and the rank is partition and row number. Only
suffixes that share their rank with another go into the next round; rounds end when none does.

Suffixes that share a rank are a longest-common-prefix interval of that depth or more, and the
intervals of all depths are the tree. The rounds are then walked back, from the deepest: a line's run
grows by 2^k lines where an earlier place has the same run and the same 2^k lines after it. So each
line gets the exact length of the longest run from it that also starts earlier (``longest_runs``).
Runs inside the run of the line before are left out, which leaves the maximal ones. A maximal run of
``least`` lines and ``least_words`` words or more goes, so a short line goes with the run that it
belongs to and stays where it is repeated alone. Runs are judged on the input, and may overlap the
place they repeat; spans that overlap or touch are one run of the result.

In the walk back, places that have the same run so far are a class. Of those that agree on the next
2^k lines all but the first, by doc_id, text and line, grow; the first stays in its class and stands in
the new one as a witness. A place that grew is never missed by the class it left, as the first has the
same lines and is earlier. A class has one witness, so rows at most double.

DataFrame functions only: joins and aggregates on ranks, with counts added up before the shuffle;
a window runs only within a document. The first occurrence comes with the rank, and both from a
written table, so a hot line is a hot key of a join alone, which adaptive execution splits. Defined
cases: a null text is one empty line; lines without a word are not part of runs, but those inside a
deleted run go with it; rows with the same doc_id and text are one document and get the same result;
texts of one doc_id come in the order of their MD5; a null doc_id comes before all others; a very long
text is that many lines and is not cut; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.common import whole_text, written

_WORD = r"[^\x20\x09-\x0D]"
#: What tells documents apart: doc_id and 120 bits of the text's MD5.
ROW = ["doc_id", "_text0", "_text1"]


def _hashes(x: Column, name: str) -> list[Column]:
    return [F.xxhash64(x).alias(f"{name}0"), F.xxhash64(F.lit(1), x).alias(f"{name}1")]


def row_key() -> list[Column]:
    part = lambda at, name: F.conv(F.substring(F.md5(whole_text()), at, 15), 16, 10).cast("long").alias(name)
    return [F.col("doc_id").cast("long").alias("doc_id"), part(1, "_text0"), part(16, "_text1")]


def _words(line: Column) -> Column:
    """Words of a line that has one: the pattern counts them only where white space is not single spaces between words."""
    plain = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for space in ("  ", "\t", "\v", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(space))
    return F.when(odd, F.regexp_count(line, F.lit(_WORD + "+"))).otherwise(plain).cast("long")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """ROW, line_no (from 0, of the text), seq (of lines with a word), n_words and the line's id (two longs)."""
    lines = F.transform(F.split(whole_text(), "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    rows = docs.select(*row_key(), F.filter(lines, lambda x: F.rlike(x["line"], F.lit(_WORD))).alias("_lines"))
    lines = rows.select(*ROW, F.posexplode("_lines").alias("seq", "x")).select(*ROW, "seq", "x.line_no", "x.line")
    return lines.select(*ROW, "seq", "line_no", _words(F.col("line")).alias("n_words"), *_hashes(F.col("line"), "id"))


def _ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, less the rows whose keys no other row has: rank (the order of the keys, a long) instead of the keys, and whether a row is the first of its rank."""
    place = F.struct(*ROW, "seq")
    again = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n")
    ranks = written(again.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return df.join(ranks, keys).withColumn("first", place == F.col("_first")).drop(*keys, "_first")


def first_ranks(lines: DataFrame) -> DataFrame:
    """Lines that occur again: ROW, seq, line_no, last_line, n_words, rank (the order of their ids) and first."""
    # Ranks read the lines twice: texts are split and counted once, for a table of numbers.
    lines = written(lines, "lines")
    # Rows that repeat a document have the same lines at the same places.
    return written(_ranked(lines, ["id0", "id1"]).dropDuplicates([*ROW, "seq"]).withColumn("last_line", F.col("line_no")), "suffixes")


def _place(seq: Column) -> list[Column]:
    """A line's place, as a join key: null doc_ids equal each other here, as none of the values is null."""
    return [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("_text0").alias("_t0"), F.col("_text1").alias("_t1"), seq.alias("_at")]


_PLACE = ["_id", "_null", "_t0", "_t1", "_at"]


def longer_ranks(now: DataFrame, step: int) -> DataFrame:
    """A round: the ranks of runs that are ``step`` lines longer, of those that occur again.

    seq counts all lines with a word, so a run goes on only if the line ``step`` later is still here.
    n_words is that of the two runs, which is the longer run's where they do not overlap.
    """
    later = now.select(*_place(F.col("seq") - step), F.col("rank").alias("_next"), "last_line", F.col("n_words").alias("_more"))
    own = now.select(*_place(F.col("seq")), *ROW, "seq", "line_no", "n_words", F.col("rank").alias("_own"))
    pairs = own.join(later, _PLACE).withColumn("n_words", F.col("n_words") + F.col("_more")).drop(*_PLACE, "_more")
    return written(_ranked(pairs, ["_own", "_next"]), "suffixes")


def repeated_runs(lines: DataFrame, least: int = 2) -> DataFrame:
    """lines that start a run of ``least`` lines which occurs again, with rank: the run's place in suffix order.

    Each round doubles the length that ranks cover; the last one joins two overlapping runs.
    """
    if least < 1:
        raise ValueError("a run has one line at least")
    now, covered = first_ranks(lines), 1
    while covered < least:
        step = min(covered, least - covered)
        now, covered = longer_ranks(now, step), covered + step
    return now


def levels(lines: DataFrame, least: int) -> Iterator[tuple[int, DataFrame]]:
    """(depth, suffixes) at ``least`` lines and its doubles, until no run occurs again."""
    now, depth = repeated_runs(lines, least), least
    yield depth, now
    while not now.isEmpty():
        now, depth = longer_ranks(now, depth), depth * 2
        yield depth, now


def interval_tree(docs: DataFrame, least: int = 2) -> DataFrame:
    """The common-prefix intervals of the suffix array by depth: depth (in lines), rank, ROW, seq, first_line, last_line and first.

    Depths are ``least`` and its doubles, until no run occurs again; rows of one depth and rank are
    all occurrences of one run, and first marks the one that stays. What shares a rank at some depth
    is inside one interval of the depth before.
    """
    out = None
    for depth, now in levels(numbered_lines(docs), least):
        level = now.select(F.lit(depth).alias("depth"), "rank", *ROW, "seq", F.col("line_no").alias("first_line"), "last_line", "first")
        out = level if out is None else out.unionByName(level)
    return out


_RUN = [*ROW, "seq", "line_no", "last_line", "n_lines", "n_words", "own", "born", "class"]


def _grown(state: DataFrame, now: DataFrame, step: int) -> DataFrame:
    """A step back: runs of the state that grow by the ``step`` lines of now's ranks, and those that do not."""
    after = now.select(*_place(F.col("seq")), F.col("rank").alias("_next"), F.col("last_line").alias("_last"), F.col("n_words").alias("_more"))
    looked = written(state.select(*_place(F.col("seq") + F.col("n_lines")), *_RUN).join(after, _PLACE, "left").drop(*_PLACE), "looked")
    place, keys = F.struct(*ROW, "seq"), ["born", "class", "_next"]
    again = looked.where("_next IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n")
    classes = written(again.withColumn("_class", F.monotonically_increasing_id()), "classes")
    as_is = F.struct("last_line", "n_lines", "n_words", "own", "born", "class")
    longer = lambda own: F.struct(F.col("_last").alias("last_line"), (F.col("n_lines") + step).alias("n_lines"), (F.col("n_words") + F.col("_more")).alias("n_words"), F.lit(own).alias("own"), F.lit(2 * step + 1).cast("long").alias("born"), F.col("_class").alias("class"))
    to = F.when(F.col("_class").isNull(), F.array(as_is)).when(place == F.col("_first"), F.array(as_is, longer(False))).otherwise(F.array(longer(True)))
    return looked.join(classes, keys, "left").select(*ROW, "seq", "line_no", F.explode(to).alias("x")).select(*ROW, "seq", "line_no", "x.*").select(*_RUN)


def longest_runs(lines: DataFrame) -> DataFrame:
    """Lines that stood before: ROW, seq, line_no, last_line, n_lines and n_words of the longest run from there that also starts at an earlier place."""
    rounds = [now for _, now in levels(lines, 1)]  # of the last one no run occurs again
    runs = lambda df, k, own: df.select(*ROW, "seq", "line_no", "last_line", F.lit(1 << k).cast("long").alias("n_lines"), "n_words", F.lit(own).alias("own"), F.lit(2 << k).cast("long").alias("born"), F.col("rank").alias("class"))
    state = runs(rounds[-1], len(rounds) - 1, True)
    for k in reversed(range(len(rounds) - 1)):
        now, deeper = rounds[k], rounds[k + 1]
        # Where a longer run stood before, its line is in the state already.
        had = deeper.where("NOT first").select(*_place(F.col("seq")))
        fresh = written(now.where("NOT first").select("*", *_place(F.col("seq"))).join(had, _PLACE, "left_anti").drop(*_PLACE), "fresh")
        witnesses = now.where("first").join(fresh.select("rank").distinct(), "rank", "left_semi")
        grown = _grown(state, now, 1 << k) if k + 2 < len(rounds) else state
        state = written(grown.unionByName(runs(fresh, k, True)).unionByName(runs(witnesses, k, False)), "state")
    return state.where("own").drop("own", "born", "class")


def maximal_runs(docs: DataFrame, least: int = 1, least_words: int = 0) -> DataFrame:
    """Runs of ``least`` lines and ``least_words`` words or more that also start earlier, less those inside the run of the line before: ROW, seq, line_no, last_line, n_lines, n_words."""
    if least < 1:
        raise ValueError("a run has one line at least")
    within = Window.partitionBy(*ROW).orderBy("seq")
    runs = longest_runs(numbered_lines(docs)).withColumn("_end", F.col("seq") + F.col("n_lines")).withColumn("_before", F.lag("_end").over(within))
    return runs.where(F.col("_before").isNull() | (F.col("_before") < F.col("_end"))).where((F.col("n_lines") >= least) & (F.col("n_words") >= least_words)).drop("_end", "_before")


def duplicate_runs(docs: DataFrame, least: int = 1, least_words: int = 0) -> DataFrame:
    """What the maximal runs cover, merged: ROW, first_line, last_line (by text line), n_lines and depth (lines of the longest maximal run)."""
    within = Window.partitionBy(*ROW).orderBy("seq")
    reach = F.max(F.col("seq") + F.col("n_lines")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    island = maximal_runs(docs, least, least_words).withColumn("_new", F.coalesce(F.col("seq") > reach, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*ROW, "_run").agg(F.min("line_no").alias("first_line"), F.max("last_line").alias("last_line"), (F.max(F.col("seq") + F.col("n_lines")) - F.min("seq")).alias("n_lines"), F.max("n_lines").alias("depth"))


def remove_repeated_lines(docs: DataFrame, least: int = 1, least_words: int = 0) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, n_runs, depth (0: none) and kept (the text without later copies of runs)."""
    runs = duplicate_runs(docs, least, least_words).groupBy(*ROW).agg(F.flatten(F.collect_list(F.sequence("first_line", "last_line"))).alias("_gone"), F.sum("n_lines").alias("n_removed"), F.count("*").alias("n_runs"), F.max("depth").alias("depth"))
    texts = docs.select(*row_key(), F.split(whole_text(), "\n").alias("_lines"))
    n_lines = F.size(F.filter("_lines", lambda x: F.rlike(x, F.lit(_WORD)))).cast("long")
    told = runs.select(*(F.col(c).alias(f"_{c}") for c in ROW), "_gone", "n_removed", "n_runs", "depth")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW]
    df = texts.withColumn("n_lines", n_lines).join(told, same[0] & same[1] & same[2], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda i: F.get(F.col("_lines"), i)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return df.select("doc_id", "n_lines", zero("n_removed"), zero("n_runs"), zero("depth"), F.array_join(kept, "\n").alias("kept"))


#: A run of the query has this many words or more: shorter lines that are repeated alone stay.
LEAST_WORDS = 5

# Brute force: runs grow by one line as long as they occur again.
ORACLE = rf"""WITH RECURSIVE raw AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(t)) AS r, string_split(t, chr(10)) AS lines FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents)),
    l AS (SELECT *, list_filter(range(len(lines)), lambda i: regexp_matches(lines[i + 1], '{_WORD}')) AS places FROM raw),
    line AS (SELECT r, p, md5(x) AS x, len(regexp_extract_all(x, '{_WORD}+')) AS w FROM (SELECT r, unnest(range(1, len(places) + 1)) AS p, unnest(list_transform(places, lambda i: lines[i + 1])) AS x FROM l)),
    run AS (SELECT 1 AS n, r, p, x, w, count(*) OVER (PARTITION BY x) > 1 AS again, row_number() OVER (PARTITION BY x ORDER BY r, p) > 1 AS later FROM line
        UNION ALL SELECT a.n + 1, a.r, a.p, md5(a.x || b.x), a.w + b.w, count(*) OVER (PARTITION BY a.x, b.x) > 1, row_number() OVER (PARTITION BY a.x, b.x ORDER BY a.r, a.p) > 1 FROM run a JOIN line b ON b.r = a.r AND b.p = a.p + a.n WHERE a.again),
    longest AS (SELECT r, p, max(n) AS n, max(w) AS w FROM run WHERE later GROUP BY ALL HAVING max(w) >= {LEAST_WORDS}),
    gone AS (SELECT DISTINCT r, unnest(range(p, p + n)) AS p FROM longest),
    islands AS (SELECT r, min(p) AS a, max(p) AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM gone) GROUP BY r, g),
    spans AS (SELECT i.r, count(*) AS n_runs, sum(b - a + 1) AS n_removed, flatten(list(range(l.places[a]::BIGINT, l.places[b]::BIGINT + 1))) AS lost FROM islands i JOIN l ON l.r = i.r GROUP BY ALL),
    deep AS (SELECT r, max(n) AS depth FROM longest GROUP BY r)
    SELECT d.doc_id, len(l.places)::BIGINT AS n_lines, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_runs, 0)::BIGINT AS n_runs, coalesce(deep.depth, 0)::BIGINT AS depth,
        sha256(array_to_string(CASE WHEN s.lost IS NULL THEN l.lines ELSE list_transform(list_filter(range(len(l.lines)), lambda i: NOT list_contains(s.lost, i)), lambda i: l.lines[i + 1]) END, chr(10))) AS kept_sha256
    FROM documents d JOIN l ON l.doc_id IS NOT DISTINCT FROM d.doc_id AND l.t = coalesce(d.text, '') LEFT JOIN spans s ON s.r = l.r LEFT JOIN deep ON deep.r = l.r"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    got = remove_repeated_lines(table(spark, sf_dir, "documents"), least_words=LEAST_WORDS)
    return got.select("doc_id", "n_lines", "n_removed", "n_runs", "depth", F.sha2("kept", 256).alias("kept_sha256"))
