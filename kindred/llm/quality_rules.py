"""Quality rules: text statistics and a decision list learned from labelled ones.

Sequential covering: a rule is a conjunction of thresholds on statistics. It grows by the
condition of highest information gain, counted by Spark over the labelled statistics, and is then
pruned from the end on rows that did not grow it. The rows it covers go, and the next rule is
learned on what is left. The list becomes one Spark ``when`` chain. Everything is DataFrame and
SQL functions; the driver sees only counts by feature, bin and label.

Defined cases: a null text is empty; an empty table gives no rows; without labels of both kinds
the list is empty and only the base rules decide; rows with the same doc_id are judged each by
its own text; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import whole_text, written

#: White space of the word pattern, and the characters that count as symbols.
SPACES = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "mark_rate", "line_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words and the rates of FEATURES."""
    t = whole_text(text)
    has_word = lambda x: F.rlike(x, F.lit(f"[^{SPACES}]"))
    count = lambda chars: F.regexp_count(t, F.lit(f"[{chars}]")).cast("long")
    df = docs.withColumns({
        "_words": F.array_remove(F.split(t, f"[{SPACES}]+"), ""),
        "_lines": F.filter(F.split(t, "\n"), has_word),
        "word_chars": F.length(t) - count(SPACES),
        "n_symbols": count(SYMBOLS),
        "_marks": count(".,;:!?"),
    })
    n = F.size("_words")
    df = df.withColumns({
        "n_words": n.cast("long"),
        "_windows": F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<long>")),
        "_distinct": F.size(F.array_distinct("_words")),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines"),
    }).drop("_words", "_lines")
    # Only texts with some window twice sort their windows; places of repeated ones, then the words they cover.
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    same = lambda x, i: F.coalesce(x["h"] == F.get(F.col("_sorted"), i)["h"], F.lit(False))
    df = df.withColumn("_places", F.sort_array(F.filter(F.transform("_sorted", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])), lambda p: p.isNotNull()))).drop("_sorted")
    steps = F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), i + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_places")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    counts = {k: F.col(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    rates = {
        "mean_word": share("word_chars", "n_words"), "symbol_rate": share("n_symbols", "word_chars"), "dup_line_rate": share("n_dup_lines", "_n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"), "distinct_rate": share("_distinct", "n_words"), "mark_rate": share("_marks", "n_words"), "line_words": share("n_words", "_n_lines"),
    }
    # A generator between the statistics and what filters on them: a filter pushed below would work them out anew.
    one = F.struct(*(c.alias(k) for k, c in (counts | rates).items()))
    return df.select(*docs.columns, F.inline(F.array(one)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """The statistics and label of at most ``most_labels`` labelled documents, those of lowest hash.

    A document with several labels counts as good if all of them say so.
    """
    sample = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good"))
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most_labels))
    picked = docs.select(F.col("doc_id"), whole_text().alias("text")).join(F.broadcast(sample), "doc_id")
    return with_statistics(picked).where(~base_failed()).select("_good", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0).alias("_prune"), *FEATURES)


def learn_rules(labelled: DataFrame, features: tuple[str, ...] = FEATURES, bins: int = 24, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, least: int = 8) -> list[Rule]:
    """An ordered list of rules that reject: each covers mostly rows whose _good is 0.

    labelled has _good (1 or 0), _prune (true: held back from growing) and the features. A rule
    must keep ``precision`` of rejected rows right, both where it grew and where it was pruned,
    and cover ``least`` bad rows.
    """
    at = [i / bins for i in range(1, bins)]
    got = labelled.agg(*(F.percentile_approx(F.when(F.col("_good") == g, F.col(f)), at, 1000).alias(f"{f}{g}") for f in features for g in (0, 1))).first()
    cuts = {f: sorted({float(v) for g in (0, 1) for v in (got[f"{f}{g}"] or [])}) for f in features}
    cuts = {f: [(a + b) / 2 for a, b in zip(c, c[1:])] for f, c in cuts.items() if len(c) > 1}  # halfway, as unseen rows may lie between
    if not cuts:
        return []
    found: list[Rule] = []
    left = labelled
    for _ in range(max_rules):
        rule = _grow(left.where(~F.col("_prune")), cuts, max_conditions, least)
        rule = _prune(left, rule, precision, least) if rule else ()
        if not rule:
            break
        found.append(rule)
        left = left.where(~_all(rule))
    return found


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _bin(feature: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col(feature)))


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int, least: int) -> Rule:
    rule: Rule = ()
    for _ in range(most):
        binned = rows.where(_all(rule)).select("_good", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), _bin(f, c).alias("b")) for f, c in cuts.items()))).alias("x"))
        counts: dict[str, list[list[int]]] = {f: [[0, 0] for _ in range(len(c) + 1)] for f, c in cuts.items()}
        for r in binned.groupBy("x.f", "x.b", "_good").count().collect():  # features x bins x 2 rows
            counts[r["f"]][r["b"]][int(r["_good"] > 0)] += r["count"]
        bad, good = (sum(x[k] for x in next(iter(counts.values()))) for k in (0, 1))
        if bad < least or not good:
            break
        info = math.log2(bad / (bad + good))
        best: tuple[float, Condition] | None = None
        for f, rows_of in counts.items():
            p = n = 0
            for cut, (b, g) in zip(cuts[f], rows_of):
                p, n = p + b, n + g
                for above, pp, nn in ((False, p, n), (True, bad - p, good - n)):
                    if pp >= least and (gain := pp * (math.log2(pp / (pp + nn)) - info)) > (best[0] if best else 1e-9):
                        best = gain, Condition(f, above, cut)
        if best is None:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule, precision: float, least: int) -> Rule:
    """The beginning of the rule that does best on rows held back, if it holds there and where it grew."""
    sums = [F.sum((_all(rule[:k]) & (F.col("_prune") == held) & (F.col("_good") == g)).cast("long")).alias(f"{k}{int(held)}{g}") for k in range(1, len(rule) + 1) for held in (False, True) for g in (0, 1)]
    got = rows.agg(*sums).first()
    worth = {}
    for k in range(1, len(rule) + 1):
        p, n, gp, gn = (got[f"{k}{h}{g}"] or 0 for h, g in ((1, 0), (1, 1), (0, 0), (0, 1)))
        if gp + p >= least and gp >= precision * (gp + gn) and p and p >= precision * (p + n):
            worth[k] = (p - n) / (p + n), p, -k
    return rule[: max(worth, key=worth.get)] if worth else ()


def rejected(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule), F.lit(i)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """docs with statistics, base_failed, rule (the learned rule that rejects) and kept."""
    rules = learn_rules(written(labelled_statistics(docs, labels, most_labels), "labelled"))
    df = with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rejected(rules))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
