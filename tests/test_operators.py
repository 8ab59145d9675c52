"""Golden cases, brute-force versions and properties of the operators."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import code as cd
from kindred.functions import text as tx
from kindred.operators import corpus, evaluation, sets
from kindred.operators.vectors import cosine_scores, l2_normalized, ranked
from kindred.sources.tables import exported, page, read_or_empty
from kindred.streaming.visits import run_visits, visits


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (3, "c"), (4, "d")], "id long, tag string")


def test_plain_measures(spark, items):
    w = items.distinct().withColumn("w", F.lit(1.0))
    got = {(r.q, r.c): r.score for r in sets.pair_scores(w, w, "jaccard").collect()}
    assert got[1, 2] == got[2, 1] == pytest.approx(1 / 3)
    got = {(r.q, r.c): r.score for r in sets.pair_scores(w, w, "dice").collect()}
    assert got[1, 2] == pytest.approx(0.5) and (1, 4) not in got


def test_weighted_measures_against_brute_force(spark, items):
    idf = {r.tag: r.idf for r in sets.tag_idf(items, 5).collect()}
    assert idf["a"] == pytest.approx(math.log(5) + 1) and idf["c"] == pytest.approx(math.log(5 / 2) + 1)
    w = items.distinct().join(sets.tag_idf(items, 5).select("tag", F.col("idf").alias("w")), "tag")
    tags = {1: {"a", "b"}, 2: {"b", "c"}, 3: {"c"}, 4: {"d"}}
    weight = lambda s: sum(idf[t] for t in s)
    jaccard = {(r.q, r.c): r.score for r in sets.pair_scores(w, w, "jaccard").collect()}
    dice = {(r.q, r.c): r.score for r in sets.pair_scores(w, w, "dice").collect()}
    for a, b in permutations(tags, 2):
        both = weight(tags[a] & tags[b])
        assert jaccard.get((a, b), 0) == pytest.approx(both / weight(tags[a] | tags[b]))
        assert dice.get((a, b), 0) == pytest.approx(2 * both / (weight(tags[a]) + weight(tags[b])))
        assert dice.get((a, b), 0) >= jaccard.get((a, b), 0)


def test_ruzicka(spark):
    w = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0), (2, "x", 1.0), (2, "z", 1.0)], "id long, tag string, w double")
    got = sets.pair_scores(w, w, "jaccard", F.least("qw", "cw")).where("q = 1").first()
    assert got.score == pytest.approx(1 / 4)


def test_unknown_metric(items):
    with pytest.raises(ValueError):
        sets.pair_scores(items, items, "cosine")


def test_blend(spark):
    assert one(spark, 1.0, sets.combined(F.col("x"), F.lit(0.0)), "double") == pytest.approx(0.8)
    assert one(spark, 1.0, sets.combined(F.col("x"), F.lit(0.0), F.lit(0.5), difficulty_weight=0.1), "double") == pytest.approx(0.77)


@pytest.mark.parametrize("q, c, score, expected", [(7, 9, 0.9, "no_signal"), (8, 7, 0.9, "candidate_sparse"), (8, 8, 0.5, "corroborated"), (8, 8, 0.49, "contradicted")])
def test_corroboration(spark, q, c, score, expected):
    assert one(spark, 1, sets.corroboration_status(F.lit(q), F.lit(c), F.lit(score)), "int") == expected


def test_cosine_blocks_agree(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    m[5] = 0
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(99, None)], "id long, v array<float>").repartition(3)
    whole = {(r.q, r.c): round(r.cosine, 6) for r in cosine_scores(v, v).collect()}
    parts = {(r.q, r.c): round(r.cosine, 6) for r in cosine_scores(v, v, block_bytes=600).collect()}
    assert whole == parts and len(whole) == 60 * 59 and whole[1, 2] == whole[2, 1] and whole[5, 1] == 0
    best = ranked(cosine_scores(v, v, top=3), "cosine", 3).collect()
    expected = ranked(cosine_scores(v, v), "cosine", 3).collect()
    assert sorted(map(tuple, best)) == sorted(map(tuple, expected))


def test_unit_vectors(spark):
    assert one(spark, [3.0, 4.0], l2_normalized("x"), "array<double>") == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0], l2_normalized("x"), "array<double>") is None


def test_metrics(spark):
    near = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1), (2, 8, 2), (3, 1, 1)], "q long, c long, rank int")
    truth = spark.createDataFrame([(1, 5), (2, 8), (2, 10), (2, 11), (9, 1)], "q long, t long")
    got = {r.k: r for r in evaluation.metrics(evaluation.hits_by_query(near, truth, [1, 2])).collect()}
    assert (got[2].n_queries, got[2].hit_rate, got[2].pooled_recall) == (2, 1.0, 0.5)
    assert got[2].recall == pytest.approx(2 / 3) and got[1].hit_rate <= got[2].hit_rate


@pytest.mark.parametrize("keep, expected", [(True, [(1, 2), (3, 4)]), (False, [(1, 2)])])
def test_legitimacy(spark, keep, expected):
    e = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "q long, t long")
    labels = spark.createDataFrame([(1, 2, "LEGITIMATE"), (5, 6, "SPURIOUS")], "lo long, hi long, label string")
    assert sorted(map(tuple, evaluation.by_legitimacy(e, labels, ["LEGITIMATE"], keep).collect())) == expected


def test_average_rank(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.1)], "q long, c long, score double")
    assert {r.c: r.avg_rank for r in evaluation.average_rank(s, "score").collect()} == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0}


def test_corpus_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    once = corpus.published(a, b, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert sorted(map(tuple, corpus.published(once, b, "k").collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, corpus.overridden([a, b], "k").collect())) == [(1, "x", 0), (2, "z", 1), (3, "w", 1)]
    assert [r.k for r in corpus.pool([a, b], "k").collect()] == [2]
    assert [r.k for r in corpus.pending(a, b, "k", 5).collect()] == [1]
    assert [r.k for r in page(a, "k", 1, 5).collect()] == [2]
    assert read_or_empty(spark, str(tmp_path / "none"), "k long").count() == 0
    exported(a, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"k":1,"v":"x"}', '{"k":2,"v":"y"}']


def test_leaks(spark):
    words = list(tx.SYNONYMS)
    leaked = lambda t: one(spark, t, tx.leaked_words("x", words))
    assert leaked("concatenate compile atomic milestone recourse") == []
    assert leaked("The stones of a Cat") == ["stone", "cat"]
    scrub = lambda t: one(spark, t, tx.scrubbed("x", tx.SYNONYMS))
    assert scrub("The stones") == "The elements" and scrub("Stones") == "Elements" and scrub("prerequisites") == "dependencys" and scrub("STONES écat") == "Elements écat"


def test_family(spark):
    base = lambda t: one(spark, t, tx.family_base("x"))
    assert base("two-sum-ii-input-array-is-sorted") == "two-sum" and base("jump-game-vii") == "jump-game" and base("ii-a") == "" and base("mix-civic") == "mix-civic"
    pair = spark.createDataFrame([("erect-the-fence", "erect-the-fence-ii")], "a string, b string").select(tx.is_family_pair("a", "b").alias("x"), tx.is_family_pair("b", "a").alias("y"), tx.is_family_pair("a", "a").alias("z")).first()
    assert tuple(pair) == (True, True, False)


def test_html(spark):
    assert one(spark, "<p>a&nbsp;b</p><img src=x><ul><li>c</li></ul>", tx.html_to_text("x")) == "a b\n\nc"
    assert one(spark, "&amp;lt;", tx.html_to_text("x")) == "&lt;" and one(spark, None, tx.html_to_text("x")) is None


@pytest.mark.parametrize("stated, rank", [("O(1)", 0), ("O(n)", 2), ("O(n^2)", 4), ("O(nlogn)", 2), (r"O(n \log n)", None)])
def test_complexity(spark, stated, rank):
    assert one(spark, f"Time complexity: $${stated}$$", tx.complexity_rank("x")) == rank


def test_article(spark):
    text = "We recommend Approach 1: X and Approach 4: Y since they win. Approach 9\n#### Approach 1: A\nplayground/ab1/shared\n### Approach: B\n"
    assert one(spark, text, tx.recommended("x")) == [1, 4]
    got = one(spark, text, tx.sections("x"))
    assert [(r["index"], r["uuid"]) for r in got] == [(1, "ab1"), (2, None)]


@pytest.mark.parametrize("raw, ok", [('```json\n{"techniques":[{"name":"a","role":"b"}],"mechanism":"m"}\n```', True), ('{"techniques":[{"name":"a","role":"b"}]}', False), ('{"techniques":[{"name":"a","role":" "}],"mechanism":"m"}', False), ("none", False), (None, False)])
def test_analysis(spark, raw, ok):
    assert one(spark, raw, tx.parsed_analysis("x")).ok is ok


def test_visits_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_visits(stream, "user_id", "ts", "s", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    newest = corpus.first_row(out.drop("epoch").withColumn("e", F.col("visit_count")), "visitor", F.desc("e")).drop("e")
    assert sorted(map(tuple, newest.select("visitor", "visit_count", "first_seen", "last_seen").collect())) == sorted(map(tuple, visits(events, "user_id", "ts", "s").collect()))


def test_anonymized():
    assert cd.anonymized("def f(a):\n    b = a\n    return b") == "def solve(v1):\n    v0 = v1\n    return v0"
    assert cd.anonymized("def f(:") == "def f(:" and cd.anonymized(None) is None


@pytest.mark.parametrize("source, found", [
    ("while l <= r:\n    m = (l + r + 1) >> 1\n    if ok(m):\n        l = m\n    else:\n        r = m - 1", ["binary_search"]),
    ("while l < r:\n    m = l + 1\n    l = m", []),
    ("while i < j:\n    i += 1\n    j -= 1", ["two_pointers"]),
    ("while i < j:\n    i += 1\n    j += 1", []),
    ("while queue:\n    queue.pop()", []),
    ("while i < j:\n    i -= 1\n    j += 1", []),
    ("while j >= i:\n    i += 1\n    j -= 1", ["two_pointers"]),
    ("while i > j:\n    i += 1\n    j -= 1", []),
])
def test_motifs(source, found):
    assert cd.features(source)["motifs"] == found


def test_features():
    closed = cd.features("def f(n):\n    return n * (n + 1) // 2")
    assert (closed["usable"], closed["n_loops"], closed["nesting"], closed["recursive"]) == (True, 0, 0, False)
    assert cd.features("x = 1")["usable"] is False and cd.features("def f(:") is None


@pytest.mark.parametrize("raw, expected", [(r"a\nb\nc", "a\nb\nc"), ("a\nb\nc", "a\nb\nc"), (r"say \"x\"\n\n", 'say "x"\n\n'), ("plain", "plain")])
def test_escapes(spark, raw, expected):
    assert one(spark, raw, tx.normalized_escapes("x")) == expected


@pytest.mark.parametrize("stub, bag", [
    ("class Solution:\n    def go(self, a: Optional[List[int]]) -> int:\n        ", ["arg:List", "arg:Optional", "arg:int", "nargs:1", "ret:int"]),
    ("def go():", ["nargs:0"]),
    ("def other(a: int):", None),
])
def test_signatures(spark, stub, bag):
    assert one(spark, stub, tx.signature_bag("x", F.lit("go"))) == bag


def test_stratified(spark):
    from kindred.operators.sampling import banded, stratified

    tags = spark.createDataFrame([(i, "common") for i in range(20)] + [(1, "rare"), (2, "rare"), (3, "some"), (1, "some"), (4, "some")], "id long, tag string")
    got = [(r.id, r.tag) for r in stratified(tags, 2).collect()]
    assert len({i for i, _ in got}) == len(got) == 6 and {i for i, t in got if t == "rare"} == {1, 2} and {i for i, t in got if t == "some"} == {3, 4}
    assert banded(tags, "tag", 2, "id").groupBy("tag").count().where("count <> 2").count() == 0
