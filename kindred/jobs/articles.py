"""Queries on articles, posts and stubs.

The tables hold none, so each query first writes them with Spark from a table's rows, and then
reads back by parsing what SQL knows from the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import code
from kindred.functions import text as tx
from kindred.jobs.registry import query, table
from kindred.operators import sets
from kindred.operators.sampling import stratified
from kindred.session import spread, work_path

COSTS = ["O(1)", "O(\\log n)", "O(n)", "O(n log n)", "O(n^2)", "O(n * m)", "O(2^n)"]
RANKS = [0.0, None, 2.0, 3.0, 4.0, 3.5, 6.0]
SQL_RANK = "CASE p % 7 " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(RANKS) if r is not None) + " END"
SQL_PARTS = f"parts AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, CASE WHEN l_partkey % 3 <> 0 THEN 'id' || l_partkey END AS uuid, ({SQL_RANK})::DOUBLE AS rank FROM (SELECT *, l_partkey AS p FROM lineitem))"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for every order: a recommendation in each fifth, and an approach for each line."""
    p = F.col("l_partkey")
    cost = F.get(F.array(*map(F.lit, COSTS)), (p % 7).cast("int"))
    part = F.concat(F.lit(": a way\nTime complexity: $$"), cost, F.lit("$$.\n"), F.when(p % 3 != 0, F.concat(F.lit("playground/id"), p.cast("string"), F.lit("/shared\n"))).otherwise(""))
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", part.alias("t")))).alias("x"))
    intro = F.when(F.col("k") % 5 == 0, "Overview. We recommend Approach 2: it is short. Approach 1 is not.").otherwise("Overview.")
    return a.select("k", F.concat(intro, F.array_join(F.transform("x", lambda r, i: F.concat(F.lit("\n#### Approach "), (i + 1).cast("string"), r["t"])), "")).alias("article"))


@query("split_sections", f"WITH {SQL_PARTS} SELECT k, n AS index, uuid FROM parts")
def split_sections(spark, sf_dir):
    return articles(spark, sf_dir).select("k", F.explode(tx.sections("article")).alias("a")).select("k", F.col("a.index").cast("long").alias("index"), F.col("a.uuid").alias("uuid"))


@query("complexity_rank", f"WITH {SQL_PARTS} SELECT k, n AS index, rank FROM parts")
def complexity_rank(spark, sf_dir):
    return articles(spark, sf_dir).select("k", F.explode(tx.sections("article")).alias("a")).select("k", F.col("a.index").cast("long").alias("index"), tx.complexity_rank("a.text").alias("rank"))


@query("best_approach", f"""WITH {SQL_PARTS}, ks AS (SELECT DISTINCT k FROM parts), named AS (SELECT k, n FROM parts WHERE n = 2 AND uuid IS NOT NULL AND k % 5 = 0),
    least AS (SELECT k, arg_min(n, (rank, n)) AS n FROM parts WHERE uuid IS NOT NULL AND rank IS NOT NULL GROUP BY k), last AS (SELECT k, max(n) AS n FROM parts WHERE uuid IS NOT NULL GROUP BY k)
    SELECT k, coalesce(named.n, least.n, last.n) AS index FROM ks LEFT JOIN named USING (k) LEFT JOIN least USING (k) LEFT JOIN last USING (k)""")
def best_approach(spark, sf_dir):
    return articles(spark, sf_dir).select("k", tx.best_approach("article")["index"].cast("long").alias("index"))


@query("parse_analysis", "SELECT p_partkey, p_size % 5 <> 0 AND p_size % 7 <> 0 AS ok, CASE WHEN p_size % 5 = 0 THEN 'no JSON object' WHEN p_size % 7 = 0 THEN 'no mechanism' END AS error, CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN p_name END AS technique FROM part")
def parse_analysis(spark, sf_dir):
    whole = F.struct(F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("role"))).alias("techniques"), F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_brand")).alias("mechanism"))
    raw = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("```json\n"), F.to_json(whole), F.lit("\n```")))
    got = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", raw.alias("raw")).select("p_partkey", tx.parsed_analysis("raw").alias("x"))
    return got.select("p_partkey", "x.ok", "x.error", F.get("x.value.techniques", F.lit(0))["name"].alias("technique"))


@query("fenced_code", r"WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Look:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'there' ELSE 'plain ' || text END AS post FROM conversations) SELECT conv_id, turn, coalesce(nullif(regexp_extract(post, '(?s)```(?:python)?\s*\n(.*?)```', 1), ''), post) AS code FROM p")
def fenced_code(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    post = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Look:\n```python\n"), "text", F.lit("\n```\nthere"))).otherwise(F.concat(F.lit("plain "), "text"))
    return c.select("conv_id", "turn", post.alias("post")).select("conv_id", "turn", tx.fenced_code("post").alias("code"))


SQL_ESCAPES = "x"
for _old, _new in (("chr(92) || 'r' || chr(92) || 'n'", 10), ("chr(92) || 'n'", 10), ("chr(92) || 't'", 9), ("chr(92) || chr(39)", 39), ("chr(92) || chr(34)", 34), ("chr(92) || chr(92)", 92)):
    SQL_ESCAPES = f"replace({SQL_ESCAPES}, {_old}, chr({_new}))"


@query("normalize_escapes", f"WITH d AS (SELECT doc_id, replace(text, chr(10), chr(92) || 'n') AS x FROM documents) SELECT doc_id, CASE WHEN contains(x, chr(92) || 'n') THEN {SQL_ESCAPES} ELSE x END AS text FROM d")
def normalize_escapes(spark, sf_dir):
    """Texts whose line ends were made literal come back; other escapes in them become real too."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\\n")).alias("x")).select("doc_id", tx.normalized_escapes("x").alias("text"))


TYPES = ["int", "List[int]", "Optional[List[str]]", "Dict[str, List[int]]"]
SQL_BAG = "list_sort(list_concat(list_transform(CASE p_size % 4 WHEN 0 THEN ['int'] WHEN 1 THEN ['List', 'int'] WHEN 2 THEN ['Optional', 'List', 'str'] ELSE ['Dict', 'str', 'List', 'int'] END, lambda x: 'arg:' || x), CASE WHEN p_partkey % 2 = 0 THEN ['arg:bool'] ELSE [] END, CASE WHEN p_partkey % 3 = 0 THEN ['ret:int'] ELSE [] END, ['nargs:' || CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END]))"


def stub() -> Column:
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("p_size") % 4).cast("int"))
    more = F.when(F.col("p_partkey") % 2 == 0, ", b: bool").otherwise("")
    result = F.when(F.col("p_partkey") % 3 == 0, " -> int").otherwise("")
    return F.concat(F.lit("class Solution:\n    def work(self, a: "), kind, more, F.lit(")"), result, F.lit(":\n        "))


@query("signature_bag", f"SELECT p_partkey, {SQL_BAG} AS bag FROM part")
def signature_bag(spark, sf_dir):
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", stub().alias("stub")).select("p_partkey", tx.signature_bag("stub", F.lit("work")).alias("bag"))


SQL_PROGRAMS = """programs AS (SELECT p_partkey, p_size, p_partkey % 11 < 10 AS good, p_size % 4 AS deep, p_partkey % 3 = 0 AS search, p_size % 3 = 0 AS pointers, p_size % 5 = 0 AS again,
    p_partkey % 3 = 0 AND p_size % 7 > 0 AS halves, p_size % 3 = 0 AND p_partkey % 5 > 0 AS meets FROM part)"""
SQL_FEATURES = SQL_PROGRAMS + """, features AS (SELECT p_partkey, search::INT + pointers::INT + deep AS n_loops, greatest(deep, (search OR pointers)::INT)::INT AS nesting, again AS recursive, pointers AS early_exit,
    list_filter([CASE WHEN halves THEN 'binary_search' END, CASE WHEN meets THEN 'two_pointers' END], lambda x: x IS NOT NULL) AS motifs FROM programs WHERE good)"""


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part, put together from its columns: a search that halves or only seems to, two pointers that
    meet or part, loops in each other, a call of itself; one of eleven does not parse. All names hold the part's number.
    """
    k, z = F.col("p_partkey"), F.col("p_size")
    middle = F.when(z % 7 == 0, "lo{n} * hi{n} // 2").when(k % 2 == 0, "(lo{n} + hi{n}) // 2").otherwise("lo{n} + hi{n} >> 1")
    search = F.concat(F.lit("    lo{n}, hi{n} = 0, len(a)\n    while lo{n} < hi{n}:\n        mid{n} = "), middle, F.lit("\n        if a[mid{n}] < s:\n            lo{n} = mid{n} + 1\n        else:\n            hi{n} = mid{n}\n"))
    moves = F.when(k % 5 > 0, "        i{n} += 1\n        j{n} -= 1\n").otherwise("        i{n} -= 1\n        j{n} += 1\n")
    pointers = F.concat(F.lit("    i{n}, j{n} = 0, len(s) - 1\n    while i{n} < j{n}:\n        if s[i{n}] != s[j{n}]:\n            return False\n"), moves)
    deep = (z % 4).cast("int")
    loops = F.array_join(F.transform(F.sequence(F.lit(1), deep + 1), lambda i: F.concat(F.repeat(F.lit("    "), i), F.when(i > deep, "t{n} = 0\n").otherwise(F.concat(F.lit("for x{n}_"), i.cast("string"), F.lit(" in a:\n"))))), "")
    head = F.when(k % 11 < 10, "def f{n}(a, s):\n").otherwise("def f{n}(:\n")
    last = F.when(z % 5 == 0, "    return f{n}(a, s)\n").otherwise("    return t{n}\n")
    text = F.concat(head, F.when(k % 3 == 0, search).otherwise(""), F.when(z % 3 == 0, pointers).otherwise(""), loops, last)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_size", F.replace(text, F.lit("{n}"), k.cast("string")).alias("code"))


@query("code_features", f"WITH {SQL_FEATURES} SELECT p_partkey, CASE WHEN good THEN TRUE END AS usable, n_loops, nesting, recursive, early_exit, array_to_string(motifs, ',') AS motifs FROM programs LEFT JOIN features USING (p_partkey)")
def q_features(spark, sf_dir):
    return programs(spark, sf_dir).select("p_partkey", code.code_features("code").alias("x")).select("p_partkey", "x.usable", "x.n_loops", "x.nesting", "x.recursive", "x.early_exit", F.array_join("x.motifs", ",").alias("motifs"))


@query("anonymize_code", f"""WITH {SQL_PROGRAMS} SELECT deep AS kind, count(*) AS n, count(DISTINCT CASE WHEN good AND NOT again THEN concat_ws(' ', search, CASE WHEN halves THEN p_partkey % 2 END, search AND NOT halves, pointers, meets) ELSE p_partkey::VARCHAR END) AS n_texts FROM programs GROUP BY deep""")
def q_anonymize(spark, sf_dir):
    """Functions that differ by names alone become one text; a call keeps its name, so recursion shows, and what does not parse stays as it is."""
    rows = programs(spark, sf_dir).select((F.col("p_size") % 4).alias("kind"), code.anonymized_code("code").alias("text"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


@query("derived_tag_pairs", f"""WITH {SQL_FEATURES}, t AS (SELECT p_partkey, list_sort(list_concat(['loops:' || n_loops, 'nesting:' || nesting], CASE WHEN recursive THEN ['recursive'] ELSE [] END, CASE WHEN early_exit THEN ['early_exit'] ELSE [] END, motifs)) AS tags FROM features),
    r AS (SELECT tags, min(p_partkey) AS id, count(*) AS n FROM t GROUP BY tags), x AS (SELECT id, n, unnest(tags) AS tag FROM r),
    idf AS (SELECT tag, ln((SELECT sum(n) FROM r)::DOUBLE / sum(n)) + 1 AS w FROM x GROUP BY tag), w AS (SELECT id, tag, w FROM x JOIN idf USING (tag)), total AS (SELECT id, sum(w) AS t FROM w GROUP BY id),
    p AS (SELECT a.id AS q, b.id AS c, sum(a.w) AS shared FROM w a JOIN w b ON a.tag = b.tag AND a.id <> b.id GROUP BY ALL)
    SELECT q, c, round(shared / (x.t + y.t - shared), 9) AS score, a.n AS n_q, b.n AS n_c FROM p JOIN total x ON x.id = q JOIN total y ON y.id = c JOIN r a ON a.id = q JOIN r b ON b.id = c""")
def derived_tag_pairs(spark, sf_dir):
    """Weighted similarity over the tags that code itself gives, between one representative of each set of tags; n_q and n_c count the programs they stand for."""
    x = F.col("x")
    flag = lambda c: F.when(x[c], F.array(F.lit(c))).otherwise(F.array().cast("array<string>"))
    own = F.array(F.concat(F.lit("loops:"), x["n_loops"].cast("string")), F.concat(F.lit("nesting:"), x["nesting"].cast("string")))
    # Programs that do not parse are one group, dropped once it is written: a filter before that would walk each program twice.
    tags = F.when(x["usable"], F.array_sort(F.concat(own, flag("recursive"), flag("early_exit"), x["motifs"])))
    reps = programs(spark, sf_dir).select("p_partkey", code.code_features("code").alias("x")).select("p_partkey", tags.alias("tags"))
    path = work_path(spark, "tags")
    reps.groupBy("tags").agg(F.min("p_partkey").alias("id"), F.count("*").alias("n")).write.parquet(path)
    reps = spark.read.parquet(path).where("tags IS NOT NULL")
    held = reps.select("id", "n", F.explode("tags").alias("tag"))
    idf = held.groupBy("tag").agg(F.sum("n").alias("df")).select("tag", (F.log(F.lit(float(reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])) / F.col("df")) + 1).alias("w"))
    w = held.join(idf, "tag").select("id", "tag", "w")
    n = lambda side: reps.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"))
    return sets.pair_scores(w, w, "jaccard").join(n("q"), "q").join(n("c"), "c").select("q", "c", F.round("score", 9).alias("score"), "n_q", "n_c")


def steps(last: str) -> Column:
    """p_size % 4 + 1 assignments, each from the one before, and a return; names differ from row to row."""
    name = lambda i: F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit("_"), i.cast("string"))
    n = (F.col("p_size") % 4).cast("int")
    lines = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("    "), name(i), F.lit(" = "), F.when(i == 0, F.col(last)).otherwise(name(i - 1)), F.lit(" * "), i.cast("string"), F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.lit("    return "), name(n), F.lit("\n"))


@query("anonymized_text", """SELECT p_partkey, 'def solve(v' || (p_size % 4 + 1) || '):' || chr(10) || array_to_string(list_transform(range(0, p_size % 4 + 1), lambda i: '    v' || i || ' = v' || CASE WHEN i = 0 THEN p_size % 4 + 1 ELSE i - 1 END || ' * ' || i || chr(10)), '') || '    return v' || (p_size % 4) AS text FROM part""")
def anonymized_text(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part"), "p_partkey").withColumn("p", F.concat(F.lit("a"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", code.anonymized_code(F.concat(F.lit("def g"), F.col("p"), F.lit("("), F.col("p"), F.lit("):\n"), steps("p"))).alias("text"))


@query("code_shapes", "SELECT p_partkey, TRUE AS usable, (p_size % 5 + p_partkey % 3)::INT AS n_loops, greatest(p_size % 5, (p_partkey % 3 > 0)::INT)::INT AS nesting, p_size % 2 = 1 AS recursive, p_partkey % 4 = 0 AND p_partkey % 3 > 0 AS early_exit FROM part")
def code_shapes(spark, sf_dir):
    """Loops in each other and one after another, with or without a way out and a call of itself, as the row says."""
    deep, flat = (F.col("p_size") % 5).cast("int"), (F.col("p_partkey") % 3).cast("int")
    way_out = F.when(F.col("p_partkey") % 4 == 0, "        break\n").otherwise("        pass\n")
    nested = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), deep + 1), lambda i: F.concat(F.repeat(F.lit("    "), i), F.when(i > deep, "n = 0\n").otherwise("for i in a:\n"))), ""))
    body = F.concat(nested, F.repeat(F.concat(F.lit("    while n:\n"), way_out), flat), F.when(F.col("p_size") % 2 == 1, "    n = f(a)\n").otherwise("    n = g(a)\n"))
    features = code.code_features(F.concat(F.lit("def f(a):\n"), body)).alias("x")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", features).select("p_partkey", "x.usable", "x.n_loops", "x.nesting", "x.recursive", "x.early_exit")


@query("align_signature", """WITH c AS (SELECT p_partkey, p_size, 'x' || p_partkey AS x, p_partkey % 2 = 0 AS two, p_partkey % 3 > 0 AS given FROM part)
    SELECT p_partkey, CASE WHEN two = given THEN 'class Solution:' || chr(10) || chr(10) || '    def work(self, a' || CASE WHEN two THEN ', b' ELSE '' END || '):' || chr(10) || '        t = a + ' || p_size || chr(10) || '        return t'
        ELSE 'class Solution:' || chr(10) || '    def work(self, ' || x || CASE WHEN given THEN ', y' ELSE '' END || '):' || chr(10) || '        t = ' || x || ' + ' || p_size || chr(10) || '        return t' || chr(10) END AS code FROM c""")
def align_signature(spark, sf_dir):
    """Candidates whose parameters have other names than the stub's; a third of them of another number."""
    x = F.concat(F.lit("x"), F.col("p_partkey").cast("string"))
    more = F.when(F.col("p_partkey") % 3 > 0, ", y").otherwise("")
    own = F.concat(F.lit("class Solution:\n    def work(self, "), x, more, F.lit("):\n        t = "), x, F.lit(" + "), F.col("p_size").cast("string"), F.lit("\n        return t\n"))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", code.aligned_code(own, stub(), F.lit("work")).alias("code"))


@query("motif_counts", f"WITH {SQL_FEATURES} SELECT motif, count(*) AS n FROM (SELECT unnest(motifs) AS motif FROM features) GROUP BY motif")
def motif_counts(spark, sf_dir):
    return programs(spark, sf_dir).select(F.explode(code.code_features("code")["motifs"]).alias("motif")).groupBy("motif").agg(F.count("*").alias("n"))


@query("stratified_sample")
def stratified_sample(spark, sf_dir):
    """Orders by the ship year of their lines, ten for each year, rarest first. Rows only: the greedy order is no SQL."""
    years = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.year("l_shipdate").cast("string").alias("tag"))
    return stratified(years, 10)


@query("baseline_mean", "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, count(*) OVER () AS n FROM embeddings) SELECT a.id % 10 AS part, count(*) AS n, round(avg(list_cosine_similarity(a.v, b.v)), 9) AS mean FROM v a JOIN v b ON b.id = (a.id * 7919 + 13) % a.n AND a.id <> b.id GROUP BY ALL")
def baseline_mean(spark, sf_dir):
    """The mean of pairs that a fixed scramble of ids draws: what unrelated items score."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    n = v.count()
    a = v.select("id", F.col("v").alias("av"), ((F.col("id") * 7919 + 13) % n).alias("c"))
    dot = F.aggregate(F.zip_with("av", "bv", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    from kindred.operators.vectors import l2_norm

    pairs = a.join(v.select(F.col("id").alias("c"), F.col("v").alias("bv")), "c").where("id <> c")
    return pairs.groupBy((F.col("id") % 10).alias("part")).agg(F.count("*").alias("n"), F.round(F.avg(dot / (l2_norm("av") * l2_norm("bv"))), 9).alias("mean"))
