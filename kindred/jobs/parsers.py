"""Queries on text that is composed from the rows: near-valid JSON, Markdown, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions.markdown import code_blocks
from kindred.functions.signatures import signature_bag
from kindred.jobs.posts import PLACE, SQL_PLACE
from kindred.jobs.registry import query, table
from kindred.operators import sets
from kindred.session import spread, work_path


def _when(test: str, text: str) -> Column:
    return F.when(F.expr(test), text).otherwise("")


@query("repaired_analysis", "SELECT p_partkey, p_size % 5 <> 4 AS ok, CASE WHEN p_size % 5 = 4 THEN 'no mechanism' END AS error, CASE WHEN p_size % 5 <> 4 THEN p_name END AS technique, CASE WHEN p_size % 5 <> 4 THEN p_brand END AS mechanism FROM part")
def repaired_analysis(spark, sf_dir):
    """Analyses whose JSON lacks or has too many commas, quotes and brackets, each row in its own way."""
    name, role, brand = (F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"')) for c in (F.col("p_name"), F.col("p_type"), F.col("p_brand")))
    technique = F.concat(F.lit('{"name": '), name, F.when(F.expr("p_partkey % 3 = 0"), " ").otherwise(", "), F.lit("'role': "), role, _when("p_partkey % 2 = 0", ","), F.lit("}"))
    listed = F.concat(F.lit('{"techniques": ['), technique, _when("p_size % 2 = 0", ","), _when("p_size % 3 <> 0", "]"))
    last = F.when(F.expr("p_size % 5 = 4"), F.lit("null")).when(F.expr("p_partkey % 4 = 1"), F.concat(F.lit('"'), F.col("p_brand"), F.lit('\\"'))).otherwise(brand)
    raw = F.concat(F.lit("It is:\n"), listed, F.when(F.expr("p_size % 3 = 0"), "], ").otherwise(", "), F.lit("mechanism: "), last, F.lit("}"))
    got = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", raw.alias("raw")).select("p_partkey", tx.parsed_analysis("raw").alias("x"))
    return got.select("p_partkey", "x.ok", "x.error", F.get("x.value.techniques", F.lit(0))["name"].alias("technique"), F.col("x.value.mechanism").alias("mechanism"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post for each order, with a part for each of its lines: text, fences of both marks, indented code, quotes and lists with code."""
    n, mark = F.col("l_partkey").cast("string"), F.repeat(F.lit("~"), (3 + F.col("l_suppkey") % 3).cast("int"))
    kinds = [
        F.concat(F.lit("Part "), n, F.lit(", as said,\n    goes on.")),
        F.concat(F.lit("```Python\np = "), n, F.lit("\n```")),
        F.concat(mark, F.lit("\n```\nq = "), n, F.lit("\n"), mark),
        F.concat(F.lit("Then:\n\n    r = "), n, F.lit("\n\n      s")),
        F.concat(F.lit("> ```\n> t = "), n, F.lit("\n> ```")),
        F.concat(F.lit("- item\n\n  ```py\n  u = "), n, F.lit("\n  ```\n\n      v\n\nThat is it.")),
    ]
    part = F.get(F.array(*kinds), (F.col("l_partkey") % 6).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(*PLACE, "l_quantity", part.alias("part"))))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("post"))


@query("markdown_blocks", f"""WITH b AS (SELECT l_orderkey AS k, {SQL_PLACE}, l_quantity, l_partkey % 6 = 1 AS python, CASE l_partkey % 6 WHEN 1 THEN 'p = ' || l_partkey || chr(10) WHEN 2 THEN '```' || chr(10) || 'q = ' || l_partkey || chr(10) WHEN 3 THEN 'r = ' || l_partkey || chr(10) || chr(10) || '  s' END AS body FROM lineitem)
    SELECT k, coalesce(list(body ORDER BY python DESC, {SQL_PLACE}, l_quantity) FILTER (body IS NOT NULL), []) AS blocks FROM b GROUP BY k""")
def markdown_blocks(spark, sf_dir):
    return posts(spark, sf_dir).select("k", code_blocks(F.col("post")).alias("blocks"))


SQL_SIGNATURES = """s AS (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN list_sort(list_concat(
    flatten(list_transform(range(1 + p_partkey % 4), lambda i: list_concat(list_transform(range((p_size + i) % 5), lambda j: CASE WHEN j % 2 = 0 THEN 'arg:List' ELSE 'arg:Tuple' END), CASE WHEN (p_size + i) % 5 > 1 THEN ['arg:str'] ELSE [] END, ['arg:int']))),
    CASE WHEN p_partkey % 2 = 0 THEN ['ret:Tuple', 'ret:int', 'ret:int', 'ret:int'] ELSE [] END, ['nargs:' || (1 + p_partkey % 4)])) END AS bag FROM part)"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stubs whose arguments differ in number and depth, with defaults and strings that hold commas and brackets."""
    def kind(i: Column) -> Column:
        depth = ((F.col("p_size") + i) % 5).cast("int")
        opened = F.transform(F.sequence(F.lit(0), depth), lambda j: F.when(j >= depth, "").when(j % 2 == 0, "List[").otherwise("Tuple["))
        return F.concat(F.array_join(opened, ""), F.lit("int"), F.when(depth > 1, ", str").otherwise(""), F.repeat(F.lit("]"), depth))

    last = (F.col("p_partkey") % 4).cast("int")
    default = F.when(F.col("p_partkey") % 3 == 0, " = (1, [2, 3])").when(F.col("p_partkey") % 3 == 1, " = '), (: '").otherwise("")
    args = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.lit("a"), i.cast("string"), F.lit(": "), kind(i), F.when(i == last, default).otherwise("")))
    name = F.when(F.col("p_partkey") % 11 > 0, "work").otherwise("other")
    result = F.when(F.col("p_partkey") % 2 == 0, " -> Tuple[int, int, int]").otherwise("")
    stub = F.concat(F.lit("class Solution:\n    def "), name, F.lit("(self, "), F.array_join(args, ", "), F.lit(")"), result, F.lit(":\n        "))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", stub.alias("stub")).select("p_partkey", signature_bag(F.col("stub"), F.lit("work")).alias("bag"))


@query("signature_depths", f"WITH {SQL_SIGNATURES} SELECT p_partkey, bag FROM s")
def signature_depths(spark, sf_dir):
    return signatures(spark, sf_dir)


@query("signature_coverage", f"WITH {SQL_SIGNATURES} SELECT count(*) AS n, count(*) FILTER (bag IS NULL) AS failed FROM s")
def signature_coverage(spark, sf_dir):
    """How many signatures there are, and how many could not be read."""
    return signatures(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("bag").isNull()).alias("failed"))


@query("signature_matrix", f"""WITH {SQL_SIGNATURES}, r AS (SELECT bag, min(p_partkey) AS id, count(*) AS n FROM s WHERE bag IS NOT NULL GROUP BY bag),
    t AS (SELECT id, tag, count(*) AS w FROM (SELECT id, unnest(bag) AS tag FROM r) GROUP BY ALL), total AS (SELECT id, sum(w) AS t FROM t GROUP BY id),
    p AS (SELECT a.id AS q, b.id AS c, sum(least(a.w, b.w)) AS shared FROM t a JOIN t b ON a.tag = b.tag AND a.id <> b.id GROUP BY ALL),
    m AS (SELECT q, c, shared / (x.t + y.t - shared) AS score FROM p JOIN total x ON x.id = q JOIN total y ON y.id = c UNION ALL SELECT id, id, 1.0 FROM r)
    SELECT q, c, round(score, 9) AS score, a.n AS n_q, b.n AS n_c FROM m JOIN r a ON a.id = q JOIN r b ON b.id = c""")
def signature_matrix(spark, sf_dir):
    """Ruzicka similarity of signatures, ones on the diagonal, between one representative of each equal bag; n_q and n_c count the rows they stand for."""
    path = work_path(spark, "bags")
    signatures(spark, sf_dir).groupBy("bag").agg(F.min("p_partkey").alias("id"), F.count("*").alias("n")).write.parquet(path)
    own = spark.read.parquet(path).where("bag IS NOT NULL")  # dropped here, so that each signature is read once
    bags = own.select("id", F.explode("bag").alias("tag")).groupBy("id", "tag").agg(F.count("*").alias("w"))
    pairs = sets.matrix(bags, bags, own.select("id"), "jaccard", F.least("qw", "cw"))
    n = lambda side: own.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"))
    return pairs.join(n("q"), "q").join(n("c"), "c").select("q", "c", F.round("score", 9).alias("score"), "n_q", "n_c")
