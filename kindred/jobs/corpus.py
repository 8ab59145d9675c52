"""Corpus queries: what is new, pending, reconciled, published; status and vocabulary counts; visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.jobs.registry import query, table
from kindred.operators import corpus as ops
from kindred.operators import evaluation as ev
from kindred.session import work_path
from kindred.sources.pages import scan_pages, write_pages
from kindred.sources.tables import page
from kindred.streaming.visits import visits


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def urgent_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))


@query("catalog_diff", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def catalog_diff(spark, sf_dir):
    """Keys of the catalog that have nothing yet."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent_done(spark, sf_dir), "c_custkey", "left_anti")


@query("pending_limit", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') ORDER BY c_custkey LIMIT 50")
def pending_limit(spark, sf_dir):
    return ops.pending(table(spark, sf_dir, "customer").select("c_custkey"), urgent_done(spark, sf_dir), "c_custkey", 50)


@query("page_scan", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100 OFFSET 50")
def page_scan(spark, sf_dir):
    return page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 50, 100)


@query("name_search", "SELECT c_name FROM customer WHERE contains(lower(c_name), '12') ORDER BY c_name LIMIT 50")
def name_search(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name").where(F.contains(F.lower("c_name"), F.lower(F.trim(F.lit(" 12 "))))).orderBy("c_name").limit(50)


SQL_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'pending' ELSE 'error: ' || o_orderstatus END"


def status() -> Column:
    return F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "pending").otherwise(F.concat(F.lit("error: "), "o_orderstatus"))


@query("status_case", f"SELECT o_orderkey, {SQL_STATUS} AS status FROM orders")
def status_case(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", status().alias("status"))


@query("status_counts", f"SELECT split_part({SQL_STATUS}, ':', 1) AS kind, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY ALL")
def status_counts(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(tx.status_kind(status()).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("pool_intersection", "SELECT DISTINCT p_partkey AS k FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def pool_intersection(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey").alias("k")
    return ops.pool([table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), li.where("l_returnflag = 'R'").select(key), li.where("l_quantity >= 45").select(key)], "k")


@query("reconcile_sources", """WITH ed AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), co AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    SELECT c_custkey AS k, CASE WHEN ed.v IS NOT NULL THEN 'editorial' ELSE 'community' END AS source, coalesce(ed.v, co.v) AS v FROM customer LEFT JOIN ed ON ed.k = c_custkey LEFT JOIN co ON co.k = c_custkey WHERE ed.v IS NOT NULL OR co.v IS NOT NULL""")
def reconcile_sources(spark, sf_dir):
    """The first source by priority of every key that has one; both come out of one aggregate."""
    done = F.col("o_orderstatus") == "F"
    best = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.when(done, F.col("o_orderkey"))).alias("ed"), F.max(F.when(~done, F.col("o_orderkey"))).alias("co"))
    known = best.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", "left_semi").where("ed IS NOT NULL OR co IS NOT NULL")
    return known.select("k", F.when(F.col("ed").isNotNull(), "editorial").otherwise("community").alias("source"), F.coalesce("ed", "co").alias("v"))


SQL_LAYERS = "prod AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1), staged AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderpriority = '3-MEDIUM' GROUP BY 1)"


def layer(spark: SparkSession, sf_dir: str, *priorities: str) -> DataFrame:
    return orders(spark, sf_dir).where(F.col("o_orderpriority").isin(*priorities)).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))


@query("publish_anti_join", f"WITH {SQL_LAYERS} SELECT k, v FROM prod UNION ALL SELECT k, v FROM staged WHERE k NOT IN (SELECT k FROM prod)")
def publish(spark, sf_dir):
    return ops.published(layer(spark, sf_dir, "1-URGENT", "2-HIGH"), layer(spark, sf_dir, "3-MEDIUM"), "k")


@query("layered_override", f"WITH {SQL_LAYERS} SELECT k, coalesce(staged.v, prod.v) AS v, CASE WHEN staged.k IS NULL THEN 0 ELSE 1 END AS layer FROM prod FULL JOIN staged USING (k)")
def layered(spark, sf_dir):
    return ops.overridden([layer(spark, sf_dir, "1-URGENT", "2-HIGH"), layer(spark, sf_dir, "3-MEDIUM")], "k")


@query("tag_diff", """WITH half AS (SELECT l_suppkey AS k, l_shipdate >= TIMESTAMP '1995-06-17' AS late, l_partkey % 200 AS tag FROM lineitem),
    t AS (SELECT k, list_sort(list(DISTINCT tag) FILTER (NOT late)) AS old, list_sort(list(DISTINCT tag) FILTER (late)) AS new FROM half GROUP BY k)
    SELECT k, list_sort(list_filter(coalesce(new, []), lambda x: NOT list_contains(coalesce(old, []), x))) AS added, list_sort(list_filter(coalesce(old, []), lambda x: NOT list_contains(coalesce(new, []), x))) AS removed FROM t WHERE len(added) > 0 OR len(removed) > 0""")
def tag_diff(spark, sf_dir):
    """Tags that each key gained and lost between two snapshots."""
    late = F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp")
    tag = F.col("l_partkey") % 200
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(F.when(~late, tag)).alias("old"), F.collect_set(F.when(late, tag)).alias("new"))
    return t.select("k", F.array_sort(F.array_except("new", "old")).alias("added"), F.array_sort(F.array_except("old", "new")).alias("removed")).where((F.size("added") > 0) | (F.size("removed") > 0))


LANGUAGES = ["3-MEDIUM", "1-URGENT", "5-LOW"]


@query("language_fallback", """SELECT o_custkey AS k, (list(o_orderpriority ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END, o_orderkey))[1] AS language,
    (list(o_orderkey ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END, o_orderkey))[1] AS v FROM orders GROUP BY 1""")
def language_fallback(spark, sf_dir):
    """The first preferred language that a key has, else its first row."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("o_orderpriority")), F.lit(0).cast("long")), F.lit(len(LANGUAGES) + 1).cast("long"))
    best = F.min_by(F.struct("o_orderpriority", "o_orderkey"), F.struct(place, "o_orderkey"))
    return orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("k")).agg(best.alias("b")).select("k", F.col("b.o_orderpriority").alias("language"), F.col("b.o_orderkey").alias("v"))


@query("model_chain", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE ' ' END), ''), nullif(trim(CASE WHEN c_nationkey < 10 THEN c_name ELSE '' END), '')) AS answer FROM customer")
def model_chain(spark, sf_dir):
    """The first answer of a chain that is not blank."""
    first = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise(" ")
    second = F.when(F.col("c_nationkey") < 10, F.col("c_name")).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in (first, second))).alias("answer"))


@query("first_wins", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_wins(spark, sf_dir):
    return ops.first_row(orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("votes_top6", "SELECT l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 6")
def votes_top6(spark, sf_dir):
    """Candidates by falling votes, ties in their order, the first six."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("rank"), "l_quantity").where("rank <= 6").drop("l_quantity")


@query("usage_totals", "SELECT l_suppkey, sum(l_quantity) AS total, round(sum(l_quantity) / count(DISTINCT l_orderkey), 9) AS per_item FROM lineitem GROUP BY 1")
def usage_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total"), F.round(F.sum("l_quantity") / F.countDistinct("l_orderkey"), 9).alias("per_item"))


# --- edges and labels ---------------------------------------------------------------------------

SQL_EDGES = "edges AS (SELECT DISTINCT l_suppkey AS q, l_partkey % 1000 AS t FROM lineitem WHERE l_suppkey <> l_partkey % 1000 AND l_partkey % 1000 IN (SELECT s_suppkey FROM supplier))"
SQL_LEGIT = "legit AS (SELECT lo, hi, CASE (lo * 7 + hi) % 4 WHEN 0 THEN 'LEGITIMATE' WHEN 1 THEN 'LOOSE' WHEN 2 THEN 'SPURIOUS' END AS label FROM (SELECT DISTINCT least(q, t) AS lo, greatest(q, t) AS hi FROM edges) WHERE (lo * 7 + hi) % 4 <> 3)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("q"), (F.col("l_partkey") % 1000).alias("t"))
    return ev.ground_truth(raw, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


def legitimacy(e: DataFrame) -> DataFrame:
    code = (F.col("lo") * 7 + F.col("hi")) % 4
    return e.select(*ev.unordered("q", "t")).distinct().where(code != 3).withColumn("label", F.when(code == 0, "LEGITIMATE").when(code == 1, "LOOSE").otherwise("SPURIOUS"))


@query("gt_edges", f"WITH {SQL_EDGES} SELECT q, t FROM edges")
def gt_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query("legitimacy_filter", f"WITH {SQL_EDGES}, {SQL_LEGIT} SELECT q, t FROM edges LEFT JOIN legit ON lo = least(q, t) AND hi = greatest(q, t) WHERE label = 'LEGITIMATE' OR label IS NULL")
def legitimacy_filter(spark, sf_dir):
    e = edges(spark, sf_dir)
    return ev.by_legitimacy(e, legitimacy(e), ["LEGITIMATE"], True)


@query("gt_tag", f"WITH {SQL_EDGES}, {SQL_LEGIT}, pairs AS (SELECT a.s_suppkey AS q, b.l_partkey % 1000 AS t FROM supplier a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') b ON b.l_suppkey = a.s_suppkey) SELECT DISTINCT p.q, p.t, coalesce(label, CASE WHEN e.q IS NOT NULL OR f.q IS NOT NULL THEN 'RAW_GT_UNJUDGED' ELSE 'no-GT-edge' END) AS tag FROM pairs p LEFT JOIN legit ON lo = least(p.q, p.t) AND hi = greatest(p.q, p.t) LEFT JOIN edges e ON e.q = p.q AND e.t = p.t LEFT JOIN edges f ON f.q = p.t AND f.t = p.q")
def gt_tag(spark, sf_dir):
    """What is known of a pair, in either direction."""
    e = edges(spark, sf_dir)
    pairs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("q"), (F.col("l_partkey") % 1000).alias("t")).distinct()
    known = e.select(*ev.unordered("q", "t")).distinct().withColumn("edge", F.lit(True)).join(legitimacy(e), ["lo", "hi"], "left")
    both = pairs.select("q", "t", *ev.unordered("q", "t")).join(known, ["lo", "hi"], "left")
    return both.select("q", "t", F.coalesce("label", F.when(F.col("edge"), "RAW_GT_UNJUDGED").otherwise("no-GT-edge")).alias("tag"))


@query("label_means", "SELECT CASE WHEN toxic = 1 THEN 'SPURIOUS' ELSE 'LEGITIMATE' END AS kind, count(*) AS n, round(avg(n_chars), 9) AS mean_chars, median(n_chars)::DOUBLE AS median_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def label_means(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.groupBy(F.when(F.col("toxic") == 1, "SPURIOUS").otherwise("LEGITIMATE").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 9).alias("mean_chars"), F.median("n_chars").alias("median_chars"))


# --- vocabularies -------------------------------------------------------------------------------


@query("vocab_counts", "SELECT event_type AS phase, lower(trim(json_extract_string(props, '$.k'))) AS label, count(*) AS n FROM events GROUP BY ALL")
def vocab_counts(spark, sf_dir):
    label = F.lower(F.trim(F.get_json_object("props", "$.k")))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase"), label.alias("label")).agg(F.count("*").alias("n"))


SQL_MAP = "m AS (SELECT DISTINCT lower(trim(p_name)) AS label, split_part(lower(trim(p_name)), ' ', 2) AS canonical FROM part WHERE p_size > 25)"


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.lower(F.trim("p_name"))
    return table(spark, sf_dir, "part").where("p_size > 25").select(label.alias("label"), F.coalesce(F.get(F.split(label, " "), F.lit(1)), F.lit("")).alias("canonical")).distinct()


@query("canonicalize", f"WITH {SQL_MAP} SELECT p_partkey, coalesce(canonical, p_name) AS canonical FROM part LEFT JOIN m ON label = lower(trim(p_name))")
def canonicalize(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lower(F.trim("p_name")).alias("label"))
    return part.join(mapping(spark, sf_dir), "label", "left").select("p_partkey", F.coalesce("canonical", "p_name").alias("canonical"))


@query("canonical_groups", f"WITH {SQL_MAP} SELECT canonical, list_sort(list(label)) AS labels, count(*) AS n FROM m GROUP BY canonical")
def canonical_groups(spark, sf_dir):
    return mapping(spark, sf_dir).groupBy("canonical").agg(F.array_sort(F.collect_list("label")).alias("labels"), F.count("*").alias("n"))


SQL_SLUG = "replace(p_name, ' ', '-') || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '-ii' WHEN 2 THEN '-iii-extra' ELSE '-xii' END"


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    end = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, "-ii").when(F.col("p_size") % 4 == 2, "-iii-extra").otherwise("-xii")
    return part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), end).alias("slug"))


@query("family_base", f"SELECT p_partkey, s AS slug, CASE WHEN regexp_matches(s, '(^|-)(xii|xi|ix|iv|viii|vii|vi|iii|ii|x|v|i)(-|$)') THEN regexp_replace(s, '(^|-)(xii|xi|ix|iv|viii|vii|vi|iii|ii|x|v|i)(-.*)?$', '') ELSE s END AS base FROM (SELECT p_partkey, {SQL_SLUG} AS s FROM part)")
def family_base(spark, sf_dir):
    return slugs(spark, sf_dir).withColumn("base", tx.family_base("slug"))


@query("family_pairs", f"WITH s AS (SELECT DISTINCT {SQL_SLUG} AS slug FROM part), b AS (SELECT slug, regexp_replace(slug, '(^|-)(xii|xi|ix|iv|viii|vii|vi|iii|ii|x|v|i)(-.*)?$', '') AS base FROM s) SELECT a.slug AS a, c.slug AS b FROM b a JOIN b c ON a.base = c.base AND a.slug < c.slug WHERE a.base <> a.slug OR c.base <> c.slug")
def family_pairs(spark, sf_dir):
    s = slugs(spark, sf_dir).select("slug").distinct().withColumn("base", tx.family_base("slug"))
    other = s.select(F.col("slug").alias("b"), "base")
    return s.withColumnRenamed("slug", "a").join(other, "base").where("a < b AND (a <> base OR b <> base)").select("a", "b")


# --- visits -------------------------------------------------------------------------------------

SALT = "pepper"


@query("visitor_key", f"SELECT event_id, 'visitor:' || sha256(user_id::VARCHAR || '{SALT}') AS visitor FROM events")
def visitor_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.visitor_key(F.col("user_id").cast("string"), SALT).alias("visitor"))


@query("visit_counter", f"SELECT 'visitor:' || sha256(user_id::VARCHAR || '{SALT}') AS visitor, count(*) AS visit_count, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def visit_counter(spark, sf_dir):
    return visits(table(spark, sf_dir, "events"), "user_id", "ts", SALT)


@query("last_wins", "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins(spark, sf_dir):
    """Of the rows that share a key the last one, whatever came before."""
    return ops.last_row(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


@query("publish_check", "SELECT coalesce(lang, '') AS lang, count(*) AS n_staged, count(*) FILTER (doc_id IS NULL OR doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)) AS n_without FROM documents GROUP BY 1")
def publish_check(spark, sf_dir):
    """How many staged documents there are of each language, and how many could not be published as they have no vector."""
    staged = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    lacking = ops.without(staged, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").groupBy("lang").agg(F.count("*").alias("n_without"))
    return staged.groupBy("lang").agg(F.count("*").alias("n_staged")).join(lacking, "lang", "left").select("lang", "n_staged", F.coalesce("n_without", F.lit(0).cast("long")).alias("n_without"))


PAGE = 40


@query("page_source", f"SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n, count(*) OVER () AS total FROM part) WHERE n <= {PAGE} * (ceil(total / {PAGE})::BIGINT * 3 // 4)")
def page_source(spark, sf_dir):
    """A catalog written as pages, the last quarter of which begins with one that is cut off, and its scan."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    at, total = work_path(spark, "pages"), part.count()
    rows = ops.chunked(part.withColumn("_all", F.lit(0)), PAGE, "_all", "p_partkey")
    write_pages(rows.select(F.col("chunk").alias("page"), "p_partkey", "p_name"), at, total, broken=-(-total // PAGE) * 3 // 4)
    return scan_pages(spark, at, "p_partkey long, p_name string")
