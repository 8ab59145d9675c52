"""Similarity and retrieval queries.

Stand-ins: an order is an item and the parts in it are its tags; an embedding is an item's vector,
its label a relevance group. Searches take every item whose id is divisible by 20 as a query,
against all items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.jobs.registry import query, table
from kindred.operators import evaluation as ev
from kindred.operators import sets
from kindred.operators.search import nearest, top_neighbours
from kindred.operators.set_join import nearest_sets
from kindred.operators.vectors import BILLION, average_ranks, cosine, cosine_scores, l2_normalized, l2_rounded, mutual_ranks, ranked, ranks_of, score_counts, score_quantiles

K = 10
KS = [1, 3, 5, 10, 20]
ALPHA = 0.7
BLEND_PLACES = 12  # blends of scores to nine places end within them, so that no rounding is a tie

# --- sets -------------------------------------------------------------------------------------

SQL_TAGS = "items AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS tag FROM lineitem)"
SQL_IDF = SQL_TAGS + ", n AS (SELECT count(*)::DOUBLE AS n FROM orders), idf AS (SELECT tag, count(*) AS df, ln((SELECT n FROM n) / count(*)) + 1 AS idf FROM items GROUP BY tag)"
SQL_PLAIN = SQL_TAGS + ", w AS (SELECT id, tag, 1.0::DOUBLE AS w FROM items)"
SQL_WEIGHTED = SQL_IDF + ", w AS (SELECT id, tag, idf AS w FROM items JOIN idf USING (tag))"
SQL_BAG = "w AS (SELECT l_orderkey AS id, l_partkey AS tag, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"


def sql_pairs(weights: str, metric: str, measure: str = "a.w") -> str:
    score = "shared / (qt + ct - shared)" if metric == "jaccard" else "2 * shared / (qt + ct)"
    return f"""WITH {weights}, total AS (SELECT id, sum(w) AS t FROM w GROUP BY id),
        both_ AS (SELECT a.id AS q, b.id AS c, sum({measure}) AS shared FROM w a JOIN w b ON a.tag = b.tag AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY ALL),
        scored AS (SELECT q, c, round({score}, 9) AS score FROM both_ JOIN (SELECT id AS q, t AS qt FROM total) USING (q) JOIN (SELECT id AS c, t AS ct FROM total) USING (c))"""


def sql_top(weights: str, metric: str, measure: str = "a.w") -> str:
    return sql_pairs(weights, metric, measure) + f" SELECT q, c, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM scored) WHERE rank <= {K}"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("tag")).distinct()


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark, sf_dir).withColumn("w", F.lit(1.0))


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.tag_idf(tags(spark, sf_dir), table(spark, sf_dir, "orders").count())


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark, sf_dir).join(idf(spark, sf_dir).select("tag", F.col("idf").alias("w")), "tag").select("id", "tag", "w")


def bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("tag")).agg(F.sum("l_quantity").alias("w"))


def asked(items: DataFrame) -> DataFrame:
    return items.where("id % 20 = 0")


def top(scores: DataFrame, places: int = 9) -> DataFrame:
    return ranked(scores, "score", K, places=places).select("q", "c", "score", F.col("rank").cast("long"))


@query("tag_idf", f"WITH {SQL_IDF} SELECT tag, df, round(idf, 9) AS idf FROM idf")
def q_idf(spark, sf_dir):
    return idf(spark, sf_dir).select("tag", "df", F.round("idf", 9).alias("idf"))


@query("jaccard_pairs", sql_top(SQL_PLAIN, "jaccard"))
def q_jaccard(spark, sf_dir):
    w = plain(spark, sf_dir)
    return top(sets.pair_scores(asked(w), w, "jaccard"))


@query("dice_pairs", sql_top(SQL_PLAIN, "dice"))
def q_dice(spark, sf_dir):
    w = plain(spark, sf_dir)
    return top(sets.pair_scores(asked(w), w, "dice"))


@query("wjaccard_pairs", sql_top(SQL_WEIGHTED, "jaccard"))
def q_wjaccard(spark, sf_dir):
    w = weighted(spark, sf_dir)
    return top(sets.pair_scores(asked(w), w, "jaccard"))


@query("wdice_pairs", sql_top(SQL_WEIGHTED, "dice"))
def q_wdice(spark, sf_dir):
    w = weighted(spark, sf_dir)
    return top(sets.pair_scores(asked(w), w, "dice"))


@query("ruzicka_pairs", sql_top(SQL_BAG, "jaccard", "least(a.w, b.w)"))
def q_ruzicka(spark, sf_dir):
    w = bag(spark, sf_dir)
    return top(sets.pair_scores(asked(w), w, "jaccard", F.least("qw", "cw")))


MILLION = 1_000_000
SQL_EXACT = SQL_IDF + f", w AS (SELECT id, tag, round(idf * {MILLION})::BIGINT AS w FROM items JOIN idf USING (tag))"
SQL_KINDS = f"""items AS (SELECT DISTINCT l_orderkey AS id, unnest(['part ' || l_partkey, 'line ' || l_linenumber, 'flag ' || l_returnflag, 'status ' || l_linestatus]) AS tag FROM lineitem), n AS (SELECT count(*)::DOUBLE AS n FROM orders),
    w AS (SELECT id, tag, round((ln((SELECT n FROM n) / count(*) OVER (PARTITION BY tag)) + 1) * {MILLION})::BIGINT AS w FROM items)"""


def sql_exact_top(weights: str, metric: str) -> str:
    """Ranked before rounding: integer weights make equal scores equal."""
    return sql_top(weights, metric).replace("round(2 * shared / (qt + ct), 9) AS score", "2 * shared / (qt + ct) AS score").replace("round(shared / (qt + ct - shared), 9) AS score", "shared / (qt + ct - shared) AS score").replace("SELECT q, c, score, rank FROM", "SELECT q, c, round(score, 9) AS score, rank FROM")


def idf_millionths(spark: SparkSession, sf_dir: str):
    """The idf of a tag that so many items hold, in whole millionths."""
    n_items = float(table(spark, sf_dir, "orders").count())
    return lambda df: F.round((F.log(F.lit(n_items) / df) + 1) * MILLION).cast("long")


@query("set_join", sql_exact_top(SQL_EXACT, "dice"))
def q_set_join(spark, sf_dir):
    """wdice_pairs by the exact set join."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("tag"))
    return nearest_sets("id % 20 = 0", items, K, weigh=idf_millionths(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("hot_tag_join", sql_exact_top(SQL_KINDS, "jaccard"))
def q_hot_tag_join(spark, sf_dir):
    """Orders by their parts, numbers of lines, flags and states: twelve tags are frequent."""
    kinds = F.array(*(F.concat(F.lit(f"{name} "), F.col(c).cast("string")) for name, c in (("part", "l_partkey"), ("line", "l_linenumber"), ("flag", "l_returnflag"), ("status", "l_linestatus"))))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.explode(kinds).alias("tag"))
    return nearest_sets("id % 20 = 0", items, K, "jaccard", weigh=idf_millionths(spark, sf_dir)).withColumn("score", F.round("score", 9))


SQL_LEVEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END"


def levels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(name), level.alias(f"{name}_level"))


def difficulty(q: str, c: str):
    return 1.0 - 0.5 * F.abs(F.col(q) - F.col(c))


@query("difficulty_sim", sql_pairs(SQL_PLAIN, "jaccard") + f", lv AS (SELECT o_orderkey AS id, {SQL_LEVEL} AS level FROM orders) SELECT q, c, 1.0::DOUBLE - 0.5::DOUBLE * abs(a.level - b.level) AS difficulty FROM scored JOIN lv a ON a.id = q JOIN lv b ON b.id = c")
def q_difficulty(spark, sf_dir):
    w = plain(spark, sf_dir)
    pairs = sets.shared(asked(w), w).select("q", "c")
    return pairs.join(levels(spark, sf_dir, "q"), "q").join(levels(spark, sf_dir, "c"), "c").select("q", "c", difficulty("q_level", "c_level").alias("difficulty"))


SQL_COMBINED = sql_pairs(SQL_WEIGHTED, "dice") + f""", bagged AS (SELECT l_orderkey AS id, l_partkey AS tag, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), bt AS (SELECT id, sum(w) AS t FROM bagged GROUP BY id),
    sig AS (SELECT a.id AS q, b.id AS c, sum(least(a.w, b.w)) AS m FROM bagged a JOIN bagged b ON a.tag = b.tag AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY ALL),
    lv AS (SELECT o_orderkey AS id, {SQL_LEVEL} AS level FROM orders),
    mixed AS (SELECT q, c, round(0.9 * (0.8 * score + 0.2 * round(m / (x.t + y.t - m), 9)) + 0.1 * (1 - 0.5 * abs(a.level - b.level)), 12)::DOUBLE AS score FROM scored JOIN sig USING (q, c) JOIN bt x ON x.id = q JOIN bt y ON y.id = c JOIN lv a ON a.id = q JOIN lv b ON b.id = c)
    SELECT q, c, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM mixed) WHERE rank <= {K}"""


@query("combine_scores", SQL_COMBINED)
def q_combined(spark, sf_dir):
    """Both scores come from the same shared tags, so the pairs are made once."""
    own = Window.partitionBy("id")
    rows = bag(spark, sf_dir).withColumnRenamed("w", "b").join(idf(spark, sf_dir).select("tag", F.col("idf").alias("w")), "tag", "left")
    rows = rows.withColumns({"t": F.sum("w").over(own), "s": F.sum("b").over(own)}).join(levels(spark, sf_dir, "id").withColumnRenamed("id_level", "_level"), "id")
    both = sets.pair_sums(asked(rows), rows, ["t", "s", "_level"], {"tags": F.col("qw"), "least": F.least("qb", "cb")})
    tag = F.round(sets.pair_score("dice", F.col("tags"), F.col("qt") + F.col("ct")), 9)
    signature = F.round(sets.pair_score("jaccard", F.col("least"), F.col("qs") + F.col("cs")), 9)
    return top(both.select("q", "c", sets.combined(tag, signature, difficulty("q_level", "c_level"), difficulty_weight=0.1).alias("score")), BLEND_PLACES)


# --- richness and corroboration -----------------------------------------------------------------

SQL_RICH = sql_pairs(SQL_PLAIN, "dice") + ", rich AS (SELECT id, count(*) AS n FROM items GROUP BY id), sided AS (SELECT q, c, score, a.n AS qn, b.n AS cn FROM scored JOIN rich a ON a.id = q JOIN rich b ON b.id = c)"


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = plain(spark, sf_dir)
    rich = w.groupBy("id").agg(F.count("*").alias("n"))
    scores = sets.pair_scores(asked(w), w, "dice").withColumn("score", F.round("score", 9))
    return scores.join(rich.select(F.col("id").alias("q"), F.col("n").alias("qn")), "q").join(rich.select(F.col("id").alias("c"), F.col("n").alias("cn")), "c")


@query("gated_corroboration", SQL_RICH + " SELECT q, c, CASE WHEN qn >= 4 AND cn >= 4 THEN score ELSE 0 END::DOUBLE AS gated FROM sided")
def q_gated(spark, sf_dir):
    return sided(spark, sf_dir).select("q", "c", sets.gated(F.col("qn"), F.col("cn"), F.col("score"), 4).alias("gated"))


@query("corroboration_status", SQL_RICH + " SELECT q, c, CASE WHEN qn < 4 THEN 'no_signal' WHEN cn < 4 THEN 'candidate_sparse' WHEN score >= 0.25 THEN 'corroborated' ELSE 'contradicted' END AS status FROM sided")
def q_status(spark, sf_dir):
    return sided(spark, sf_dir).select("q", "c", sets.corroboration_status(F.col("qn"), F.col("cn"), F.col("score"), 4, 0.25).alias("status"))


SQL_RETURNED = "rw AS (SELECT l_orderkey AS id, l_partkey AS tag, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), rt AS (SELECT id, sum(w) AS t, count(*) AS n FROM rw GROUP BY id), both2 AS (SELECT a.id AS q, b.id AS c, sum(least(a.w, b.w)) AS m FROM rw a JOIN rw b ON a.tag = b.tag AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY ALL), second AS (SELECT q, c, CASE WHEN x.n >= 2 AND y.n >= 2 THEN round(m / (x.t + y.t - m), 9) ELSE 0 END AS gated FROM both2 JOIN rt x ON x.id = q JOIN rt y ON y.id = c)"


@query("corroborated_score", sql_pairs(SQL_PLAIN, "dice") + f", {SQL_RETURNED} SELECT q, c, round(score + 0.2 * coalesce(gated, 0), 12)::DOUBLE AS score FROM scored LEFT JOIN second USING (q, c)")
def q_corroborated(spark, sf_dir):
    """The tags' score and a share of what a second signal adds, the bags of lines that may come back; pairs that it does not know add nothing."""
    s = two_signals(spark, sf_dir)
    gated = sets.gated(F.col("qn"), F.col("cn"), F.col("second"), 2)
    return s.select("q", "c", F.round(F.col("score") + 0.2 * F.coalesce(gated, F.lit(0.0)), 12).alias("score"))


def two_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, c, score (of the tags), second (of the bags of lines that may come back; null where these share nothing), qn and cn: the tags of these bags. The second's tags are among the first's, so the pairs are made once."""
    back, own = F.col("l_returnflag") != "N", Window.partitionBy("id")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("tag")).agg(F.sum(F.when(back, F.col("l_quantity"))).alias("b"), (F.count_if(back) > 0).alias("r"))
    rows = rows.withColumns({"t": F.count("*").over(own).cast("double"), "s": F.sum("b").over(own), "n": F.count_if("r").over(own)})
    returned = F.col("qr") & F.col("cr")
    both = sets.pair_sums(asked(rows), rows, ["t", "s", "n"], {"tags": F.lit(1.0), "least": F.when(returned, F.least("qb", "cb")), "shared": returned.cast("int")})
    second = F.when(F.col("shared") > 0, F.round(sets.pair_score("jaccard", F.col("least"), F.col("qs") + F.col("cs")), 9))
    return both.select("q", "c", F.round(sets.pair_score("dice", F.col("tags"), F.col("qt") + F.col("ct")), 9).alias("score"), second.alias("second"), "qn", "cn")


SWEEP = [(t, w) for t in (0, 1, 2, 3) for w in (0.05, 0.1, 0.2, 0.3)]  # 0 tags at least: the signal without a gate


@query("corroboration_sweep", sql_pairs(SQL_PLAIN, "dice") + f""", {SQL_RETURNED}, raw AS (SELECT q, c, least(x.n, y.n) AS n, round(m / (x.t + y.t - m), 9) AS s FROM both2 JOIN rt x ON x.id = q JOIN rt y ON y.id = c),
    every AS (SELECT t, w, q, c, round(score + w * CASE WHEN n >= t THEN s ELSE 0 END, 12)::DOUBLE AS score FROM scored LEFT JOIN raw USING (q, c), (SELECT unnest([0, 1, 2, 3]) AS t), (SELECT unnest([0.05, 0.1, 0.2, 0.3])::DOUBLE AS w)),
    best AS (SELECT t, w, q, c, score FROM (SELECT *, row_number() OVER (PARTITION BY t, w, q ORDER BY score DESC, c) AS n FROM every) WHERE n = 1),
    plain AS (SELECT q, c FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS n FROM scored) WHERE n = 1)
    SELECT t AS threshold, w AS weight, count(*) AS n, count(*) FILTER (best.c <> plain.c) AS changed, round(avg(score), 9) AS mean_score FROM best JOIN plain USING (q) GROUP BY ALL""")
def corroboration_sweep(spark, sf_dir):
    """How often a second signal changes a query's best item, over the tags that both sides need and the signal's weight, the signal without a gate among them.

    All settings are aggregates of one pass over the pairs, added up before the shuffle.
    """
    pairs = two_signals(spark, sf_dir)

    def best(t: int, weight: float):
        signal = F.coalesce(sets.gated(F.col("qn"), F.col("cn"), F.col("second"), t), F.lit(0.0))
        score = F.when(signal == 0, F.col("score")).otherwise(F.round(F.col("score") + weight * signal, 12))  # to nine places already
        return F.min(F.struct((-score).alias("score"), "c"))

    settings = [F.struct(F.lit(t).alias("threshold"), F.lit(x).alias("weight"), best(t, x).alias("best")) for t, x in SWEEP]
    by_query = pairs.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("score"), "c")).alias("plain"), F.array(*settings).alias("settings"))
    each = by_query.select("plain.c", F.explode("settings").alias("x"))
    return each.groupBy("x.threshold", "x.weight").agg(F.count("*").alias("n"), F.count_if(F.col("x.best.c") != F.col("c")).alias("changed"), F.round(F.avg(-F.col("x.best.score")), 9).alias("mean_score"))


@query("coverage_report", f"WITH {SQL_TAGS}, rich AS (SELECT id, count(*) AS n FROM items GROUP BY id) SELECT t AS threshold, count(*) FILTER (n >= t) AS covered, round(100.0 * count(*) FILTER (n >= t) / count(*), 9)::DOUBLE AS percent FROM rich, (SELECT unnest([2, 3, 4, 5, 6]) AS t) GROUP BY t")
def q_coverage(spark, sf_dir):
    rich = tags(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))
    at = [2, 3, 4, 5, 6]
    got = rich.agg(F.count("*").alias("all"), *(F.count_if(F.col("n") >= t).alias(str(t)) for t in at))
    return got.select("all", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col(str(t)).alias("n")) for t in at))).alias("x")).select(F.col("x.t").alias("threshold"), F.col("x.n").alias("covered"), F.round(100.0 * F.col("x.n") / F.col("all"), 9).alias("percent"))


@query("motif_pairs", f"WITH {SQL_TAGS} SELECT a.id AS q, b.id AS c, count(*) AS n_shared FROM items a JOIN items b ON a.tag = b.tag AND a.id < b.id WHERE a.id % 20 = 0 GROUP BY ALL")
def q_motifs(spark, sf_dir):
    w = plain(spark, sf_dir)
    return sets.shared(asked(w), w).where("q < c").select("q", "c", F.col("shared").cast("long").alias("n_shared"))


# --- vectors ------------------------------------------------------------------------------------

SQL_COS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), cos AS (SELECT a.id AS q, b.id AS c, a.label AS ql, b.label AS cl, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0)"
SQL_RANKED = SQL_COS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) AS rank FROM cos)"
SQL_TRUTH = "truth AS (SELECT a.vec_id AS q, b.vec_id AS t FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 100 WHERE a.vec_id % 20 = 0)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("label", F.col("label").cast("long"))


def cosines(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    v = vectors(spark, sf_dir)
    return cosine_scores(asked(v), v, **options)


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = vectors(spark, sf_dir)
    return top_neighbours(asked(v), v, k)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later items of the same label within a hundred ids."""
    v = vectors(spark, sf_dir).select("id", "label")
    near = v.select("label", F.col("id").alias("t"), F.floor(F.col("id") / 100).alias("b"))
    own = asked(v).select("label", F.col("id").alias("q"), F.explode(F.array(F.floor(F.col("id") / 100), F.floor(F.col("id") / 100) + 1)).alias("b"))
    return own.join(near, ["label", "b"]).where("t > q AND t <= q + 100").select("q", "t")


@query("cosine_topk", f"WITH {SQL_RANKED} SELECT q, c, cosine, rank FROM ranked WHERE rank <= {K}")
def q_cosine_topk(spark, sf_dir):
    return neighbours(spark, sf_dir, K).select("q", "c", "cosine", F.col("rank").cast("long"))


@query("cosine_pairs", f"WITH {SQL_COS} SELECT q, c, cosine FROM cos WHERE cosine >= 0.25")
def q_cosine_pairs(spark, sf_dir):
    return cosines(spark, sf_dir, least=0.249).withColumn("cosine", F.round("cosine", 9)).where("cosine >= 0.25")


# What rounds to nothing is 0.0; SQL's round alone leaves -0.0 of a negative number, so 0 is added.
@query("l2_normalize", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 9) + 0) AS unit FROM embeddings")
def q_l2(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), l2_rounded("v", 9).alias("unit"))


@query("export_vectors", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 6) + 0) AS vector FROM embeddings")
def q_export(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), l2_rounded("v", 6).alias("vector"))


@query("vector_search", f"WITH {SQL_RANKED} SELECT q, c, cosine, rank FROM ranked WHERE rank <= 20")
def q_search(spark, sf_dir):
    return neighbours(spark, sf_dir, 20).select("q", "c", "cosine", F.col("rank").cast("long"))


@query("cell_search", f"WITH {SQL_RANKED} SELECT q, c, cosine, rank FROM ranked WHERE rank <= {K}")
def q_cells(spark, sf_dir):
    """The same search by cells and blocks, as for query sets that are too large to send to all tasks."""
    v = vectors(spark, sf_dir)
    return ranked(nearest(asked(v), v, K), "cosine", K).select("q", "c", "cosine", F.col("rank").cast("long"))


SQL_DICE = "tagged AS (" + sql_pairs(SQL_WEIGHTED, "dice") + " SELECT q, c, score AS tag_score FROM scored)"
SQL_BLEND = f"WITH {SQL_COS}, {SQL_DICE}, blend AS (SELECT q, c, cosine, coalesce(tag_score, 0)::DOUBLE AS tag_score FROM cos LEFT JOIN tagged USING (q, c))"


def with_vector(w: DataFrame, v: DataFrame) -> DataFrame:
    """The rows of items that have a vector: where both signals count, no other item makes pairs of tags."""
    return w.join(v.where("v IS NOT NULL").select("id").distinct(), "id", "left_semi")


def candidates(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """q, c, cosine and tag_score of all pairs that may be among the first k of a query at any weight of the cosine above 0.

    A pair without a shared tag that k others pass by cosine is passed by them in any blend too, as
    tags only add. So the k best by cosine, ties kept, and the pairs that share a tag are enough.
    """
    v = vectors(spark, sf_dir)
    w = with_vector(weighted(spark, sf_dir), v)
    tag = sets.pair_scores(asked(w), w, "dice").select("q", "c", F.round("score", 9).alias("tag_score"))
    side = lambda name: v.where("v IS NOT NULL").select(F.col("id").alias(name), F.col("v").alias(f"{name}v"))
    tagged = tag.join(side("q"), "q").join(side("c"), "c").select("q", "c", F.round(cosine("qv", "cv"), 9).alias("cosine"), "tag_score")
    near = cosines(spark, sf_dir, top=k).withColumn("cosine", F.round("cosine", 9)).withColumn("tag_score", F.lit(0.0))
    return near.join(tag.select("q", "c"), ["q", "c"], "left_anti").unionByName(tagged)


@query("blended_neighbors", SQL_BLEND + f" SELECT * FROM (SELECT q, c, cosine, tag_score, round({ALPHA}::DOUBLE * cosine + (1 - {ALPHA}::DOUBLE) * tag_score, 12) AS score, row_number() OVER (PARTITION BY q ORDER BY round({ALPHA}::DOUBLE * cosine + (1 - {ALPHA}::DOUBLE) * tag_score, 12) DESC, c) AS rank FROM blend) WHERE rank <= {K}")
def q_blended(spark, sf_dir):
    scores = candidates(spark, sf_dir, K).withColumn("score", ALPHA * F.col("cosine") + (1 - ALPHA) * F.col("tag_score"))
    return ranked(scores, "score", K, places=BLEND_PLACES).select("q", "c", "cosine", "tag_score", "score", F.col("rank").cast("long"))


SQL_ALPHAS = SQL_BLEND + f""", {SQL_TRUTH}, alphas AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS alpha),
    s AS (SELECT alpha, q, c, row_number() OVER (PARTITION BY alpha, q ORDER BY round(alpha * cosine + (1 - alpha) * tag_score, 12) DESC, c) AS rank FROM blend, alphas),
    own AS (SELECT a.alpha, t.q, count(*) AS relevant, count(s.c) AS hits FROM truth t CROSS JOIN alphas a LEFT JOIN s ON s.alpha = a.alpha AND s.q = t.q AND s.c = t.t AND s.rank <= {K} GROUP BY ALL)
    SELECT alpha, count(*) AS n_queries, round(avg((hits > 0)::INT), 9) AS hit_rate, round(avg(hits / relevant), 9) AS recall, round(sum(hits) / sum(relevant), 9)::DOUBLE AS pooled_recall FROM own GROUP BY alpha"""


@query("alpha_sweep", SQL_ALPHAS)
def q_alphas(spark, sf_dir):
    """One ranking for every weight, over scores that are made once."""
    alphas, gt = F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("k"), truth(spark, sf_dir)
    scores = candidates(spark, sf_dir, K).select("q", "c", "cosine", "tag_score", alphas)
    best = ranked(scores.withColumn("score", F.col("k") * F.col("cosine") + (1 - F.col("k")) * F.col("tag_score")), "score", K, by=["k", "q"], places=BLEND_PLACES)
    hits = best.join(gt.withColumnRenamed("t", "c"), ["q", "c"], "left_semi").groupBy("k", "q").agg(F.count("*").alias("hits"))
    per = gt.groupBy("q").agg(F.count("*").alias("relevant")).select("q", "relevant", alphas).join(hits, ["k", "q"], "left").na.fill(0, ["hits"])
    return ev.metrics(per).withColumnRenamed("k", "alpha")


SQL_METRICS = "round(avg((hits > 0)::INT), 9) AS hit_rate, round(avg(hits / relevant), 9) AS recall, round(sum(hits) / sum(relevant), 9)::DOUBLE AS pooled_recall"


def sql_eval(ks: list[int]) -> str:
    return f"WITH {SQL_RANKED}, {SQL_TRUTH}, per AS (SELECT k, t.q, count(*) AS relevant, count(r.c) AS hits FROM truth t CROSS JOIN (SELECT unnest({ks}) AS k) LEFT JOIN ranked r ON r.q = t.q AND r.c = t.t AND r.rank <= k GROUP BY ALL) SELECT k, count(*) AS n_queries, {SQL_METRICS} FROM per GROUP BY k"


@query("eval_topk", sql_eval([K]))
def q_eval(spark, sf_dir):
    return ev.metrics(ev.hits_by_query(neighbours(spark, sf_dir, K), truth(spark, sf_dir), [K]))


@query("eval_k_sweep", sql_eval(KS))
def q_sweep(spark, sf_dir):
    return ev.metrics(ev.hits_by_query(neighbours(spark, sf_dir, max(KS)), truth(spark, sf_dir), KS))


@query("group_recall", f"WITH {SQL_RANKED}, per AS (SELECT q, ql, max((cl = ql)::INT) AS hit FROM ranked WHERE rank <= 5 GROUP BY ALL), g AS (SELECT ql::VARCHAR AS grp, count(*) AS size, round(avg(hit), 9) AS hit_rate FROM per GROUP BY ql) SELECT * FROM g UNION ALL SELECT 'AVERAGE', sum(size)::BIGINT, round(avg(hit_rate), 12) FROM g")
def q_groups(spark, sf_dir):
    label = vectors(spark, sf_dir).select("id", "label")
    near = neighbours(spark, sf_dir, 5).join(label.select(F.col("id").alias("q"), F.col("label").alias("ql")), "q").join(label.select(F.col("id").alias("c"), F.col("label").alias("cl")), "c")
    g = near.groupBy("q", "ql").agg(F.max((F.col("ql") == F.col("cl")).cast("int")).alias("hit")).groupBy(F.col("ql").cast("string").alias("grp")).agg(F.count("*").alias("size"), F.round(F.avg("hit"), 9).alias("hit_rate"))
    return g.unionByName(g.agg(F.lit("AVERAGE").alias("grp"), F.sum("size").alias("size"), F.round(F.avg("hit_rate"), 12).alias("hit_rate")))


@query("avg_rank", f"WITH {SQL_COS}, s AS (SELECT q, c, round(cosine, 2) AS score FROM cos) SELECT q, c, score, rank() OVER (PARTITION BY q ORDER BY score DESC) + (count(*) OVER (PARTITION BY q, score) - 1) / 2.0::DOUBLE AS avg_rank FROM s")
def q_avg_rank(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return average_ranks(asked(v), v)


@query("mutual_rank", f"WITH {SQL_RANKED} SELECT a.q AS a, b.q AS b, greatest(a.rank, b.rank) AS worst_rank FROM ranked a JOIN ranked b ON a.q = b.c AND a.c = b.q AND a.q < b.q")
def q_mutual(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return mutual_ranks(asked(v), v)


SQL_BEST = f"WITH {SQL_RANKED}, {SQL_TRUTH}, best AS (SELECT t.q, min(r.rank) AS best FROM truth t JOIN ranked r ON r.q = t.q AND r.c = t.t GROUP BY t.q)"


def best_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of each query's nearest true item; the other items are counted, not ranked."""
    v = vectors(spark, sf_dir).select("id", "v").where("v IS NOT NULL")
    side = lambda name: v.select(F.col("id").alias(name), F.col("v").alias(f"{name}v"))
    scored = truth(spark, sf_dir).withColumnRenamed("t", "c").join(side("q"), "q").join(side("c"), "c").select("q", "c", F.round(cosine("qv", "cv"), 9).alias("score"))
    best = scored.groupBy("q").agg(F.max(F.struct("score", (-F.col("c")).alias("c"))).alias("x")).select("q", (-F.col("x.c")).alias("c"), "x.score")
    return ranks_of(best, v).select("q", F.col("rank").alias("best"))


@query("miss_classes", SQL_BEST + " SELECT q, best, CASE WHEN best <= 10 THEN 'hit' WHEN best <= 20 THEN 'near_miss' ELSE 'deep_miss' END AS kind FROM best")
def q_misses(spark, sf_dir):
    return best_ranks(spark, sf_dir).withColumn("kind", F.when(F.col("best") <= 10, "hit").when(F.col("best") <= 20, "near_miss").otherwise("deep_miss"))


@query("rank_buckets", SQL_BEST + " SELECT bucket, n, round(n / sum(n) OVER (), 9)::DOUBLE AS share FROM (SELECT CASE WHEN best <= 10 THEN '<=10' WHEN best <= 20 THEN '11-20' ELSE '>20' END AS bucket, count(*) AS n FROM best GROUP BY ALL)")
def q_buckets(spark, sf_dir):
    counts = best_ranks(spark, sf_dir).groupBy(F.when(F.col("best") <= 10, "<=10").when(F.col("best") <= 20, "11-20").otherwise(">20").alias("bucket")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("bucket", "n", F.round(F.col("n") / F.col("all"), 9).alias("share"))


@query("rank_delta", SQL_BLEND + f", {SQL_TRUTH}, ra AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) AS a, row_number() OVER (PARTITION BY q ORDER BY round(0.5 * cosine + 0.5 * tag_score, 12) DESC, c) AS b FROM blend), d AS (SELECT ra.* FROM ra JOIN truth t ON t.q = ra.q AND t.t = ra.c) SELECT count(*) FILTER (b < a - 5) AS improved, count(*) FILTER (b > a + 5) AS worse, count(*) FILTER (abs(a - b) <= 5) AS same, median(a)::DOUBLE AS median_before, median(b)::DOUBLE AS median_after FROM d")
def q_delta(spark, sf_dir):
    """Ranks of the true pairs by cosine and by an even blend; the other items are counted.

    In the blend an item stands as by its cosine alone, but for those that share a tag: these are
    taken out of the count and put back with their blend. Twice the blend is cosine + tag_score.
    """
    v = vectors(spark, sf_dir).where("v IS NOT NULL")
    w = with_vector(weighted(spark, sf_dir), v)
    side = lambda name: v.select(F.col("id").alias(name), F.col("v").alias(f"{name}v"))
    scored = lambda pairs: pairs.join(side("q"), "q").join(side("c"), "c").withColumn("cosine", F.round(cosine("qv", "cv"), 9)).drop("qv", "cv")
    gt = truth(spark, sf_dir).withColumnRenamed("t", "c")
    tag = sets.pair_scores(asked(w), w, "dice").select("q", "c", F.round("score", 9).alias("tag_score"))
    tagged = scored(tag.join(gt.select("q").distinct(), "q", "left_semi"))
    true = scored(gt).join(tag, ["q", "c"], "left").select("q", "c", "cosine", F.round(F.col("cosine") + F.coalesce("tag_score", F.lit(0.0)), 9).alias("blend"))
    ahead = lambda s: ((s > F.col("blend")) | ((s == F.col("blend")) & (F.col("o") < F.col("c")))).cast("long")
    other = tagged.select("q", F.col("c").alias("o"), F.col("cosine").alias("plain"), F.round(F.col("cosine") + F.col("tag_score"), 9).alias("both"))
    moved = true.join(other, "q").where("o <> c").groupBy("q", "c").agg(F.sum(ahead(F.col("both")) - ahead(F.col("plain"))).alias("moved"))
    ranks = ranks_of(true, v, scores=["cosine", "blend"])
    d = ranks.join(moved, ["q", "c"], "left").select(F.col("cosine").alias("a"), (F.col("blend") + F.coalesce("moved", F.lit(0))).alias("b"), F.lit(0).alias("all"))
    counts = d.agg(F.count_if(F.col("b") < F.col("a") - 5).alias("improved"), F.count_if(F.col("b") > F.col("a") + 5).alias("worse"), F.count_if(F.abs(F.col("a") - F.col("b")) <= 5).alias("same"))
    for name, rank in (("median_before", "a"), ("median_after", "b")):
        counts = counts.join(F.broadcast(ev.quantiles(d, "all", rank, {name: 0.5}, width=1000).select(name)), how="left")  # one row each
    return counts


@query("signal_agreement", SQL_BLEND + " SELECT count(*) AS n, round(avg(tag_score), 9) AS mean_tag, round(avg(cosine), 9) AS mean_cosine FROM (SELECT * FROM blend ORDER BY cosine DESC, q, c LIMIT 200)")
def q_agreement(spark, sf_dir):
    return candidates(spark, sf_dir, 200).orderBy(F.desc("cosine"), "q", "c").limit(200).agg(F.count("*").alias("n"), F.round(F.avg("tag_score"), 9).alias("mean_tag"), F.round(F.avg("cosine"), 9).alias("mean_cosine"))


@query("top1_disagreement", SQL_BLEND + ", p AS (SELECT q, arg_max(c, (cosine, -c)) AS by_vector, arg_max(c, (tag_score, -c)) AS by_tag FROM blend GROUP BY q) SELECT * FROM p WHERE by_vector <> by_tag")
def q_disagreement(spark, sf_dir):
    """A query's best by vector is among its nearest, its best by tag among those that share one, or else the smallest id."""
    best = lambda s: F.max_by("c", F.struct(F.col(s), -F.col("c")))
    v = vectors(spark, sf_dir).where("v IS NOT NULL")
    smallest = [r["id"] for r in v.select("id").orderBy("id").limit(2).collect()]
    untagged = asked(v).select(F.col("id").alias("q"), F.explode(F.array(*map(F.lit, smallest)).cast("array<long>")).alias("c"), F.lit(None).cast("double").alias("cosine"), F.lit(0.0).alias("tag_score")).where("q <> c")
    return candidates(spark, sf_dir, 1).unionByName(untagged).groupBy("q").agg(best("cosine").alias("by_vector"), best("tag_score").alias("by_tag")).where("by_vector <> by_tag")


@query("family_compare", SQL_BLEND + ", f AS (SELECT e.label, cosine, tag_score FROM blend b JOIN embeddings e ON e.vec_id = b.q JOIN embeddings g ON g.vec_id = b.c AND g.label = e.label) SELECT label, count(*) AS n, round(avg(cosine), 9) AS mean_cosine, round(avg(tag_score), 9) AS mean_tag, round(avg(tag_score - cosine), 9) AS delta FROM f GROUP BY label")
def q_family(spark, sf_dir):
    """Cosines are added up where they are made; only pairs that share a tag are held."""
    v = labelled(spark, sf_dir)
    w = with_vector(weighted(spark, sf_dir), v)
    near = score_counts(asked(v), v, BILLION).where("same = 1").groupBy("label").agg(F.sum("n").alias("n"), (F.sum("total").cast("double") / BILLION).alias("cosine"))
    label = v.where("v IS NOT NULL").select("id", "label")
    tag = sets.pair_scores(asked(w), w, "dice").select("q", "c", F.round("score", 9).alias("tag_score"))
    shared = tag.join(label.select(F.col("id").alias("q"), "label"), "q").join(label.select(F.col("id").alias("c"), "label"), ["c", "label"]).groupBy("label").agg(F.sum("tag_score").alias("tag"))
    s = near.join(shared, "label", "left").na.fill(0.0, ["tag"])
    mean = lambda x: F.round(x / F.col("n"), 9)
    return s.select(F.col("label").cast("int").alias("label"), "n", mean(F.col("cosine")).alias("mean_cosine"), mean(F.col("tag")).alias("mean_tag"), mean(F.col("tag") - F.col("cosine")).alias("delta"))


# The mean over all pairs of a cluster follows from the sum of its unit vectors: no pair is made.
@query("cluster_purity", "WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.label, count(*) AS pairs, avg(list_cosine_similarity(a.v, b.v)) AS purity FROM v a JOIN v b ON a.label = b.label AND a.id < b.id GROUP BY a.label), s AS (SELECT label, count(*) AS size FROM v GROUP BY label) SELECT label, size, round(purity, 7) AS purity, round(sum(size * purity) OVER () / sum(size) OVER (), 7) AS weighted FROM p JOIN s USING (label)")
def q_purity(spark, sf_dir):
    unit = vectors(spark, sf_dir).select("label", F.posexplode(l2_normalized("v")).alias("i", "x"))
    sums = unit.groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    size = F.first("n")
    g = sums.groupBy("label").agg(size.alias("size"), ((F.sum(F.col("s") * F.col("s")) - size) / (size * (size - 1))).alias("purity")).where("size > 1")
    total = g.agg(F.sum(F.col("size") * F.col("purity")).alias("a"), F.sum("size").alias("b"))
    return g.crossJoin(F.broadcast(total)).select("label", "size", F.round("purity", 7).alias("purity"), F.round(F.col("a") / F.col("b"), 7).alias("weighted"))


@query("verdict_stats", f"WITH {SQL_COS} SELECT (ql = cl) AS verdict, count(*) AS n, round(avg(cosine), 9) AS mean, round(median(cosine), 12) AS median FROM cos GROUP BY ALL")
def q_verdicts(spark, sf_dir):
    v = labelled(spark, sf_dir)
    got = score_quantiles(asked(v), v, "same", {"median": 0.5})
    return got.select(F.when(F.col("same") < 2, F.col("same") == 1).alias("verdict"), "n", F.round("mean", 9).alias("mean"), F.round("median", 12).alias("median"))


@query("score_percentiles", f"WITH {SQL_COS} SELECT ql AS label, round(quantile_cont(cosine, 0.1), 12) AS p10, round(quantile_cont(cosine, 0.25), 12) AS p25, round(quantile_cont(cosine, 0.75), 12) AS p75, min(cosine) AS low, max(cosine) AS high FROM cos GROUP BY ql")
def q_percentiles(spark, sf_dir):
    v = labelled(spark, sf_dir)
    at = {"p10": 0.1, "p25": 0.25, "p75": 0.75, "low": 0.0, "high": 1.0}
    return score_quantiles(asked(v), v, "label", at).select(F.col("label").cast("int").alias("label"), *(F.round(p, 12).alias(p) for p in at))


THRESHOLDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]


@query("threshold_sweep", f"WITH {SQL_COS} SELECT ql AS label, t::DOUBLE AS threshold, round(avg((cosine >= t)::INT), 9) AS survival FROM cos, (SELECT unnest({THRESHOLDS})::DOUBLE AS t) GROUP BY ALL")
def q_thresholds(spark, sf_dir):
    """Thresholds are ends of bins, so the counts of bins are enough."""
    v = labelled(spark, sf_dir)
    width = BILLION // 10
    got = score_counts(asked(v), v, width).groupBy("label").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("bin") >= round(t * 10), F.col("n")).otherwise(0)).alias(str(i)) for i, t in enumerate(THRESHOLDS)))
    shares = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), (F.col(str(i)) / F.col("n")).alias("s")) for i, t in enumerate(THRESHOLDS)))).alias("x")
    return got.select(F.col("label").cast("int").alias("label"), shares).select("label", F.col("x.t").alias("threshold"), F.round("x.s", 9).alias("survival"))


@query("kmeans_clusters")
def q_kmeans(spark, sf_dir):
    """Clusters of unit vectors; the best of ten starts by cost. Rows only: no seed of SQL's gives the same."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, sf_dir).select("id", array_to_vector(l2_normalized("v")).alias("features"))
    fitted = [KMeans(k=10, seed=s, maxIter=20).fit(v) for s in range(10)]
    return min(fitted, key=lambda m: m.summary.trainingCost).transform(v).select(F.col("id").alias("vec_id"), F.col("prediction").alias("cluster"))
