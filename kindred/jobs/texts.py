"""Text queries: pages to text, leaks and their repair, title words, samples."""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.jobs.registry import query, table
from kindred.operators import corpus as ops

#: Words of the given texts that stand for the words to avoid, and replacements.
LEAKS = {"the": "this", "of": "from", "and": "plus", "die": "jene", "que": "cual"}
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The entities that HTML names, those that end without a semicolon too, and numbers that stand for others or for nothing.
SQL_NAMED = "MAP {" + ", ".join(f"{_sql_text(name)}: {' || '.join(f'chr({ord(c)})' for c in text)}" for name, text in html5.items()) + "}"
SQL_ODD = "MAP {" + ", ".join(f"{n}: " + (f"chr({ord(text)})" if text else "''") for n, text in ((n, html.unescape(f"&#{n};")) for n in range(160)) if text != chr(n)) + "}"
SQL_NUMBER = "CASE WHEN r[2] IN ('x', 'X') THEN list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(lower(rtrim(r[3:], ';')), ''), lambda h: (strpos('0123456789abcdef', h) - 1)::HUGEINT)), lambda n, h: least(n * 16 + h, 1114112)) ELSE list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(rtrim(r[2:], ';'), ''), lambda h: (strpos('0123456789', h) - 1)::HUGEINT)), lambda n, h: least(n * 10 + h, 1114112)) END"
SQL_NOTHING = "(n BETWEEN 64976 AND 65007 OR (n % 65536 >= 65534 AND n > 65533))"
#: An entity or reference at most 32 letters long; of a name that is not known the longest beginning that is.
SQL_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@query("html_to_text", rf"""WITH stripped AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<img\b[^>]*>', '', 'gi'), '</?(p|div|pre|ul|ol|li|br|h[1-6])\b[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS x FROM pages),
    refs AS (SELECT DISTINCT unnest(regexp_extract_all(x, '{SQL_ENTITY}', 1)) AS r FROM stripped), named AS (SELECT {SQL_NAMED} AS names, {SQL_ODD} AS odd),
    numbers AS (SELECT r, {SQL_NUMBER} AS n FROM refs WHERE r[1] = '#'),
    known AS (SELECT r, CASE WHEN len(odd[n::INT]) IS NOT NULL THEN odd[n::INT] WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN {SQL_NOTHING} THEN '' ELSE chr(n::INT) END AS t FROM numbers, named
        UNION ALL SELECT r, coalesce(names[r], (SELECT names[r[:i]] || r[i + 1:] FROM (SELECT unnest(range(2, len(r))) AS i) WHERE names[r[:i]] IS NOT NULL ORDER BY i DESC LIMIT 1), '&' || r) FROM refs, named WHERE r[1] <> '#'),
    parts AS (SELECT page_id, x, regexp_split_to_array(x, '{SQL_ENTITY}') AS between_, regexp_extract_all(x, '{SQL_ENTITY}', 1) AS found FROM stripped),
    placed AS (SELECT page_id, i, found[i] AS r, between_[i] AS b FROM (SELECT page_id, found, between_, unnest(range(1, len(between_) + 1)) AS i FROM parts)),
    whole AS (SELECT page_id, string_agg(b || coalesce(t, ''), '' ORDER BY i) AS x FROM placed LEFT JOIN known USING (r) GROUP BY page_id)
    SELECT page_id, regexp_replace(regexp_replace(whole.x, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\t-\r\x{{85}}\p{{Z}}]+|[\t-\r\x{{85}}\p{{Z}}]+$', '', 'g') AS text FROM stripped LEFT JOIN whole USING (page_id)""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_to_text("html").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


SQL_LEAKED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{EDGE_L}{w}e?s?{EDGE_R}') THEN '{w}' END" for w in LEAKS) + "], lambda x: x IS NOT NULL)"


def leaked() -> Column:
    return tx.leaked_words("text", list(LEAKS))


@query("leak_words", f"SELECT doc_id, {SQL_LEAKED} AS leaked FROM documents")
def leak_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", leaked().alias("leaked"))


@query("leak_rate", f"SELECT lang, count(*) FILTER (len({SQL_LEAKED}) > 0) AS leaking, count(*) AS n, round(count(*) FILTER (len({SQL_LEAKED}) > 0) / count(*), 9) AS rate FROM documents GROUP BY lang")
def leak_rate(spark, sf_dir):
    hit = F.size(leaked()) > 0
    return documents(spark, sf_dir).groupBy("lang").agg(F.count_if(hit).alias("leaking"), F.count("*").alias("n"), F.round(F.count_if(hit) / F.count("*"), 9).alias("rate"))


@query("scrub_leaks")
def scrub_leaks(spark, sf_dir):
    """Texts with every leaked word replaced, case and plural kept. Rows only: SQL's patterns have no word edge beyond ASCII."""
    return documents(spark, sf_dir).select("doc_id", tx.scrubbed("text", LEAKS).alias("text"))


@query("substring_leaks", "SELECT doc_id, list_filter(['the', 'of', 'que'], lambda w: contains(lower(text), w)) AS leaked FROM documents")
def substring_leaks(spark, sf_dir):
    """The older, looser test: anywhere in the text."""
    low = F.lower("text")
    return documents(spark, sf_dir).select("doc_id", F.filter(F.array(*map(F.lit, ("the", "of", "que"))), lambda w: F.contains(low, w)).alias("leaked"))


SQL_TITLES = "titles AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name || '-' || p_type), ' '))) AS token FROM part)"


def title_tokens() -> Column:
    return F.array_distinct(F.split(F.lower(F.concat("p_name", F.lit("-"), "p_type")), " "))


@query("generic_tokens", f"WITH {SQL_TITLES} SELECT token, count(*) AS df FROM titles WHERE token <> '' GROUP BY token HAVING count(*) >= 8")
def generic_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(title_tokens()).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("df")).where("df >= 8")


@query("domain_terms", f"WITH {SQL_TITLES}, g AS (SELECT token FROM titles GROUP BY token HAVING count(*) >= 200) SELECT p_partkey, list_sort(list(token)) AS terms FROM titles WHERE token NOT IN (SELECT token FROM g) AND len(token) > 2 AND NOT regexp_full_match(token, '[0-9]+') GROUP BY p_partkey")
def domain_terms(spark, sf_dir):
    """Title words that are rare, longer than two letters and no number."""
    titles = table(spark, sf_dir, "part").select("p_partkey", F.explode(title_tokens()).alias("token"))
    generic = titles.groupBy("token").agg(F.count("*").alias("df")).where("df >= 200").select("token")
    return titles.where((F.length("token") > 2) & ~F.rlike("token", F.lit("^[0-9]+$"))).join(generic, "token", "left_anti").groupBy("p_partkey").agg(F.array_sort(F.collect_list("token")).alias("terms"))


@query("self_leak", f"WITH d AS (SELECT doc_id, text, regexp_extract(lower(text), '[a-z]{{5,}}') AS term FROM documents) SELECT doc_id, term, term <> '' AND regexp_matches(substr(lower(text), strpos(lower(text), term) + length(term)), '{EDGE_L}' || term || '{EDGE_R}') AS leaks FROM d")
def self_leak(spark, sf_dir):
    """Whether a text's own first long word stands anywhere after its first place; term_leaks looks for all rare words of the beginning."""
    d = documents(spark, sf_dir).select("doc_id", F.lower("text").alias("low")).withColumn("term", F.regexp_extract("low", "[a-z]{5,}", 0))
    return d.select("doc_id", "term", ((F.col("term") != "") & F.rlike(F.substr("low", F.position("term", "low") + F.length("term")), F.concat(F.lit(r"(?U)\b"), "term", F.lit(r"\b")))).alias("leaks"))


SQL_BAND = "CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1500 THEN 1 WHEN n_chars < 3000 THEN 2 ELSE 3 END"


def band() -> Column:
    n = F.col("n_chars")
    return F.when(n < 500, 0).when(n < 1500, 1).when(n < 3000, 2).otherwise(3)


@query("band_sample", f"SELECT doc_id, band FROM (SELECT doc_id, {SQL_BAND} AS band, row_number() OVER (PARTITION BY {SQL_BAND} ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 35")
def band_sample(spark, sf_dir):
    """A fixed quota of every band, in the order of a hash."""
    d = documents(spark, sf_dir).select("doc_id", band().alias("band"))
    w = Window.partitionBy("band").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return d.withColumn("n", F.row_number().over(w)).where("n <= 35").drop("n")


@query("chunking", "SELECT doc_id, source, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 120)::BIGINT AS chunk FROM documents")
def chunking(spark, sf_dir):
    return ops.chunked(documents(spark, sf_dir).select("doc_id", "source"), 120, "source", "doc_id")


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text FROM documents")
def truncate_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.truncated("text").alias("text"))


@query("usable_text", r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 AS usable FROM documents")
def usable_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", (F.length(tx.trim_ws("text")) >= 20).alias("usable"))


@query("title_tokens", "SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_name || '-' || p_type), ' '))) AS tokens FROM part")
def tokens_of_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(title_tokens()).alias("tokens"))
