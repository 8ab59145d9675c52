"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of a text is hashed and joined to the places where templates have it. A
hit at word p of the text and place t of a template votes for the diagonal p - t. Votes are added
up by diagonal; neighbouring diagonals, as insertions and deletions leave them, are merged; a
merged span is a license if enough of the template's k-grams are on it. Phrases of the base list
count only where all their words stand in a row: all votes on one diagonal.

Templates are a fixed list of a few hundred k-grams, so the join broadcasts them; texts are never
shuffled, only hits are, once, by row. Defined cases: a null text has no words; every row gets a
result row, repeated rows each their own; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.common import whole_text

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Characteristic passages of public licenses.
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "no part of this publication may be reproduced distributed or transmitted in any form without the prior written permission of the publisher"),
)
K = 3
WORD_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str = "text") -> Column:
    """The words of a text after A-Z are lowered. The two letters beyond ASCII whose lower case is in it are kept out of it."""
    kept = F.replace(F.replace(whole_text(text), F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001"))
    return F.array_remove(F.split(F.lower(kept), WORD_GAPS), "")


def templates(spark: SparkSession, base: dict[str, str], passages: tuple[tuple[str, str], ...], k: int = K) -> DataFrame:
    """One row per k-gram: its hash, the template, its place, and what the template has in all."""
    rows = [(i, label, is_base, n, len(w) - k + 1, " ".join(w[n : n + k])) for i, (is_base, label, phrase) in enumerate([(True, v, p) for p, v in base.items()] + [(False, *p) for p in passages]) if len(w := re.findall(r"\S+", phrase)) >= k for n in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "template int, label string, is_base boolean, place int, n_grams int, gram string")
    return df.select(F.xxhash64(F.split("gram", " ")).alias("gram"), "template", "label", "is_base", "place", "n_grams")


def license_spans(docs: DataFrame, base: dict[str, str] = BASE, passages: tuple[tuple[str, str], ...] = PASSAGES, k: int = K, slack: int = 2, share: float = 0.7) -> DataFrame:
    """One row per license span, and one with null label per text.

    Columns: _row, doc_id, n_words, label, is_base, first_word, last_word (of the span, from 0),
    score (the share of the template's k-grams found on it).
    """
    spark = docs.sparkSession
    shortest = min(len(p.split()) for p in base) if base else k
    if shortest < k:
        raise ValueError(f"base phrases need {k} words at least")
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id"), words_of().alias("_words"))
    n = F.size("_words")
    grams = F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice("_words", i, k)))).otherwise(F.array().cast("array<long>"))
    every = texts.select("_row", "doc_id", n.cast("long").alias("n_words"), grams.alias("_grams"))
    # Place 0 is the text itself: it keeps texts without hits.
    placed = every.select("_row", "doc_id", "n_words", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "_grams")).alias("_at", "gram"))
    known = F.broadcast(templates(spark, base, passages, k))
    hits = placed.join(known, "gram", "left").where(F.col("template").isNotNull() | (F.col("_at") == 0)).withColumn("diagonal", F.col("_at") - 1 - F.col("place")).repartition("_row")
    key = ["_row", "doc_id", "n_words", "template", "label", "is_base", "n_grams"]
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_set("place").alias("places"))
    across = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(across) > F.when(F.col("is_base"), 0).otherwise(slack), F.lit(True))
    merged = votes.withColumn("_new", apart.cast("int")).withColumn("_span", F.sum("_new").over(across)).groupBy(*key, "_span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"), F.min(F.col("diagonal") + F.array_min("places")).alias("first_word"), F.max(F.col("diagonal") + F.array_max("places") + (k - 1)).alias("last_word"))
    score = F.col("found") / F.col("n_grams")
    enough = F.col("template").isNull() | (score >= F.when(F.col("is_base"), 1.0).otherwise(share))
    return merged.where(enough).select("_row", "doc_id", "n_words", "label", "is_base", F.col("first_word").cast("long"), F.col("last_word").cast("long"), score.alias("score"))


def license_digest(spans: DataFrame) -> DataFrame:
    """One row per text: places of base phrases, their first and last word, labels and the best score."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.col("is_base")
    return spans.groupBy("_row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score")).drop("_row")


def oracle(base: dict[str, str] = BASE, passages: tuple[tuple[str, str], ...] = PASSAGES, k: int = K, slack: int = 2, share: float = 0.7) -> str:
    """The same votes and spans in SQL, on the grams' words in place of their hashes."""
    known = [(True, v, p) for p, v in base.items()] + [(False, *p) for p in passages]
    rows = ", ".join(f"({i}, '{label}', {is_base}, {n}, {len(w) - k + 1}, '{' '.join(w[n : n + k])}')" for i, (is_base, label, p) in enumerate(known) for w in [p.split()] for n in range(len(w) - k + 1))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH t(template, label, is_base, place, n_grams, gram) AS (VALUES {rows}),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        grams AS (SELECT r, p, array_to_string(list_slice(w, p + 1, p + {k}), ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - {k - 1})) AS p FROM d)),
        votes AS (SELECT DISTINCT r, template, label, is_base, n_grams, p - place AS diagonal, place FROM grams JOIN t USING (gram)),
        cuts AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > CASE WHEN is_base THEN 0 ELSE {slack} END, TRUE)::INT AS cut FROM (SELECT DISTINCT r, template, is_base, diagonal FROM votes)),
        numbered AS (SELECT r, template, diagonal, sum(cut) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM cuts),
        spans AS (SELECT r, label, is_base, count(DISTINCT place) / n_grams AS score, min(diagonal + place) AS first_word FROM votes JOIN numbered USING (r, template, diagonal) GROUP BY r, template, label, is_base, n_grams, span),
        good AS (SELECT * FROM spans WHERE score >= CASE WHEN is_base THEN 1.0 ELSE {share} END)
        SELECT doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (is_base) AS n_base, (min(first_word) FILTER (is_base))::BIGINT AS first_word, (max(first_word) FILTER (is_base))::BIGINT AS last_word,
            coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(score), 0)::DOUBLE AS score
        FROM d LEFT JOIN good USING (r) GROUP BY r, doc_id"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.registry import table

    return license_digest(license_spans(table(spark, sf_dir, "documents")))
