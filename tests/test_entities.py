"""The SQL of html_to_text resolves what HTML resolves: names without a semicolon, numbers, each once."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry

PAGES = [
    "a&ampb", "&amp;amp;", "x&notit;y", "&not;", "&#65;&#x42;c", "a&#0;b", "a&#128;b", "a&#xD800;b", "a&#x110000;b", "a&#1;b", "a&#xFFFE;b", "a&#xFDD0;b", "a&#99999999999999999999;b",
    "&unknown; z", "a & b && c", "a&ltb &gt", "z&acE;z", "", "plain", None, "&", "a&#;b", "a&#x;b", "&quot", "q&#39;s&copy", "&nbsp;<p>in&nbsp;side</p> &nbsp;", "<IMG src='a'>1<br/>2<p>\n\n\n</p>3",
]


def test_entities(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = dict(con.sql(entry.oracle_sql()["html_to_text"]).fetchall())
    got = {r.page_id: r.text for r in entry.queries()["html_to_text"](spark, str(tmp_path)).collect()}
    assert got == expected and got[0] == "a&b" and got[1] == "&amp;" and got[25] == "in side"
