"""Posts and their code blocks, nested reactions, and indentation, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.json_repair import json_or_repaired, named
from kindred.functions.markdown import code_blocks  # noqa: F401  posts are where their users look for it

#: Most candidates of one problem that are looked at.
CANDIDATES = 6


def first_match(items: Column, test: Callable[[Column], Column]) -> Column:
    """The first element that meets a test; null if none does."""
    return F.get(F.filter(items, test), F.lit(0))


def votes(reactions: Column, kind: str = "UPVOTE") -> Column:
    """The count of the first reaction (type, count) of a kind; 0 without one."""
    return F.coalesce(first_match(reactions, lambda r: r["type"] == kind)["count"], F.lit(0))


def dedented(code: Column) -> Column:
    """Without the white space that all lines with text begin with; lines without any become empty."""
    full = lambda x: F.rlike(x, F.lit(r"\S"))
    common = lambda a, b: F.when(F.startswith(b, a), a).otherwise(F.left(a, F.array_max(F.filter(F.sequence(F.lit(0), F.length(a)), lambda i: F.left(a, i) == F.left(b, i)))))

    def cut(lines: Column, margin: Column) -> Column:
        return F.array_join(F.transform(lines, lambda x: F.when(full(x), F.substr(x, F.length(margin) + 1)).otherwise("")), "\n")

    def margin(lines: Column) -> Column:
        insets = F.transform(F.filter(lines, full), lambda x: F.regexp_extract(x, r"^[ \t]*", 0))
        return named(insets, lambda used: F.coalesce(F.aggregate(used, F.get(used, F.lit(0)), common), F.lit("")))

    return named(F.split(code, "\n"), lambda lines: named(margin(lines), lambda m: cut(lines, m)))


def indented(code: Column) -> Column:
    """One level in, lines without text left alone."""
    return F.regexp_replace(code, r"(?m)^(?=.*\S)", "    ")


def in_class(code: Column) -> Column:
    """A bare method as one of a class."""
    return F.concat(F.lit("class Solution:\n"), indented(dedented(code)))


def bucketed(n: Column, cap: int) -> Column:
    """A small number as such, others as one bucket."""
    return F.when(n < cap, n.cast("string")).otherwise(F.lit(f"{cap}+"))


def literal_list(x: Column) -> Column:
    """The strings of a literal list, in single or double quotes; anything else gives an empty list."""
    item = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
    found = F.regexp_extract_all(x, F.lit(item), F.lit(0))
    plain = F.transform(found, lambda s: F.regexp_replace(F.substr(s, F.lit(2), F.length(s) - 2), r"\\(.)", "$1"))
    return F.when(F.rlike(x, F.lit(r"^\s*\[.*\]\s*$")), plain).otherwise(F.array().cast("array<string>"))


def parsed_taxonomy(x: Column) -> Column:
    """ok, error and the phases and algorithm of a described taxonomy in JSON: phases need a label and a role each, the algorithm some text."""
    filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))

    def judged(got: Column) -> Column:
        phases = F.coalesce(F.forall(got["phases"], lambda p: filled(p["label"]) & filled(p["role"])), F.lit(False))
        lists = got["phases"].isNotNull() & got["tags"].isNotNull()
        error = F.when(got.isNull() | ~lists, "lists missing").when(~phases, "bad phases").when(~filled(got["algorithm"]), "no algorithm")
        return named(error, lambda e: F.struct(e.isNull().alias("ok"), e.alias("error"), F.when(e.isNull(), got).alias("value")))

    shape = "phases array<struct<label:string,role:string>>, tags array<string>, algorithm string"
    return named(F.from_json(json_or_repaired(F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))), shape), judged)


def parsed_mapping(x: Column, keys: Column) -> Column:
    """Of a mapping in JSON what is said of the keys; a key that it lacks, or maps to nothing, is mapped to itself."""
    got = F.from_json(x, "map<string,string>")
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.nullif(F.trim(F.get(F.map_values(F.map_filter(got, lambda a, _: a == k)), F.lit(0))), F.lit("")), k)))
