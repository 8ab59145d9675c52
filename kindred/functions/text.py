"""Text functions as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.json_repair import json_or_repaired, named
from kindred.functions.signatures import signature_bag  # noqa: F401  one of the functions of text
from pyspark.sql.types import StringType

# Words that give away a story, and what stands in for each.
SYNONYMS = {
    "stone": "element", "pile": "group", "course": "task", "prerequisite": "dependency", "semester": "round", "student": "participant", "coin": "token",
    "ghost": "pursuer", "building": "node", "cat": "pursuer", "mouse": "evader", "senate": "faction", "atom": "unit", "potion": "item",
}

# Patterns of complexity classes and their ranks; the first that matches counts.
COMPLEXITIES = (
    (r"O\(\s*1\s*\)", 0.0), (r"O\(\s*log\s*\(?\s*\w+\s*\)?\s*\)", 1.0), (r"O\(\s*\w+\s*\+\s*\w+\s*\)", 2.0), (r"O\(\s*\w+\s*\)", 2.0), (r"O\(\s*\w+\s*log\s*\(?\s*\w+\s*\)?\s*\)", 3.0),
    (r"O\(\s*\w+\^2\s*log\s*\(?\s*\w+\s*\)?\s*\)", 4.5), (r"O\(\s*\w+\s*\*\s*\w+\s*\)", 3.5), (r"O\(\s*\w+\^2\s*\)", 4.0), (r"O\(\s*\w+\^3\s*\)", 5.0), (r"O\(\s*2\^\w+\s*\)", 6.0), (r"O\(\s*\w+!\s*\)", 7.0),
)

# Roman numerals that mark a sequel in a slug.
NUMERALS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]
SEQUELS = "|".join(NUMERALS)

# The tags that are dropped whole, and those that end a line.
IMAGE = r"(?i)<img\b[^>]*>"
BLOCK = r"(?i)</?(p|div|pre|ul|ol|li|br|h[1-6])\b[^>]*>"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: str | Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """All entities of HTML resolved once."""
    return x.map(html.unescape, na_action="ignore")


def html_to_text(x: str | Column) -> Column:
    """Images go, block tags become line ends, other tags go, entities are resolved, blank lines shrink to one."""
    t = F.regexp_replace(_c(x), IMAGE, "")
    t = F.regexp_replace(t, BLOCK, "\n")
    t = unescaped(F.regexp_replace(t, r"<[^>]+>", ""))
    return trim_ws(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def leaked_words(x: str | Column, words: list[str]) -> Column:
    """The words, in their order, that stand in the text as such or in the plural."""
    low = F.lower(_c(x))
    return F.array_compact(F.array(*(F.when(F.rlike(low, F.lit(rf"(?U)\b{w}e?s?\b")), w) for w in words)))


def scrubbed(x: str | Column, synonyms: dict[str, str]) -> Column:
    """Every word and its plural replaced, the first letter's case kept; only texts that hold a word pay for its patterns."""

    def without(t: Column, w: str, r: str) -> Column:
        out = t
        for case, made in ((r"(?=\p{Lu})", str.capitalize), ("", str)):
            out = F.regexp_replace(out, rf"(?U)\b{case}(?i:{w}e?s)\b", made(r + "s"))
            out = F.regexp_replace(out, rf"(?U)\b{case}(?i:{w}e?)\b", made(r))
        return F.when(F.contains(F.lower(t), F.lit(w)), out).otherwise(t)

    t = _c(x)
    for w, r in synonyms.items():
        # The array of one gives the text a name, so that it is not computed once for each use.
        t = F.get(F.transform(F.array(t), lambda u: without(u, w, r)), F.lit(0))
    return t


def family_base(slug: str | Column) -> Column:
    """The slug up to its first token that is a roman numeral."""
    return F.regexp_replace(_c(slug), rf"(^|-)({SEQUELS})(-.*)?$", "")


def is_family_pair(a: str | Column, b: str | Column) -> Column:
    """The same base, and a numeral cut from one of them at least."""
    return (family_base(a) == family_base(b)) & ((family_base(a) != _c(a)) | (family_base(b) != _c(b)))


def complexity_rank(x: str | Column) -> Column:
    """The rank of the first stated time complexity, null if none is stated or known."""
    stated = F.regexp_extract(_c(x), r"(?s)Time complexity:.*?\$\$(.*?)\$\$", 1)
    out = F.lit(None).cast("double")
    for pattern, rank in reversed(COMPLEXITIES):
        out = F.when(F.rlike(stated, F.lit(pattern)), rank).otherwise(out)
    return out


def sections(x: str | Column) -> Column:
    """Approaches of an article: index (stated or by place), uuid of the first playground, and text."""
    parts = F.split(_c(x), r"(?m)^#+\s*Approach(?=(?:\s+\d+)?\s*:)")
    bodies = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    filled = lambda x: F.when(x != "", x)
    number = lambda p: filled(F.regexp_extract(p, r"^\s+(\d+)\s*:", 1))
    return F.transform(bodies, lambda p, i: F.struct(F.coalesce(number(p).cast("int"), i + 1).alias("index"), filled(F.regexp_extract(p, "playground/([A-Za-z0-9]+)/shared", 1)).alias("uuid"), F.regexp_replace(p, r"^(\s+\d+)?\s*:", "").alias("text")))


def recommended(x: str | Column) -> Column:
    """The approaches that the first recommendation names, up to its full stop."""
    tail = F.regexp_extract(_c(x), r"(?is)recommend\b(.{0,400})", 1)
    window = F.regexp_replace(tail, r"(?s)\.\s.*$", ".")
    return F.transform(F.regexp_extract_all(window, F.lit(r"Approach\s+(\d+)"), F.lit(1)), lambda n: n.cast("int"))


def json_object(x: str | Column) -> Column:
    """From the first brace to the last one; null if there is none."""
    return F.nullif(F.regexp_extract(_c(x), r"(?s)\{.*\}", 0), F.lit(""))


def parsed_analysis(x: str | Column) -> Column:
    """ok, error and the techniques and mechanism of a described solution in JSON; JSON that does not parse is repaired first."""
    filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))

    def judged(found: Column, got: Column) -> Column:
        techniques = F.coalesce((F.size(got["techniques"]) > 0) & F.forall(got["techniques"], lambda t: filled(t["name"]) & filled(t["role"])), F.lit(False))
        error = F.when(found.isNull(), "no JSON object").when(got.isNull() | (got["techniques"].isNull() & got["mechanism"].isNull()), "invalid JSON").when(~techniques, "bad techniques").when(~filled(got["mechanism"]), "no mechanism")
        return named(error, lambda e: F.struct(e.isNull().alias("ok"), e.alias("error"), F.when(e.isNull(), got).alias("value")))

    shape = "techniques array<struct<name:string,role:string>>, mechanism string"
    return named(json_object(x), lambda found: named(F.from_json(json_or_repaired(found), shape), lambda got: judged(found, got)))


def status_kind(status: str | Column) -> Column:
    """The status up to its colon."""
    return F.split(_c(status), ":")[0]


def truncated(x: str | Column, most: int = 200) -> Column:
    return F.when(F.length(_c(x)) > most, F.concat(F.left(_c(x), F.lit(most)), F.lit("..."))).otherwise(_c(x))


def visitor_key(ip: str | Column, salt: str) -> Column:
    return F.concat(F.lit("visitor:"), F.sha2(F.concat(_c(ip), F.lit(salt)), 256))


def best_approach(article: str | Column) -> Column:
    """The approach to take: the first recommended one if it has a playground, else the one of least complexity that has one, else the last that has one."""
    parts = sections(article)
    withid = F.filter(parts, lambda a: a["uuid"].isNotNull())
    first = F.get(recommended(article), F.lit(0))
    named = F.filter(parts, lambda a: a["index"] == first)
    chosen = F.get(named, F.size(named) - 1)  # of approaches with the same number the last counts
    costs = F.filter(F.transform(withid, lambda a, i: F.struct(complexity_rank(a["text"]).alias("r"), i.alias("i"))), lambda x: x["r"].isNotNull())
    least = F.get(withid, F.array_min(costs)["i"])
    return F.coalesce(F.when(chosen["uuid"].isNotNull(), chosen), least, F.get(withid, F.size(withid) - 1))


def fenced_code(x: str | Column) -> Column:
    """The body of the first fenced block, else the whole text."""
    body = F.regexp_extract(_c(x), r"(?s)```(?:python)?\s*\n(.*?)```", 1)
    return F.when(body != "", body).otherwise(_c(x))


def normalized_escapes(x: str | Column) -> Column:
    """Literal escape sequences made real where they are over twice as many as line ends."""
    t = _c(x)
    literal = (F.length(t) - F.length(F.replace(t, F.lit("\\n"), F.lit("")))) / 2
    real = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    out = t
    for a, b in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", "\t"), ("\\'", "'"), ('\\"', '"'), ("\\\\", "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(literal > 2 * real, out).otherwise(t)
