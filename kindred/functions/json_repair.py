"""Near-valid JSON made valid: a fold over its tokens with a stack of open brackets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole string in either quotes, one that never ends, a sign, or a run of anything else.
TOKEN = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|["'].*\z|[{}\[\]:,]|[^\s{}\[\]:,"']+"""
NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"
STATE = "struct<out:string,stack:string,last:string>"


def _quoted(body: Column) -> Column:
    """A body in double quotes, with quotes, line ends, tabs and backslashes that escape nothing escaped."""
    plain = F.regexp_replace(body, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    plain = F.regexp_replace(plain, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrtu])', r'$1\\\\')
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), plain, F.lit('"'))


def _value(token: Column) -> Column:
    """A string or literal as JSON has it."""
    whole = F.rlike(token, F.lit(r"""(?s)^(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')$"""))
    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    inner = F.when(F.startswith(token, F.lit("'")), F.regexp_replace(inner, r"(?<!\\)((?:\\\\)*)\\'", "$1'")).otherwise(inner)
    # A string that never ends, as where its last quote is escaped by mistake: without that quote and the brackets after it.
    open_ = F.regexp_replace(F.regexp_replace(F.substr(token, F.lit(2)), r"""(?s)\\["'][\s}\]]*\z""", ""), r"(?s)(?<!\\)((?:\\\\)*)\\\z", "$1")
    word = F.when(F.lower(token).isin("true", "false", "null"), F.lower(token)).when(token == "None", "null").when(F.rlike(token, F.lit(NUMBER)), token)
    text = F.rlike(token, F.lit(r"""^["']"""))
    return F.when(~text, F.coalesce(word, _quoted(F.replace(token, F.lit("\\"), F.lit("\\\\"))))).when(whole, _quoted(inner)).otherwise(_quoted(open_))


def repaired(x: Column) -> Column:
    """x with commas, quotes and brackets put right, as far as these rules go:

    - a comma before a closing bracket, or after no value, goes; one between two values comes in;
    - a closing bracket closes what is open inside its own; one that nothing opened goes;
    - what is open at the end is closed, a string too, less a quote that was escaped by mistake;
    - single quotes become double ones, bare words strings, True, False and None their names in JSON;
    - line ends and tabs inside strings are escaped; a key without a value after its colon has null.
    """

    def step(s: Column, t: Column) -> Column:
        out, stack, last = s["out"], s["stack"], s["last"]
        state = lambda o, k, n: F.struct(o.alias("out"), k.alias("stack"), F.lit(n).alias("last"))
        between = F.when(last.isin("value", "comma"), ",").otherwise("")
        filled = F.when(last == "colon", "null").otherwise("")
        depth = F.instr(stack, t)
        opened = state(F.concat(out, between, t), F.concat(F.when(t == "{", "}").otherwise("]"), stack), "open")
        closed = F.when(depth == 0, s).otherwise(state(F.concat(out, filled, F.left(stack, depth)), F.substr(stack, depth + 1), "value"))
        comma = F.when(last == "value", state(out, stack, "comma")).when(last == "colon", state(F.concat(out, F.lit("null")), stack, "comma")).otherwise(s)
        colon = F.when(last == "value", state(F.concat(out, F.lit(":")), stack, "colon")).otherwise(s)
        return F.when(t.isin("{", "["), opened).when(t.isin("}", "]"), closed).when(t == ",", comma).when(t == ":", colon).otherwise(state(F.concat(out, between, _value(t)), stack, "value"))

    start = F.struct(F.lit("").alias("out"), F.lit("").alias("stack"), F.lit("open").alias("last")).cast(STATE)
    end = lambda s: F.concat(s["out"], F.when(s["last"] == "colon", "null").otherwise(""), s["stack"])
    return F.aggregate(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), start, lambda s, t: step(s, t).cast(STATE), end)


def named(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once, however often f names it; nor is a struct that f makes split up and computed field by field."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def json_or_repaired(x: Column) -> Column:
    """x where it parses as it is, else repaired where that parses, else null."""
    valid = lambda r: F.when(F.try_parse_json(r).isNotNull(), r)
    return named(x, lambda y: F.coalesce(valid(y), named(repaired(y), valid)))
