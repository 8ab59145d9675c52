"""Code blocks of Markdown: a fold over lines that knows fences, indented code, lists, quotes and paragraphs.

Only blocks of the text itself count; those inside list items and quotes are skipped, with the lines
that carry on such a paragraph. Blocks of raw HTML are taken as paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<info:string,body:string>"
#: mode is what the last line was part of: none, text, fence, code (indented), list or quote.
STATE = f"struct<mode:string,mark:string,width:int,inset:int,blank:boolean,info:string,body:string,gap:string,done:array<{BLOCK}>>"


def _lines(text: Column) -> Column:
    """Each line with what a block parser asks of it; a tab in front counts as four columns."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)^( {0,3})\t", "    ")

    def look(x: Column) -> Column:
        marked = F.rlike(x, F.lit(r"^ {0,3}[`~*+>#_\d-]"))  # what may open anything but a paragraph or indented code; other lines are not looked at further
        fence = F.regexp_extract(x, r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})", 1)
        item = F.regexp_extract(x, r"^( {0,3}(?:[-*+]|\d{1,9}[.)])(?: {1,4}(?=\S)| |$))", 1)
        rule = F.rlike(x, F.lit(r"^ {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$"))
        signs = F.when(marked, F.struct(
            fence.alias("fence"),
            F.trim(F.regexp_extract(x, r"^ {0,3}(?:`{3,}|~{3,})(.*)$", 1)).alias("info"),
            F.rlike(x, F.lit(r"^ {0,3}(?:`{3,}|~{3,}) *$")).alias("bare"),
            F.when((item != "") & ~rule, F.length(item)).otherwise(0).alias("item"),
            F.rlike(x, F.lit("^ {0,3}>")).alias("quote"),
            (rule | F.rlike(x, F.lit(r"^ {0,3}#{1,6}(?: |$)"))).alias("lone"),
        )).otherwise(F.struct(F.lit("").alias("fence"), F.lit("").alias("info"), F.lit(False).alias("bare"), F.lit(0).alias("item"), F.lit(False).alias("quote"), F.lit(False).alias("lone")))
        return F.struct(x.alias("x"), (F.length(x) - F.length(F.ltrim(x))).alias("inset"), (~F.rlike(x, F.lit(r"\S"))).alias("blank"), signs.alias("signs"))

    return F.transform(F.split(plain, "\n"), look)


def blocks(text: Column) -> Column:
    """info (what stands after an opening fence) and body of the code blocks, in order.

    A fenced body keeps its last line end and loses the fence's own inset; a fence that is never
    closed takes the rest. An indented body loses four columns and the blank lines around it; it
    cannot follow a paragraph without a blank line.
    """

    def state(s: Column, **changes: Column) -> Column:
        names = ("mode", "mark", "width", "inset", "blank", "info", "body", "gap", "done")
        return F.struct(*((changes[n] if n in changes else s[n]).alias(n) for n in names)).cast(STATE)

    def closed(s: Column) -> Column:
        """What is done once the open block ends."""
        own = F.array(F.struct(s["info"].alias("info"), s["body"].alias("body"))).cast(f"array<{BLOCK}>")
        return F.when(s["mode"].isin("fence", "code"), F.concat(s["done"], own)).otherwise(s["done"])

    def step(s: Column, n: Column) -> Column:
        x, mode, no = n["x"], s["mode"], F.lit(False)
        cut = lambda most: F.substr(x, F.least(n["inset"], most) + 1)
        # Inside a fence: a bare mark of the same kind, as long at least, ends it.
        ends = n["signs"]["bare"] & (n["signs"]["fence"] != "") & (F.left(n["signs"]["fence"], F.lit(1)) == s["mark"]) & (F.length(n["signs"]["fence"]) >= s["width"])
        inside = F.when(ends, state(s, mode=F.lit("none"), done=closed(s), blank=no)).otherwise(state(s, body=F.concat(s["body"], cut(s["inset"]), F.lit("\n"))))
        # Inside indented code: blank lines wait for what comes.
        goes_on = F.when(n["blank"], state(s, gap=F.concat(s["gap"], F.lit("\n"), F.substr(x, F.lit(5))))).otherwise(state(s, body=F.concat(s["body"], s["gap"], F.lit("\n"), F.substr(x, F.lit(5))), gap=F.lit("")))
        starts = (n["signs"]["fence"] != "") | n["signs"]["quote"] | n["signs"]["lone"] | (n["signs"]["item"] > 0)
        lazy = mode.isin("list", "quote") & ~s["blank"] & ~starts
        held = (mode == "list") & (n["inset"] >= s["inset"])
        fenced = state(s, mode=F.lit("fence"), mark=F.left(n["signs"]["fence"], F.lit(1)), width=F.length(n["signs"]["fence"]), inset=n["inset"], info=n["signs"]["info"], body=F.lit(""), done=closed(s), blank=no)
        code = state(s, mode=F.lit("code"), info=F.lit(""), body=F.substr(x, F.lit(5)), gap=F.lit(""), done=closed(s), blank=no)
        fresh = (
            F.when(n["signs"]["fence"] != "", fenced)
            .when(n["signs"]["quote"], state(s, mode=F.lit("quote"), done=closed(s), blank=no))
            .when(n["signs"]["lone"], state(s, mode=F.lit("none"), done=closed(s), blank=no))
            .when(n["signs"]["item"] > 0, state(s, mode=F.lit("list"), inset=n["signs"]["item"], done=closed(s), blank=no))
            .when((n["inset"] >= 4) & ((mode != "text") | s["blank"]), code)
            .otherwise(state(s, mode=F.lit("text"), done=closed(s), blank=no))
        )
        return (
            F.when(mode == "fence", inside)
            .when((mode == "code") & (n["blank"] | (n["inset"] >= 4)), goes_on)
            .when(n["blank"], state(s, blank=F.lit(True)))
            .when(held | lazy, state(s, blank=no))
            .otherwise(fresh)
        )

    start = F.struct(F.lit("none").alias("mode"), F.lit("").alias("mark"), F.lit(0).alias("width"), F.lit(0).alias("inset"), F.lit(False).alias("blank"), F.lit("").alias("info"), F.lit("").alias("body"), F.lit("").alias("gap"), F.array().alias("done")).cast(STATE)

    def end(s: Column) -> Column:
        # The text's last line has no line end of its own.
        rest = F.struct(s["info"].alias("info"), F.when(s["mode"] == "fence", F.regexp_replace(s["body"], r"\n\z", "")).otherwise(s["body"]).alias("body"))
        return F.when(s["mode"].isin("fence", "code"), F.concat(s["done"], F.array(rest).cast(f"array<{BLOCK}>"))).otherwise(s["done"])

    return F.aggregate(_lines(text), start, step, end)


def code_blocks(post: Column) -> Column:
    """The bodies of all code blocks, those tagged as Python first, each kind in its order."""
    python = lambda b: F.startswith(F.lower(b["info"]), F.lit("py"))
    both = lambda found: F.concat(F.filter(found, python), F.filter(found, lambda b: ~python(b)))
    return F.get(F.transform(F.array(blocks(post)), lambda found: F.transform(both(found), lambda b: b["body"])), F.lit(0))
