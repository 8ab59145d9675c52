"""Signatures of Python methods: a fold over tokens that counts brackets, so that only real commas part arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings, comments, names, arrows, stars, and any other sign; numbers and white space are passed over.
TOKEN = r"""(?s)"{3}.*?"{3}|'{3}.*?'{3}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|#[^\n]*|\d[\w.]*|[\p{L}_][\p{L}\p{N}_]*|->|\*+|[^\s\p{L}\p{N}_]"""
NAME = r"^[\p{L}_]"
STATE = "struct<depth:int,part:string,star:boolean,counted:boolean,n:int,args:array<string>,ret:array<string>>"


def signature(stub: Column, method: Column) -> Column:
    """n_args, and the names in the types of arguments and result, of the first method of that name.

    Arguments are those a call may name or place: not self, none before a slash or after a star.
    Defaults and strings say nothing of types. Null without such a method, or if its head never ends.
    """
    head = F.concat(F.lit(r"(?s)(?:^|.*?\n)[ \t]*(?:async[ \t]+)?def[ \t]+"), method, F.lit(r"[ \t]*\((.*)$"))
    after = F.call_function("regexp_extract", stub, head, F.lit(1))
    found = F.rlike(stub, head)

    def state(s: Column, **changes: Column) -> Column:
        names = ("depth", "part", "star", "counted", "n", "args", "ret")
        return F.struct(*((changes[n] if n in changes else s[n]).alias(n) for n in names)).cast(STATE)

    def step(s: Column, t: Column) -> Column:
        depth, part, none = s["depth"], s["part"], F.lit(False)
        named = F.rlike(t, F.lit(NAME)) & ~t.isin("True", "False")
        counts = ~s["star"] & (t != "self")
        argument = (
            F.when(t == ",", state(s, part=F.lit("name"), counted=none))
            .when((t == ":") & (part == "name"), state(s, part=F.lit("type")))
            .when(t == "=", state(s, part=F.lit("default")))
            .when(F.startswith(t, F.lit("*")) & (part == "name"), state(s, star=F.lit(True)))
            .when((t == "/") & (part == "name"), state(s, n=F.lit(0), args=F.array().cast("array<string>")))
        )
        listed = (
            F.when(part == "done", s)
            .when(t.isin("(", "[", "{"), state(s, depth=depth + 1))
            .when(t.isin(")", "]", "}") & (depth == 1) & part.isin("name", "type", "default"), state(s, depth=F.lit(0), part=F.lit("after")))
            .when(t.isin(")", "]", "}"), state(s, depth=depth - 1))
            .when((part == "after") & (t == "->"), state(s, part=F.lit("ret")))
            .when(part.isin("after", "ret") & (depth == 0) & (t == ":"), state(s, part=F.lit("done")))
            .when((part == "ret") & named, state(s, ret=F.concat(s["ret"], F.array(t))))
            .when((depth == 1) & (part == "name") & named & ~s["counted"], state(s, n=s["n"] + counts.cast("int"), counted=counts))
            .when((part == "type") & named & s["counted"], state(s, args=F.concat(s["args"], F.array(t))))
        )
        return F.coalesce(listed, F.when((depth == 1) & ~part.isin("after", "ret"), argument), s)

    start = F.struct(F.lit(1).alias("depth"), F.lit("name").alias("part"), F.lit(False).alias("star"), F.lit(False).alias("counted"), F.lit(0).alias("n"), F.array().alias("args"), F.array().alias("ret")).cast(STATE)
    # Prefixes of strings are names beside them, so strings go with theirs.
    tokens = F.regexp_extract_all(F.regexp_replace(after, r"""\b(?i:[rbuf]{1,2})(?=["'])""", ""), F.lit(TOKEN), F.lit(0))
    end = lambda s: F.when(s["part"] == "done", F.struct(s["n"].alias("n_args"), s["args"].alias("args"), s["ret"].alias("ret")))
    return F.when(found, F.aggregate(tokens, start, step, end))


def signature_bag(stub: Column, method: Column) -> Column:
    """The signature as sorted tokens: arg:T for every name in an argument's type, ret:T for the result's, nargs:n."""
    marked = lambda names, kind: F.transform(names, lambda t: F.concat(F.lit(kind), t))
    bag = lambda s: F.when(s.isNotNull(), F.array_sort(F.concat(marked(s["args"], "arg:"), marked(s["ret"], "ret:"), F.array(F.concat(F.lit("nargs:"), s["n_args"].cast("string"))))))
    return F.get(F.transform(F.array(signature(stub, method)), bag), F.lit(0))
