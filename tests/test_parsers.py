"""Folds over tokens and lines: JSON repair, code blocks of Markdown, signatures of methods."""

from __future__ import annotations

import ast
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions.json_repair import json_or_repaired, repaired
from kindred.functions.markdown import blocks, code_blocks
from kindred.functions.signatures import signature_bag


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("raw, value", [
    ('{"a": 1, "b": [1, 2,],}', {"a": 1, "b": [1, 2]}),
    ('{"a": "text\\"}', {"a": "text"}),
    ('{"a": {"b": "deep\\"}}', {"a": {"b": "deep"}}),
    ('{"a": "never closed', {"a": "never closed"}),
    ('{"a": [1, {"b": 2', {"a": [1, {"b": 2}]}),
    ('{"a": [1, 2}', {"a": [1, 2]}),
    ('{"a": 1]}', {"a": 1}),
    ("{'a': 'it', 'b': 'say \"x\"'}", {"a": "it", "b": 'say "x"'}),
    ("{'a': 'it\\'s'}", {"a": "it's"}),
    ('{"a": 1 "b": 2 "c": [3 4]}', {"a": 1, "b": 2, "c": [3, 4]}),
    ('{a: True, b: None, c: False, d: word, e: -1.5e3}', {"a": True, "b": None, "c": False, "d": "word", "e": -1500}),
    ('{"a": "two\nlines\tand a tab"}', {"a": "two\nlines\tand a tab"}),
    ('{"a": , "b":}', {"a": None, "b": None}),
    ('{,"a":: 1,, "b": 2}', {"a": 1, "b": 2}),
    ('{"a": "back\\\\", "b": "\\u00e9\\"q\\""}', {"a": "back\\", "b": 'é"q"'}),
    ('{"a": "no \\escape", }', {"a": "no \\escape"}),
    ('{"a": 01}', {"a": "01"}),
    ("", None),
    ("{", {}),
])
def test_repairs(spark, raw, value):
    got = one(spark, json_or_repaired(F.col("x")), raw)[0]
    assert (None if got is None else json.loads(got)) == value


def test_valid_json_is_left_alone(spark):
    r = random.Random(4)

    def made(depth):
        kind = r.choice(["s", "n", "l", "o"] if depth else ["s", "n"])
        if kind == "s":
            return "".join(r.choice(["a", '"', "\\", "{", "]", ",", ":", "\n", "é", " ", "'"]) for _ in range(r.randint(0, 6)))
        if kind == "n":
            return r.choice([0, -1, 2.5, True, False, None, 1e30])
        return [made(depth - 1) for _ in range(r.randint(0, 3))] if kind == "l" else {f"k{i}": made(depth - 1) for i in range(r.randint(0, 3))}

    values = [made(4) for _ in range(300)]
    raw = [json.dumps(v, ensure_ascii=r.random() < 0.5) for v in values]
    assert one(spark, json_or_repaired(F.col("x")), *raw) == raw
    assert [json.loads(x) for x in one(spark, repaired(F.col("x")), *[x for x in raw if x[0] in "{["])] == [v for v, x in zip(values, raw) if x[0] in "{["]


def test_long_strings(spark):
    long = '{"a": "' + "x\\n" * 40_000 + '", "b": [' + "1," * 20 + "]}"
    assert json.loads(one(spark, json_or_repaired(F.col("x")), long)[0]) == {"a": "x\n" * 40_000, "b": [1] * 20}


@pytest.mark.parametrize("raw, error", [
    ('{"techniques": [{"name": "a", "role": "b",}], "mechanism": "m",}', None),
    ('{"techniques": [{"name": "a", "role": "b"}], "mechanism": "m\\"}', None),
    ('{"techniques": [{"name": "a", "role": "b"}], "mechanism": }', "no mechanism"),
    ("none", "no JSON object"),
    ("{{{]", "no JSON object"),
    ('{"techniques": [{"name": "a"}], "mechanism": "m",}', "bad techniques"),
])
def test_analysis_of_near_valid_json(spark, raw, error):
    assert one(spark, tx.parsed_analysis("x"), raw)[0].error == error


@pytest.mark.parametrize("post, found", [
    ("text\n```python\na\n  b\n```\nmore", [("python", "a\n  b\n")]),
    ("~~~~ py x\na\n~~~\n```\n~~~~~  \nb", [("py x", "a\n~~~\n```\n")]),
    ("```\nnever closed\n\n    x", [("", "never closed\n\n    x")]),
    ("```\n```", [("", "")]),
    ("  ```\n    a\n b\n  ```", [("", "  a\nb\n")]),
    ("``` a`b\nno fence\n```\nx", [("", "x")]),
    ("    a\n\n      b\n\n\ntext", [("", "a\n\n  b")]),
    ("text\n    no code\n\n    code", [("", "code")]),
    ("# head\n    code\n***\n\tcode 2", [("", "code"), ("", "code 2")]),
    ("- item\n\n      in the list\n\n  ```\n  in the list\n  ```\n\nout\n\n    code", [("", "code")]),
    ("- item\nlazy\n    lazy too\n\ntext", []),
    ("12. item\n\n    still the item\n\n   out of it\n", []),
    ("- a\n- b\n```\nfence ends the list\n```", [("", "fence ends the list\n")]),
    ("> ```\n> quoted\n> ```\n\n    code", [("", "code")]),
    ("> quote\n    lazy\n```js\nx\n```", [("js", "x\n")]),
    ("* * *\n    code", [("", "code")]),
    ("```\r\na\r\n```\r\n", [("", "a\n")]),
    ("", []),
    ("\n\n", []),
    ("    only\n", [("", "only")]),
])
def test_blocks(spark, post, found):
    assert [(b.info, b.body) for b in one(spark, blocks(F.col("x")), post)[0]] == found


def test_python_blocks_first(spark):
    post = "```js\n1\n```\n~~~Python3\n2\n~~~\n\n    3\n\n```py\n4\n```"
    assert one(spark, code_blocks(F.col("x")), post, None) == [["2\n", "4\n", "1\n", "3"], None]


def by_ast(stub, name):
    for suffix in ("\npass", "\n    pass\n", "\n        pass\n"):
        try:
            tree = ast.parse(stub + suffix)
            break
        except SyntaxError:
            continue
    else:
        return None
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.name == name:
            named = lambda t: [] if t is None else [n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else "None" for n in ast.walk(t) if isinstance(n, (ast.Name, ast.Attribute)) or isinstance(n, ast.Constant) and n.value is None]
            args = [a for a in f.args.args if a.arg != "self"]
            return sorted([*(f"arg:{t}" for a in args for t in named(a.annotation)), *(f"ret:{t}" for t in named(f.returns)), f"nargs:{len(args)}"])
    return None


def test_signatures_against_the_syntax_tree(spark):
    r = random.Random(12)

    def kind(depth):
        if not depth or r.random() < 0.3:
            return r.choice(["int", "str", "None", "typing.Any", "'Node'", "float", "TreeNode"])
        return r.choice(["List[{}]", "Optional[{}]", "Dict[{}, {}]", "Tuple[{}, {}, {}]", "Callable[[{}, {}], {}]", "{} | {}", "Literal[1, 'a, b)']", "Tuple[{}, ...]"]).replace("{}", "\0").replace("\0", "{}").format(*(kind(depth - 1) for _ in range(3)))

    def argument(i):
        out = f"a{i}" + (f": {kind(r.randint(0, 6))}" if r.random() < 0.8 else "")
        return out

    stubs = []
    for i in range(400):
        args = [argument(j) for j in range(r.randint(0, 4))]
        defaults = r.choice([None, "(1, 2)", "':'", "{'a': [1, 2]}", "None", "f(x, y=[1])", '"),"'])
        if args and defaults:
            args[-1] += f" = {defaults}"
        if r.random() < 0.15 and args:
            args.insert(r.randrange(len(args)) if not defaults else len(args), r.choice(["*", "*rest", "*rest: int"]))
            if args[-1] == "*":
                args.append("last: bool")
        elif r.random() < 0.1 and args:
            args.insert(1, "/")
        if r.random() < 0.15:
            args.append("**more: str")
        own = ["self", *args] if r.random() < 0.7 else args
        sep = r.choice([", ", ",\n            ", " , "])
        result = f" -> {kind(r.randint(0, 4))}" if r.random() < 0.6 else ""
        stubs.append(f"# def work(no)\nclass Solution:\n    def other(self, x: int):\n        pass\n\n    {r.choice(['', 'async '])}def work({sep.join(own)}){result}:\n        ")
    expected = [by_ast(s, "work") for s in stubs]
    got = one(spark, signature_bag(F.col("x"), F.lit("work")), *stubs)
    assert sum(e is not None for e in expected) > 300
    for s, g, e in zip(stubs, got, expected):
        if e is not None:
            assert Counter(g) == Counter(e) and g == sorted(g), s


def test_signatures_without_a_head(spark):
    assert one(spark, signature_bag(F.col("x"), F.lit("go")), "def go(a: int", "def going(a): pass", "", None, "x = 1; def go(): pass") == [None] * 5
    assert one(spark, signature_bag(F.col("x"), F.lit("go")), "def go(a: int = (1, 2), b: str = ':', c: Tuple[int, int, int] = None):") == [["arg:Tuple", "arg:int", "arg:int", "arg:int", "arg:int", "arg:str", "nargs:3"]]
