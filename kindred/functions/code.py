"""What a piece of Python code looks like, by its syntax tree; Arrow-batched, one small walk a row.

Nothing is run. Code that is null or does not parse gives null, or stays as it is where it is
rewritten.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

LOOPS = (ast.For, ast.AsyncFor, ast.While)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
FEATURES = StructType().add("usable", BooleanType()).add("n_loops", IntegerType()).add("nesting", IntegerType()).add("recursive", BooleanType()).add("early_exit", BooleanType()).add("motifs", ArrayType(StringType()))


def parsed(code: str | None) -> ast.Module | None:
    try:
        return None if code is None else ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def anonymized(code: str | None) -> str | None:
    """Functions become ``solve``; assigned names, then parameters, are numbered v0, v1, ... in order of appearance."""
    tree = parsed(code)
    if tree is None:
        return code
    nodes = list(ast.walk(tree))
    targets = [t for n in nodes for t in (n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, (ast.AugAssign, ast.For, ast.comprehension)) else [])]
    names = [x.id for t in targets for x in ast.walk(t) if isinstance(x, ast.Name)]
    names += [a.arg for n in nodes if isinstance(n, ast.FunctionDef) for a in n.args.args]
    number = {name: f"v{i}" for i, name in enumerate(dict.fromkeys(n for n in names if n not in ("self", "cls")))}
    for n in nodes:
        if isinstance(n, ast.Name):
            n.id = number.get(n.id, n.id)
        elif isinstance(n, ast.FunctionDef):
            n.name = "solve"
            for a in n.args.args:
                a.arg = number.get(a.arg, a.arg)
    return ast.unparse(tree)


def aligned(code: str | None, stub: str | None, method: str | None) -> str | None:
    """The code with the method's parameters, by place, and their uses in its body named as in the stub.

    It stays as it is if either side does not parse or lacks the method, if the numbers of parameters
    differ (``self`` does not count) or if there is nothing to rename. The stub lacks only its body.
    """
    tree, model = parsed(code), parsed(None if stub is None else stub + "pass")
    if tree is None or model is None:
        return code
    named = lambda t: [n for n in ast.walk(t) if isinstance(n, ast.FunctionDef) and n.name == method]
    names = lambda found: [a.arg for a in found[0].args.args if a.arg != "self"] if found else []
    own, wanted = names(named(tree)), names(named(model))
    if not own or len(own) != len(wanted) or own == wanted:
        return code
    to = dict(zip(own, wanted))
    inner = {id(n) for f in named(tree) for line in f.body for n in ast.walk(line)}
    for f in [f for f in named(tree) if id(f) not in inner]:
        for a in f.args.args:
            a.arg = to.get(a.arg, a.arg)
        for n in (n for line in f.body for n in ast.walk(line) if isinstance(n, ast.Name)):
            n.id = to.get(n.id, n.id)
    return ast.unparse(tree)


def _flat(tree: ast.AST) -> tuple[dict[ast.AST, list[ast.AST]], int]:
    """What is below each loop and function, itself among it, and how deep loops lie in each other: one walk, in which loads and stores are left out."""
    nodes: list[ast.AST] = []
    below: dict[ast.AST, list[ast.AST]] = {}

    def visit(node: ast.AST) -> int:
        at, deepest = len(nodes), 0
        nodes.append(node)
        for name in node._fields:
            child = getattr(node, name, None)
            for x in child if isinstance(child, list) else (child,):
                if isinstance(x, ast.AST) and not isinstance(x, ast.expr_context):
                    deepest = max(deepest, visit(x))
        if isinstance(node, LOOPS + FUNCTIONS):
            below[node] = nodes[at:]
        return deepest + isinstance(node, LOOPS)

    return below, visit(tree)


def _bounds(loop: ast.While) -> tuple[str, ...]:
    """The two names that a loop's condition orders, the lesser first."""
    t = loop.test
    if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], (ast.Lt, ast.LtE, ast.Gt, ast.GtE)) and isinstance(t.left, ast.Name) and isinstance(t.comparators[0], ast.Name):
        names = (t.left.id, t.comparators[0].id)
        return names if isinstance(t.ops[0], (ast.Lt, ast.LtE)) else names[::-1]
    return ()


def _halves(value: ast.AST, bounds: set[str]) -> bool:
    """Half of the bounds' sum, rounded either way."""
    if not (isinstance(value, ast.BinOp) and isinstance(value.right, ast.Constant) and ((isinstance(value.op, ast.FloorDiv) and value.right.value == 2) or (isinstance(value.op, ast.RShift) and value.right.value == 1))):
        return False
    return {x.id for x in ast.walk(value.left) if isinstance(x, ast.Name)} == bounds and not any(isinstance(x, (ast.Mult, ast.Sub)) for x in ast.walk(value.left))


def _steps(inside: list[ast.AST], bounds: set[str]) -> set[tuple[str, type]]:
    return {(n.target.id, type(n.op)) for n in inside if isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name) and n.target.id in bounds and isinstance(n.value, ast.Constant) and n.value.value == 1}


def motifs(below: dict[ast.AST, list[ast.AST]]) -> list[str]:
    """binary_search: a loop on two bounds that halves them; two_pointers: one that moves both towards each other."""
    found = set()
    for loop in (n for n in below if isinstance(n, ast.While)):
        bounds = _bounds(loop)
        if len(set(bounds)) != 2:
            continue
        lesser, greater = bounds
        bounds = set(bounds)
        assigned = [(n.targets[0].id, n.value) for n in below[loop] if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name)]
        mids = {name for name, value in assigned if _halves(value, bounds)}
        if any(name in bounds and mids & {x.id for x in ast.walk(value) if isinstance(x, ast.Name)} for name, value in assigned):
            found.add("binary_search")
        steps = _steps(below[loop], bounds)
        if steps == {(lesser, ast.Add), (greater, ast.Sub)}:
            found.add("two_pointers")
    return sorted(found)


def features(code: str | None) -> dict | None:
    tree = parsed(code)
    if tree is None:
        return None
    below, nesting = _flat(tree)
    functions, loops = ([n for n in below if isinstance(n, kinds)] for kinds in (FUNCTIONS, LOOPS))
    calls = lambda f: any(isinstance(c, ast.Call) and (getattr(c.func, "id", None) == f.name or (isinstance(c.func, ast.Attribute) and c.func.attr == f.name and getattr(c.func.value, "id", None) == "self")) for c in below[f])
    exits = any(isinstance(x, (ast.Break, ast.Return)) for n in loops for x in below[n])
    return {"usable": bool(functions), "n_loops": len(loops), "nesting": nesting, "recursive": any(map(calls, functions)), "early_exit": exits, "motifs": motifs(below)}


@F.pandas_udf(FEATURES)
def code_features(code: pd.Series) -> pd.DataFrame:
    rows = [features(c) or {} for c in code]
    return pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype=object) for f in FEATURES.names})


@F.pandas_udf(StringType())
def anonymized_code(code: pd.Series) -> pd.Series:
    return code.map(anonymized)


def usable(code: str | None) -> bool:
    """Whether code parses and has a function."""
    return (tree := parsed(code)) is not None and any(isinstance(n, FUNCTIONS) for n in ast.walk(tree))


@F.pandas_udf(BooleanType())
def is_usable(code: pd.Series) -> pd.Series:
    return code.map(usable).astype(bool)


CHOICE = StructType().add("at", IntegerType()).add("wrapped", BooleanType())


@F.pandas_udf(CHOICE)
def first_usable(own: pd.Series, wrapped: pd.Series) -> pd.DataFrame:
    """Of a row's blocks the place of the first that is usable as it is or, if it is not, wrapped; blocks after it are not parsed. Nulls without one."""
    chosen = [next(((i, form > 0) for i, forms in enumerate(zip(*row)) for form, c in enumerate(forms) if usable(c)), (None, None)) for row in zip(own, wrapped)]
    return pd.DataFrame({name: pd.Series([c[i] for c in chosen], dtype=object) for i, name in enumerate(CHOICE.names)})


@F.pandas_udf(StringType())
def aligned_code(code: pd.Series, stub: pd.Series, method: pd.Series) -> pd.Series:
    return pd.Series([aligned(*row) for row in zip(code, stub, method)], dtype=object)
