"""Kinds of type expressions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Modules whose names are read without them.
TYPING = ("typing", "typing_extensions", "t")


def _name(node: ast.expr) -> str:
    text = ast.unparse(node)
    head, _, rest = text.partition(".")
    return rest if head in TYPING and rest else text


def classify(text: str) -> dict:
    """{kind, name, args}: simple, generic, union, optional, callable, literal, tuple, string, none or unknown; a union is flat."""
    try:
        node = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError):
        return {"kind": "unknown", "name": text, "args": []}
    return _kind(node)


def _flat(node: ast.expr) -> list[ast.expr]:
    return _flat(node.left) + _flat(node.right) if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr) else [node]


def _kind(node: ast.expr) -> dict:
    args = lambda nodes: [ast.unparse(n) for n in nodes]
    if isinstance(node, ast.Constant):
        kind = "none" if node.value is None else "string" if isinstance(node.value, str) else "literal"
        return {"kind": kind, "name": str(node.value), "args": []}
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return {"kind": "union", "name": "Union", "args": args(_flat(node))}
    if isinstance(node, ast.Subscript):
        name = _name(node.value)
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        kind = {"Union": "union", "Optional": "optional", "Callable": "callable", "Literal": "literal", "Tuple": "tuple", "tuple": "tuple"}.get(name, "generic")
        return {"kind": kind, "name": name, "args": args(inner)}
    if isinstance(node, (ast.Name, ast.Attribute)):
        return {"kind": "simple", "name": _name(node), "args": []}
    return {"kind": "unknown", "name": ast.unparse(node), "args": []}


SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(T.StringType()))])


@F.pandas_udf(SCHEMA)
def type_expression(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([classify(x or "") for x in text], columns=SCHEMA.names)
