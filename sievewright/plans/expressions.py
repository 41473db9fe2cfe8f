"""Arithmetic written as text, turned into a column under a whitelist; nothing is evaluated as code."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs}
BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Pow: F.pow, ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b))}


def to_column(text: str, names: Mapping[str, Column] | None = None) -> Column:
    """A double column. Names are columns (or those given); `%` has the sign of its right side.

    Raises ValueError for anything but + - * / ** %, signs, numbers, names and the four functions.
    """

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in BINARY:
                return BINARY[type(op)](build(left), build(right))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.Call(func=ast.Name(id=name), args=[x], keywords=[]) if name in FUNCTIONS:
                return FUNCTIONS[name](build(x))
            case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool):
                return F.lit(float(v))
            case ast.Name(id=name) if not name.startswith("__"):
                if names is not None and name not in names:
                    raise ValueError(f"unknown name {name}")
                return (names[name] if names is not None else F.col(name)).cast("double")
        raise ValueError(f"not allowed: {type(node).__name__}")

    try:
        return build(ast.parse(text, mode="eval")).cast("double")
    except SyntaxError as e:
        raise ValueError(str(e)) from e
