"""Scalar tools: arithmetic and flat schema validation."""

from __future__ import annotations

import ast
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
MAX_LENGTH, MAX_DEPTH, MAX_BASE, MAX_EXPONENT = 200, 20, 10**6, 64


def calculate(text: str | None) -> float | None:
    """Value of an arithmetic expression; None for anything else, out of bounds, or undefined."""
    if not text or len(text) > MAX_LENGTH:
        return None

    def value(node: ast.AST, depth: int) -> float:
        if depth > MAX_DEPTH:
            raise ValueError
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            v = value(node.operand, depth + 1)
            return -v if isinstance(node.op, ast.USub) else v
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            a, b = value(node.left, depth + 1), value(node.right, depth + 1)
            if isinstance(node.op, ast.Pow) and (abs(a) > MAX_BASE or abs(b) > MAX_EXPONENT):
                raise ValueError
            return OPERATORS[type(node.op)](a, b)
        raise ValueError

    try:
        v = float(value(ast.parse(text.replace("×", "*").replace("÷", "/").replace("（", "(").replace("）", ")"), mode="eval").body, 0))
        return v if math.isfinite(v) else None
    except (ValueError, SyntaxError, ArithmeticError, TypeError, RecursionError):
        return None


def schema_problems(variant: Column, schema: dict) -> Column:
    """Problems of a flat JSON object against a schema subset: type, enum, range, length, required."""
    sql = {"string": "string", "integer": "long", "number": "double", "boolean": "boolean"}
    problems = []
    for name, rule in schema.get("properties", {}).items():
        raw = F.try_variant_get(variant, f"$.{name}", "string")
        v = F.try_variant_get(variant, f"$.{name}", sql[rule.get("type", "string")])
        problems.append(F.when(raw.isNull() & F.lit(name in schema.get("required", [])), F.lit(f"{name}: missing")))
        problems.append(F.when(raw.isNotNull() & v.isNull(), F.lit(f"{name}: type")))
        if "enum" in rule:
            problems.append(F.when(v.isNotNull() & ~v.isin(*rule["enum"]), F.lit(f"{name}: enum")))
        for key, bad in (("minimum", lambda c, x: c < x), ("maximum", lambda c, x: c > x), ("minLength", lambda c, x: F.length(c) < x), ("maxLength", lambda c, x: F.length(c) > x)):
            if key in rule:
                problems.append(F.when(bad(v, rule[key]), F.lit(f"{name}: {key}")))
    return F.array_compact(F.array(*problems))
