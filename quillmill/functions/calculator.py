"""arithmetic and bit expressions in decimal arithmetic, a column at a time; a small helper around a whitelist."""

from __future__ import annotations

import ast
import operator
from decimal import Decimal, InvalidOperation, Overflow

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DIGITS, MOST_POWER = 1_000, 10_000


def whole(x: Decimal) -> int:
    if x != x.to_integral_value():
        raise ValueError("bit operators need integers")
    return int(x)


def quotient(f):
    def run(a: Decimal, b: Decimal) -> Decimal:
        if not b:
            raise ZeroDivisionError
        return f(a, b)

    return run


def power(a: Decimal, b: Decimal) -> Decimal:
    if abs(b) > MOST_POWER:
        raise ValueError("exponent too large")
    return a**b


def shift(f):
    def run(a: Decimal, b: Decimal) -> Decimal:
        n = whole(b)
        if not 0 <= n <= MOST_DIGITS:
            raise ValueError("shift out of range")
        return Decimal(f(whole(a), n))

    return run


def bits(f):
    return lambda a, b: Decimal(f(whole(a), whole(b)))


BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: quotient(operator.truediv), ast.FloorDiv: quotient(operator.floordiv), ast.Mod: operator.mod, ast.Pow: power,
    ast.LShift: shift(operator.lshift), ast.RShift: shift(operator.rshift), ast.BitAnd: bits(operator.and_), ast.BitOr: bits(operator.or_), ast.BitXor: bits(operator.xor),
}
UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg, ast.Invert: lambda a: Decimal(~whole(a))}


def evaluate(source: str) -> Decimal:
    def value(node) -> Decimal:
        match node:
            case ast.Expression():
                return value(node.body)
            case ast.Constant() if type(node.value) in (int, float):
                return Decimal(ast.get_source_segment(source, node))
            case ast.BinOp() if type(node.op) in BINARY:
                return BINARY[type(node.op)](value(node.left), value(node.right))
            case ast.UnaryOp() if type(node.op) in UNARY:
                return UNARY[type(node.op)](value(node.operand))
        raise ValueError("not an arithmetic expression")

    return value(ast.parse(source, mode="eval"))


def calculate_one(source: str | None) -> tuple[str | None, str | None]:
    """(result, reason): a result without exponent and trailing zeros, or why there is none."""
    if source is None or not source.strip():
        return None, "empty"
    try:
        x = evaluate(source.strip())
    except ZeroDivisionError:
        return None, "division by zero"
    except SyntaxError:
        return None, "syntax"
    except (ValueError, InvalidOperation, Overflow, RecursionError, MemoryError, ArithmeticError) as e:
        return None, type(e).__name__ if isinstance(e, ArithmeticError) else str(e)
    if not x.is_finite() or x.adjusted() > MOST_DIGITS:
        return None, "out of range"
    text = format(x, "f")
    return (text.rstrip("0").rstrip(".") if "." in text else text) or "0", None


def safe_calculate(expression: Column) -> Column:
    """Struct (result, reason), strings; normalise the expression first."""

    @F.pandas_udf("result string, reason string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([calculate_one(x) for x in s], columns=["result", "reason"], dtype=object)

    return run(expression)
