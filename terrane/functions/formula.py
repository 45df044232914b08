"""Formulas over named series as Spark columns: arithmetic, comparisons, `c ? a : b`, functions, and samples before or after.

The text is read by Python's own expression grammar after the four spellings that differ (^, &&, ||, ?:) are replaced.
"""

from __future__ import annotations

import ast
import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

_ONE: dict[str, Callable] = {
    "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "exp": F.exp,
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "ln": lambda x: F.when(x > 0, F.log(x)), "log": lambda x: F.when(x > 0, F.log10(x)),
    "floor": F.floor, "ceil": F.ceil, "sgn": F.signum,
}
_MANY: dict[str, Callable] = {
    "min": lambda *x: F.least(*x), "max": lambda *x: F.greatest(*x), "sum": lambda *x: functools.reduce(lambda a, b: a + b, x),
    "avg": lambda *x: functools.reduce(lambda a, b: a + b, x) / len(x), "med": lambda *x: F.sort_array(F.array(*x))[(len(x) - 1) // 2],
}
_COMPARE = {ast.Lt: "__lt__", ast.Gt: "__gt__", ast.LtE: "__le__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}


def _choices(text: str) -> str:
    """`c ? a : b` as `(a if c else b)`, within parentheses first, the last `?` of a level first."""
    inner = re.compile(r"\(([^()]*)\)")
    held: list[str] = []

    def plain(part: str) -> str:
        if "," in part:
            return ",".join(plain(p) for p in part.split(","))
        if "?" not in part:
            return part
        test, rest = part.split("?", 1)
        depth = 0
        for i, c in enumerate(rest):
            depth += (c == "?") - (c == ":")
            if depth < 0:
                return f"({plain(rest[:i])} if {test} else {plain(rest[i + 1 :])})"
        raise ValueError(f"? without : in {part!r}")

    def hold(match: re.Match) -> str:
        held.append(f"({plain(match[1])})")
        return f"\x00{len(held) - 1}\x01"

    while inner.search(text):
        text = inner.sub(hold, text, count=1)
    text = plain(text)
    while "\x00" in text:
        text = re.sub(r"\x00(\d+)\x01", lambda m: held[int(m[1])], text)
    return text


def _flag(c: Column) -> Column:
    return c.cast("double")


def formula(text: str, variables: dict[str, Column], order: WindowSpec | None = None) -> Column:
    """A formula as one column. Numbers are doubles, comparisons give 1 or 0, any number but 0 is true; `x[n]` is the value n
    samples on in `order`; pi is known; a name that is no variable is an error."""
    source = _choices(text).replace("^", "**").replace("&&", " and ").replace("||", " or ").strip()

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=value) if isinstance(value, (int, float)):
                return F.lit(float(value))
            case ast.Name(id="pi"):
                return F.pi()
            case ast.Name(id=name) if name in variables:
                return variables[name]
            case ast.Subscript(value=ast.Name(id=name), slice=shift) if name in variables and order is not None:
                n = ast.literal_eval(shift)
                return F.lead(variables[name], n).over(order) if n >= 0 else F.lag(variables[name], -n).over(order)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=op, right=b):
                x, y = build(a), build(b)
                match op:
                    case ast.Add():
                        return x + y
                    case ast.Sub():
                        return x - y
                    case ast.Mult():
                        return x * y
                    case ast.Div():
                        return F.try_divide(x, y)
                    case ast.Mod():
                        return F.when(y != 0, x % y)
                    case ast.Pow():
                        return F.pow(x, y)
            case ast.Compare(left=a, ops=[op], comparators=[b]):
                return _flag(getattr(build(a), _COMPARE[type(op)])(build(b)))
            case ast.BoolOp(op=op, values=parts):
                tests = [build(p) != 0 for p in parts]
                return _flag(functools.reduce(lambda a, b: a & b if isinstance(op, ast.And) else a | b, tests))
            case ast.IfExp(test=c, body=a, orelse=b):
                return F.when(build(c) != 0, build(a)).otherwise(build(b))
            case ast.Call(func=ast.Name(id=name), args=args) if name in _ONE and len(args) == 1:
                return _ONE[name](build(args[0]))
            case ast.Call(func=ast.Name(id=name), args=args) if name in _MANY and args:
                return _MANY[name](*map(build, args))
        raise ValueError(f"not part of a formula: {ast.unparse(node)}")

    return build(ast.parse(source, mode="eval"))


def recursive(inputs: Column, step: Callable[[Column, Column], Column], start: list[float]) -> Column:
    """The series out[i] = step(inputs[i], the last len(start) outputs, latest last), as an array; fed with start at first."""
    n = len(start)
    seed = F.array(*[F.lit(float(s)) for s in start])
    return F.slice(F.aggregate(inputs, seed, lambda out, x: F.concat(out, F.array(step(x, F.slice(out, -n, n)))), lambda out: out), F.lit(n + 1), F.greatest(F.size(inputs), F.lit(1)))
