"""Formulas against Python's own arithmetic, on expressions made at random and on edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions.formula import formula, recursive
from terrane.operators.earth import linear_depth, linear_time
from terrane.operators.points import glob


def _made(rng, depth):
    """(formula, value): an expression of random shape, with undefined values as None."""
    if depth == 0:
        n = rng.randint(1, 12)
        return str(n), float(n)
    kind = rng.choice(["+", "-", "*", "/", "%", "<", ">=", "==", "&&", "||", "?", "neg", "max"])
    a, x = _made(rng, depth - 1)
    b, y = _made(rng, rng.randint(0, depth - 1))
    if kind == "?":
        c, z = _made(rng, 0)
        value = z if x is None else (y if x != 0 else z)
        return f"(({a}) ? ({b}) : ({c}))", value
    if x is None or y is None:
        return f"({a})", x
    if kind == "neg":
        return f"(-({a}))", -x
    if kind == "max":
        return f"max({a}, {b})", max(x, y)
    if kind in "/%" and y == 0:
        return f"(({a}) {kind} ({b}))", None
    value = {
        "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: math.fmod(x, y), "<": lambda: float(x < y),
        ">=": lambda: float(x >= y), "==": lambda: float(x == y), "&&": lambda: float(x != 0 and y != 0), "||": lambda: float(x != 0 or y != 0),
    }[kind]()
    return f"(({a}) {kind} ({b}))", value


def test_random_expressions(spark):
    rng = random.Random(40)
    made = [_made(rng, 1 + k % 3) for k in range(60)]
    got = spark.range(1).select(*[formula(text, {}).cast("double").alias(f"c{k}") for k, (text, _) in enumerate(made)]).first()
    for (text, want), value in zip(made, got):
        assert value == (want if want is None else pytest.approx(want)), text


@pytest.mark.parametrize(
    ("text", "want"),
    [("2 + 6 / 4 - 1", 2.5), ("10 - 4 - 3", 3), ("7 * 2 % 5", 4), ("2 * 5 ^ 2", 50), ("2 ^ 3 ^ 2", 512), ("6 < 5 ? 1 : 6 < 7 ? 2 : 3", 2), ("1 / 0", None), ("8 % 0", None), ("sqrt(0 - 4)", None), ("ln(0)", None), ("2 * pi", 2 * math.pi)],
)
def test_precedence_and_edges(spark, text, want):
    value = spark.range(1).select(formula(text, {})).first()[0]
    assert value == (want if want is None else pytest.approx(want))


def test_undefined_inputs_stay_undefined(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(formula("a + 1", {"a": none}), formula("a ? 1 : 2", {"a": none}), formula("max(a, 3)", {"a": none})).first()
    assert list(row) == [None, 2.0, 3.0]


def test_variables(spark):
    got = spark.range(1).select(formula("slope * depth - start", {"slope": F.lit(0.25), "depth": F.lit(1800.0), "start": F.lit(40.0)})).first()[0]
    assert got == pytest.approx(410)


def test_recursion_feeds_outputs_back(spark):
    rng = random.Random(3)
    x = [float(rng.randint(-9, 9)) for _ in range(40)]
    want, last = [], [0.5, -1.0, 2.0]
    for v in x:
        last = [*last, 0.5 * v - last[-3] / 4 + last[-1] / 8]
        want.append(last[-1])
    series = F.array(*map(F.lit, x))
    got = spark.range(1).select(recursive(series, lambda v, out: 0.5 * v - F.element_at(out, 1) / 4 + F.element_at(out, 3) / 8, [0.5, -1.0, 2.0])).first()[0]
    assert got == pytest.approx(want)


def test_linear_velocity_round_trip(spark):
    z, t = spark.range(1).select(linear_depth(F.lit(1.5), 2000.0, 0.5), linear_time(linear_depth(F.lit(1.5), 2000.0, 0.5), 2000.0, 0.5)).first()
    assert t == pytest.approx(1.5) and z > 1500


def test_glob(spark):
    row = spark.range(1).select(glob(F.lit("a.b"), "a.?"), glob(F.lit("axb"), "a.b"), glob(F.lit("Abc"), "a[b-c]*", True)).first()
    assert list(row) == [True, False, True]


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        formula("x + 1", {})
