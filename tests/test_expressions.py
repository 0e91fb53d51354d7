import math

import pytest

from quillon import GraphError, parse
from quillon.functions.expressions import ALIASES, FUNCTIONS, STRING_FUNCTIONS

from .helpers import apply, close, node, wide

N = None
NAN = math.nan


def evaluate(spark, exprs, rows, **graph):
    names = [f"e{i}" for i in range(len(exprs))]
    got = apply(spark, wide(*rows), [node("functions.Compute", [], n, expr=e) for n, e in zip(names, exprs)], names, **graph)
    return [got[n] for n in names]


def test_there_are_sixty_one_functions_and_thirty_string_names():
    special = {"if", "clamp", "coalesce", "fill_missing", "replace_missing"}
    assert len(FUNCTIONS) - len(special) + len(ALIASES) == 55 and len(special) + 1 == 6 and len(STRING_FUNCTIONS) == 30


CASES = {
    "add(x0, x1)": lambda x, y: x + y, "x0 - x1": lambda x, y: x - y, "x0 * x1": lambda x, y: x * y, "x0 / x1": lambda x, y: x / y if y else N, "mod(x0, x1)": lambda x, y: math.fmod(x, y) if y else N,
    "negate(x0)": lambda x, y: -x, "abs(x0)": lambda x, y: abs(x), "square(x0)": lambda x, y: x * x, "exp(x0)": lambda x, y: math.exp(x), "exp2(x0)": lambda x, y: 2**x, "log(x0)": lambda x, y: math.log(x) if x > 0 else N,
    "log2(x0)": lambda x, y: math.log2(x) if x > 0 else N, "log10(x0)": lambda x, y: math.log10(x) if x > 0 else N, "log1p(x0)": lambda x, y: -math.inf if x == -1 else math.log1p(x) if x > -1 else N,
    "sqrt(x0)": lambda x, y: math.sqrt(x) if x >= 0 else N, "cbrt(x0)": lambda x, y: math.cbrt(x), "sin(x0)": lambda x, y: math.sin(x), "cos(x0)": lambda x, y: math.cos(x), "tan(x0)": lambda x, y: math.tan(x),
    "asin(x0)": lambda x, y: math.asin(x) if abs(x) <= 1 else N, "acos(x0)": lambda x, y: math.acos(x) if abs(x) <= 1 else N, "atan(x0)": lambda x, y: math.atan(x), "atan2(x0, x1)": lambda x, y: math.atan2(x, y),
    "floor(x0)": lambda x, y: math.floor(x), "ceil(x0)": lambda x, y: math.ceil(x), "trunc(x0)": lambda x, y: math.trunc(x), "round(x0)": lambda x, y: math.copysign(math.floor(abs(x) + 0.5), x),
    "sigmoid(x0)": lambda x, y: 1 / (1 + math.exp(-x)), "tanh(x0)": lambda x, y: math.tanh(x), "softplus(x0)": lambda x, y: math.log1p(math.exp(x)), "leaky_relu(x0)": lambda x, y: x if x > 0 else 0.01 * x,
    "leaky_relu(x0, 0.5)": lambda x, y: x if x > 0 else 0.5 * x,
}
ROWS = [(2.5, 2), (-2.5, 0), (0, -3), (-1, 4), (1, 1), (0.5, -0.5), (7, 2.5)]


def test_functions_of_numbers(spark):
    for e, got in zip(CASES, evaluate(spark, list(CASES), [*ROWS, (N, 1)])):
        want = [CASES[e](float(x), float(y)) for x, y in ROWS]
        for g, w in zip(got, want):
            assert (g is None) == (w is None) and (w is None or g == w or abs(g - w) < 1e-9), (e, got, want)
        assert got[-1] is None, e


def test_missing_values(spark):
    exprs = ["sign(x0)", "min(x0, x1)", "max(x0, x1)", "x0 == x1", "x0 != x1", "x0 < x1", "x0 <= x1", "x0 > x1", "x0 >= x1", "x0 and x1", "x0 or x1", "not x0", "relu(x0)", "is_missing(x0)", "is_not_missing(x0)",
             "if_(x0, 1, 2)", "clamp(x0, -1, 1)", "coalesce(x0, x1, 9)", "fill_missing(x0, 5)", "replace_missing(x0, 6)", "upper(x0)", "nvl(x0, 1)", "pow(x0, 0.5)"]
    got = evaluate(spark, exprs, [(N, 1), (1, N), (N, N), (3, 2), (0, 0), (-4, 2)])
    want = [
        [0, 1, 0, 1, 0, -1], [N, 1, N, 2, 0, -4], [N, 1, N, 3, 0, 2], [0, 0, 0, 0, 1, 0], [1, 1, 1, 1, 0, 1], [0, 0, 0, 0, 0, 1], [0, 0, 0, 0, 1, 1], [0, 0, 0, 1, 0, 0], [0, 0, 0, 1, 1, 0],
        [1, 1, 1, 1, 0, 1], [1, 1, 1, 1, 0, 1], [0, 0, 0, 0, 1, 0], [0, 1, 0, 3, 0, 0], [1, 0, 1, 0, 0, 0], [0, 1, 0, 1, 1, 1], [1, 1, 1, 1, 2, 1], [-1, 1, -1, 1, 0, -1],
        [1, 1, 9, 3, 0, -4], [5, 1, 5, 3, 0, -4], [6, 1, 6, 3, 0, -4], [N] * 6, [N] * 6, [N, 1, N, math.sqrt(3), 0, N],
    ]
    for e, g, w in zip(exprs, got, want):
        close(g, w), e


def test_user_functions(spark):
    functions = {"twice": {"params": ["a"], "body": "a + a"}, "outer": {"params": ["a"], "body": "twice(a) * x1"}, "add": {"params": ["a", "b"], "body": 0}, "loop": {"params": ["a"], "body": "loop(a)"}}
    close(evaluate(spark, ["outer(x0)", "add(x0, x1)", {"fn": "any.functions.square", "args": [{"col": "x0"}]}], [(2, 3)], functions=functions), [[12], [5], [4]])
    for bad in ("twice(x0, x1)", "loop(x0)", "unknown(x0)", "add(x0)", "nothere + 1", "leaky_relu(x0, x1)"):
        with pytest.raises(GraphError):
            evaluate(spark, [bad], [(1, 2)], functions=functions)


def test_literals_and_nan(spark):
    close(evaluate(spark, ["x0 + True", {"lit": "text"}, None, "'a' == 'a'", NAN], [(1,), (NAN,)]), [[2, N], [N, N], [N, N], [0, 0], [N, N]])
    assert parse("a and b or not c")["fn"] == "logical_or"
    with pytest.raises(GraphError):
        parse("[1, 2]")


def test_predicates(spark):
    lt, eq = {"field": "x0", "op": "<", "value": 2}, {"field": "x0", "op": "!=", "value": 2}
    preds = [lt, eq, {"field": "x0", "op": "in", "values": [1, 2]}, {"field": "x0", "op": "not_in", "values": [1, 2]}, {"op": "and", "args": [lt, eq]}, {"op": "or", "args": [lt, eq]}, {"op": "xor", "args": [lt, eq]},
             {"op": "surrogate", "args": [lt, eq]}, {"op": "and"}, True, False, {"field": "x0", "op": "is_missing"}, {"field": "x0", "op": "=", "value": "x"}]
    stump = lambda p: [{"pred": p, "left": 1, "right": 2}, {"leaf": 1}, {"leaf": 0}]
    names = [f"p{i}" for i in range(len(preds))]
    got = apply(spark, wide((1,), (2,), (3,), (N,)), [node("model.Tree", ["x0"], n, nodes=stump(p)) for n, p in zip(names, preds)], names)
    want = [[1, 0, 0, 0], [1, 0, 1, 0], [1, 1, 0, 0], [0, 0, 1, 1], [1, 0, 0, 0], [1, 0, 1, 0], [0, 0, 1, 0], [1, 0, 1, 0], [0] * 4, [1] * 4, [0] * 4, [0, 0, 0, 1], [0] * 4]
    for n, w in zip(names, want):
        close(got[n], w)


def test_policies(spark):
    rows = wide(*[(v,) * 8 for v in (N, -5, 0, 1, 2, 7, 12)])
    schema = [
        {"name": "x0", "missing": "as_value", "missing_value": 9}, {"name": "x1", "missing": "as_value", "missing_values": [1], "missing_value": -1, "valid": [0, 2]},
        {"name": "x2", "valid": [0, 1], "on_invalid": "as_value", "invalid_value": 3, "missing": "as_invalid"}, {"name": "x3", "invalid": [7], "on_invalid": "as_is"}, {"name": "x4", "intervals": [{"lo": 0, "hi": 10}], "outlier": "as_extreme"},
        {"name": "x5", "intervals": [{"lo": 0, "hi": 10, "closure": "oo"}], "outlier": "as_extreme"}, {"name": "x6", "intervals": [{"hi": 1}, {"lo": 2, "hi": 8}], "outlier": "as_missing"}, {"name": "x7", "intervals": [{"lo": 0, "hi": 1}]},
    ]
    names = [f"y{i}" for i in range(8)]
    got = apply(spark, rows, [node("core.Identity", [f"x{i}" for i in range(8)], names)], names, schema=schema)
    want = [[9, -5, 0, 1, 2, 7, 12], [-1, N, 0, -1, 2, N, N], [3, 3, 0, 1, 3, 3, 3], [N, -5, 0, 1, 2, 7, 12], [N, 0, 0, 1, 2, 7, 10], [N, 0, 0, 1, 2, 7, 10], [N, -5, 0, 1, 2, 7, N], [N, -5, 0, 1, 2, 7, 12]]
    for n, w in zip(names, want):
        close(got[n], w)
    assert got["y5"][1] > 0 and got["y5"][-1] < 10
