"""The expression language: arithmetic on numbers with missing values.

An expression is a number, a bool (1 or 0), None (missing), ``{"col": name}``,
``{"lit": string}`` (missing as a number) or ``{"fn": name, "args": [...]}``.
:func:`parse` reads the same from Python syntax, e.g. ``"log(x) + 2 * y"``.
Missing is NULL. Unless said otherwise a function of a missing value is missing.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import flag, holds, missing, no_nan

Expr = object


class GraphError(ValueError):
    """A model graph that can't be compiled or fed. The kinds below are told apart by their classes, or by kind."""

    kind = "bad_graph"


class BadFormat(GraphError):
    """What is loaded is no graph."""

    kind = "bad_format"


class UnknownOperator(GraphError):
    kind = "unknown_operator"


class MissingInput(GraphError):
    """A column of the data, or a value that a node reads."""

    kind = "missing_input"


class MissingAttribute(GraphError):
    kind = "missing_attribute"


class UnknownOutput(GraphError):
    kind = "unknown_output"


class BadShape(GraphError):
    """Another number of columns, features or values than is needed."""

    kind = "bad_shape"


@dataclass(frozen=True)
class UserFunction:
    """A named expression of parameters; it may also read the columns around it."""

    params: tuple[str, ...]
    body: Expr


def truthy(x: Column) -> Column:
    """Not zero; a missing value counts as true."""
    return holds(x != 0, unknown=True)


def _least(a: Column, b: Column) -> Column:
    """A missing first argument makes it missing; a missing second one is skipped."""
    return F.when(a.isNotNull(), F.least(a, b))


def _greatest(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull(), F.greatest(a, b))


def _mod(x: Column, y: Column) -> Column:
    return F.when(y != 0, x % y)


def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _log1p(x: Column) -> Column:
    return F.when(x == -1, F.lit(-math.inf)).when(x > -1, F.log1p(x))


def _compare(name: str) -> Callable[[Column, Column], Column]:
    return lambda x, y: flag(getattr(x, name)(y))


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNull(), lo).otherwise(F.greatest(lo, F.least(x, hi)))


#: name -> (function, number of arguments; None for any number from one up)
FUNCTIONS: dict[str, tuple[Callable[..., Column], int | None]] = {
    "add": (lambda x, y: x + y, 2),
    "subtract": (lambda x, y: x - y, 2),
    "multiply": (lambda x, y: x * y, 2),
    "divide": (F.try_divide, 2),
    "negate": (lambda x: -x, 1),
    "abs": (F.abs, 1),
    "square": (lambda x: x * x, 1),
    "sign": (lambda x: F.coalesce(F.signum(x), F.lit(0.0)), 1),
    "mod": (_mod, 2),
    "exp": (F.exp, 1),
    "exp2": (lambda x: F.pow(F.lit(2.0), x), 1),
    "log": (lambda x: F.when(x > 0, F.log(x)), 1),
    "log2": (lambda x: F.when(x > 0, F.log2(x)), 1),
    "log10": (lambda x: F.when(x > 0, F.log10(x)), 1),
    "log1p": (_log1p, 1),
    "sqrt": (lambda x: F.when(x >= 0, F.sqrt(x)), 1),
    "cbrt": (F.cbrt, 1),
    "pow": (lambda x, y: no_nan(F.pow(x, y)), 2),
    "sin": (lambda x: no_nan(F.sin(x)), 1),
    "cos": (lambda x: no_nan(F.cos(x)), 1),
    "tan": (lambda x: no_nan(F.tan(x)), 1),
    "asin": (lambda x: no_nan(F.asin(x)), 1),
    "acos": (lambda x: no_nan(F.acos(x)), 1),
    "atan": (F.atan, 1),
    "atan2": (F.atan2, 2),
    "floor": (lambda x: F.floor(x).cast("double"), 1),
    "ceil": (lambda x: F.ceil(x).cast("double"), 1),
    "round": (F.round, 1),
    "trunc": (_trunc, 1),
    "min": (_least, 2),
    "max": (_greatest, 2),
    "equal": (_compare("__eq__"), 2),
    "not_equal": (lambda x, y: flag(holds(x != y, unknown=True)), 2),
    "less": (_compare("__lt__"), 2),
    "less_or_equal": (_compare("__le__"), 2),
    "greater": (_compare("__gt__"), 2),
    "greater_or_equal": (_compare("__ge__"), 2),
    "logical_and": (lambda x, y: flag(truthy(x) & truthy(y)), 2),
    "logical_or": (lambda x, y: flag(truthy(x) | truthy(y)), 2),
    "logical_not": (lambda x: flag(~truthy(x)), 1),
    "sigmoid": (lambda x: 1 / (1 + F.exp(-x)), 1),
    "tanh": (F.tanh, 1),
    "relu": (lambda x: F.when(x > 0, x).otherwise(F.lit(0.0)), 1),
    "softplus": (lambda x: F.log1p(F.exp(x)), 1),
    "is_missing": (lambda x: flag(x.isNull()), 1),
    "is_not_missing": (lambda x: flag(x.isNotNull()), 1),
    "if": (lambda c, x, y: F.when(truthy(c), x).otherwise(y), 3),
    "clamp": (_clamp, 3),
    "coalesce": (F.coalesce, None),
    "fill_missing": (F.coalesce, 2),
    "replace_missing": (F.coalesce, 2),
}

ALIASES = {
    "sub": "subtract", "mul": "multiply", "div": "divide", "neg": "negate", "greater_than": "greater", "less_than": "less",
    "and": "logical_and", "or": "logical_or", "not": "logical_not",
}

#: Known names of string functions; as numbers they are always missing.
STRING_FUNCTIONS = frozenset(
    """concat lower upper trim ltrim rtrim substring substr left right length char_length regexp_replace replace split lpad rpad
    repeat reverse initcap translate ascii base64 unbase64 decode encode format_string printf nvl nvl2""".split()
)


def _apply(name: str, raw: list[Expr], env: Mapping[str, Column], functions: Mapping[str, UserFunction], depth: int) -> Column:
    name = ALIASES.get(name, name)
    if name == "leaky_relu":
        slope = raw[1] if len(raw) > 1 else 0.01
        if len(raw) not in (1, 2) or isinstance(slope, bool) or not isinstance(slope, (int, float)):
            raise GraphError("leaky_relu takes a value and a literal slope")
        x = compile_expr(raw[0], env, functions, depth)
        return F.when(x > 0, x).otherwise(x * float(slope))
    if name in STRING_FUNCTIONS:
        return missing()
    if name in FUNCTIONS:
        function, arity = FUNCTIONS[name]
        if len(raw) != arity and not (arity is None and raw):
            raise GraphError(f"{name} takes {arity or 'one or more'} arguments, not {len(raw)}")
        return function(*[compile_expr(a, env, functions, depth) for a in raw])
    if name in functions:
        user = functions[name]
        if len(raw) != len(user.params):
            raise GraphError(f"{name} takes {len(user.params)} arguments, not {len(raw)}")
        if depth > 64:
            raise GraphError(f"{name} calls itself")
        inner = dict(env) | {p: compile_expr(a, env, functions, depth) for p, a in zip(user.params, raw)}
        return compile_expr(user.body, inner, functions, depth + 1)
    raise GraphError(f"unknown function {name}")


def compile_expr(expr: Expr, env: Mapping[str, Column], functions: Mapping[str, UserFunction] | None = None, depth: int = 0) -> Column:
    """The expression as a DOUBLE column over env, whose columns are numbers with NULL for missing."""
    if expr is None:
        return missing()
    if isinstance(expr, (bool, int, float)):
        return F.lit(float(expr)) if not (isinstance(expr, float) and math.isnan(expr)) else missing()
    if isinstance(expr, str):
        return compile_expr(parse(expr), env, functions, depth)
    if isinstance(expr, Mapping):
        if "col" in expr:
            if expr["col"] not in env:
                raise GraphError(f"unknown column {expr['col']}")
            return env[expr["col"]]
        if "lit" in expr:
            return missing() if isinstance(expr["lit"], str) else compile_expr(expr["lit"], env)
        if "fn" in expr:
            return _apply(expr["fn"].rsplit("functions.", 1)[-1], list(expr.get("args", ())), env, functions or {}, depth)
    raise GraphError(f"not an expression: {expr!r}")


_BINARY = {ast.Add: "add", ast.Sub: "subtract", ast.Mult: "multiply", ast.Div: "divide", ast.Mod: "mod", ast.Pow: "pow"}
_COMPARE = {ast.Eq: "equal", ast.NotEq: "not_equal", ast.Lt: "less", ast.LtE: "less_or_equal", ast.Gt: "greater", ast.GtE: "greater_or_equal"}


def parse(text: str) -> Expr:
    """An expression from Python syntax; names are columns. Write ``if_(c, a, b)`` and ``and``/``or``/``not`` as usual."""

    def walk(n: ast.AST) -> Expr:
        match n:
            case ast.Constant(value=str() as v):
                return {"lit": v}
            case ast.Constant(value=v) if v is None or isinstance(v, (bool, int, float)):
                return v
            case ast.Name(id=name):
                return {"col": name}
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return {"fn": _BINARY[type(op)], "args": [walk(a), walk(b)]}
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=v)) if isinstance(v, (int, float)):
                return -v
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return {"fn": "negate", "args": [walk(a)]}
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return {"fn": "logical_not", "args": [walk(a)]}
            case ast.BoolOp(op=op, values=values):
                name = "logical_and" if isinstance(op, ast.And) else "logical_or"
                out = walk(values[0])
                for v in values[1:]:
                    out = {"fn": name, "args": [out, walk(v)]}
                return out
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return {"fn": _COMPARE[type(op)], "args": [walk(a), walk(b)]}
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                return {"fn": name.rstrip("_"), "args": [walk(a) for a in args]}
        raise GraphError(f"can't read {text!r}")

    return walk(ast.parse(text, mode="eval").body)
