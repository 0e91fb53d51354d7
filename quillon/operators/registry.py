"""Operators by domain and name, and the values they pass on."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import BadShape, Expr, GraphError, MissingAttribute, UserFunction
from ..functions.values import missing


@dataclass
class Value:
    """A row's value: one column for each of its elements, or for ``tokens`` a single array of strings.

    A ``map`` is a wide sparse value: one column of index to number, whose size is that of its dense form.
    If a normalizer made it, ``whole`` is the map that it divided, and ``divisors`` gives the rows' divisors from
    their number and each entry's row and value: sums over entries then divide once, not each entry before.
    """

    cols: list[Column]
    kind: str = "number"  # number, string, tokens or map
    names: list[str] | None = None
    size: int = 0
    whole: Column | None = None
    divisors: Callable | None = None

    @property
    def width(self) -> int:
        return len(self.cols)


@dataclass
class Context:
    """What an operator may use besides its inputs."""

    spark: SparkSession
    attrs: Mapping[str, object]
    n_out: int
    in_names: list[str] = field(default_factory=list)
    out_names: list[str] = field(default_factory=list)
    env: Mapping[str, Column] = field(default_factory=dict)
    functions: Mapping[str, UserFunction] = field(default_factory=dict)

    def get(self, name: str, default: object = None) -> object:
        got = self.attrs.get(name)
        return default if got is None else got

    def need(self, name: str) -> object:
        if self.attrs.get(name) is None:
            raise MissingAttribute(f"attribute {name} is required")
        return self.attrs[name]

    def numbers(self, name: str, n: int | None = None, default: float | None = None) -> list[float | None] | None:
        """A flat list attribute; to n elements by default, or one for all."""
        got = self.attrs.get(name)
        if got is None:
            return None if default is None else [default] * (n or 1)
        out = [None if v is None else float(v) for v in (got if isinstance(got, (list, tuple)) else [got])]
        if n is not None and len(out) == 1:
            out *= n
        if n is not None and len(out) < n:
            if default is None:
                raise BadShape(f"{name} has {len(out)} values, not {n}")
            out += [default] * (n - len(out))
        return out


Result = "list[Column] | Value | list[Value]"
OPERATORS: dict[str, Callable[[list[Value], Context], object]] = {}


def operator(domain: str, name: str, *aliases: str):
    """Registers a function of (inputs, context). A list of columns is one matrix, dealt out to the node's outputs; a list of values is one for each output."""

    def register(f):
        for n in (name, *aliases):
            OPERATORS[f"{domain}.{n}"] = f
        return f

    return register


def matrix(ins: list[Value]) -> list[Column]:
    """All inputs side by side."""
    if any(v.kind == "map" for v in ins):
        raise BadShape("this operator takes no sparse value of so many features")
    return [c for v in ins for c in v.cols]


def dealt(result: object, n_out: int) -> list[Value]:
    """The result as one value for each output name: a matrix goes whole to a single name, or by columns."""
    if isinstance(result, Value):
        result = [result] if n_out == 1 or result.width != n_out else [Value([c], result.kind) for c in result.cols]
    if result and isinstance(result[0], Value):
        if len(result) < n_out:
            raise BadShape(f"{n_out} outputs are named, {len(result)} made")
        return result[:n_out]
    if n_out == 1:
        return [Value(list(result))]
    if len(result) < n_out:
        raise BadShape(f"{n_out} outputs are named, {len(result)} columns made")
    return [Value([c]) for c in result[:n_out]]


def sparse(ins: list[Value]) -> Value | None:
    """The input, if it is a single sparse value."""
    return ins[0] if len(ins) == 1 and ins[0].kind == "map" else None


def argmax(cols: list[Column]) -> Column:
    """Index of the first largest column; missing ones never win, and none gives 0."""
    if len(cols) == 1:
        return F.lit(0.0)
    row = F.array(*cols)
    return F.coalesce(F.array_position(row, F.array_max(row)) - 1, F.lit(0)).cast("double")


def argmin(cols: list[Column]) -> Column:
    if len(cols) == 1:
        return F.lit(0.0)
    row = F.array(*cols)
    return F.coalesce(F.array_position(row, F.array_min(row)) - 1, F.lit(0)).cast("double")


def total(cols: list[Column]) -> Column:
    """Sum from left to right; missing if any is."""
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def dot(cols: list[Column], weights: list[float]) -> Column:
    if not cols:
        return F.lit(0.0)
    return total([c * F.lit(float(w)) for c, w in zip(cols, weights)])


__all__ = ["OPERATORS", "Context", "Expr", "GraphError", "Value", "argmax", "argmin", "dealt", "dot", "matrix", "missing", "operator", "sparse", "total"]
