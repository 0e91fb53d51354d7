"""Predicates: conditions over named columns that are true or false, never unknown.

``True``, ``False``, ``{"field", "op", "value"}`` with op one of < <= > >= =
!= is_missing is_not_missing, ``{"field", "op": "in" | "not_in", "values"}``,
and ``{"op": "and" | "or" | "xor" | "surrogate", "args": [...]}``.

A comparison with a missing value is false, ``!=`` included; so is one with
a string. ``not_in`` is true for a missing value. A compound without
arguments is false; surrogate is a plain or.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import GraphError
from .values import holds

_SIMPLE = {
    "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v,
    "=": lambda x, v: x == v, "==": lambda x, v: x == v, "!=": lambda x, v: x != v,
}
_COMPOUND = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b, "surrogate": lambda a, b: a | b}


def compile_predicate(pred: object, env: Mapping[str, Column]) -> Column:
    if isinstance(pred, bool):
        return F.lit(pred)
    if not isinstance(pred, Mapping) or "op" not in pred:
        raise GraphError(f"not a predicate: {pred!r}")
    op = pred["op"]
    if op in _COMPOUND:
        parts = [compile_predicate(p, env) for p in pred.get("args", ())]
        return reduce(_COMPOUND[op], parts) if parts else F.lit(False)
    if pred.get("field") not in env:
        raise GraphError(f"unknown column {pred.get('field')}")
    x = env[pred["field"]]
    if op == "is_missing":
        return x.isNull()
    if op == "is_not_missing":
        return x.isNotNull()
    if op in ("in", "not_in"):
        values = [float(v) for v in pred["values"] if not isinstance(v, str)]
        known = x.isin(values) if values else F.lit(False)
        return holds(known) if op == "in" else ~holds(known)
    if op not in _SIMPLE:
        raise GraphError(f"unknown comparison {op}")
    value = pred["value"]
    return F.lit(False) if value is None or isinstance(value, str) else holds(_SIMPLE[op](x, F.lit(float(value))))
