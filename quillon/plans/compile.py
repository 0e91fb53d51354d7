"""Graphs as DataFrame plans: one projection after another, no shuffle.

Each node's results become columns of their own before the next node reads
them, so that no expression is written out twice however often it is read;
Catalyst merges the projections and drops what no output needs.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import models  # noqa: F401
from ..functions.expressions import BadShape, GraphError, MissingInput, UnknownOperator, UnknownOutput
from ..functions.policies import apply_policy
from ..functions.values import missing, number
from ..models import anomaly, bayes, clusters, linear, networks, svm, trees  # noqa: F401
from ..operators import OPERATORS, Value
from ..operators.registry import Context, dealt, matrix
from .spec import Graph, Input, Node

HIDDEN = "__q"


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class _Plan:
    """The frame so far, and a counter for the columns that are added to it."""

    def __init__(self, graph: Graph, df: DataFrame):
        self.graph, self.df, self.n = graph, df, 0
        self.own = list(df.columns)

    def keep(self, values: list[Value]) -> list[Value]:
        """The values as columns of the frame."""
        new, out = [], []
        for v in values:
            cols = []
            for c in v.cols:
                name = f"{HIDDEN}{self.n}"
                self.n += 1
                new.append(c.alias(name))
                cols.append(F.col(name))
            out.append(replace(v, cols=cols))
        self.df = self.df.select("*", *new)
        return out

    def attrs(self, attrs: Mapping) -> dict:
        def const(v):
            if isinstance(v, Mapping) and set(v) == {"const"}:
                if v["const"] not in self.graph.constants:
                    raise GraphError(f"unknown constant {v['const']}")
                return self.graph.constants[v["const"]]
            return v

        return {k: const(v) for k, v in attrs.items()}

    def run(self, nodes: list[Node], scope: dict[str, Value]) -> None:
        for node in nodes:
            try:
                self.step(node, scope)
            except GraphError as e:
                raise type(e)(f"{node.op} ({', '.join(node.outputs)}): {e}") from e

    def read(self, name: str, scope: Mapping[str, Value]) -> Value:
        if name in scope:
            return scope[name]
        if name in self.graph.constants:
            v = self.graph.constants[name]
            flat = list(v) if isinstance(v, (list, tuple)) else [v]
            return Value([F.lit(x) if isinstance(x, str) else F.lit(float(x)) for x in flat], "string" if flat and isinstance(flat[0], str) else "number")
        raise MissingInput(f"there is no value {name}")

    def step(self, node: Node, scope: dict[str, Value]) -> None:
        if node.op == "composite":
            inner = {mine: self.read(outer, scope) for mine, outer in node.bind.items()}
            self.run(node.nodes, inner)
            for mine, outer in node.expose.items():
                scope[outer] = self.read(mine, inner)
            return
        if node.op not in OPERATORS:
            raise UnknownOperator("unknown operator")
        if node.op == "core.Identity":
            for a, b in zip(node.inputs, node.outputs):
                scope[b] = self.read(a, scope)
            return
        ins = [self.read(n, scope) for n in node.inputs]
        if node.op == "core.Reshape" and self.reshape(node, ins, scope):
            return
        first = {k: (v.cols[0] if v.kind == "number" and v.cols else missing()) for k, v in scope.items()}
        constants = {k: F.lit(float(v)) for k, v in self.graph.constants.items() if isinstance(v, (int, float))}
        ctx = Context(self.df.sparkSession, self.attrs(node.attrs), len(node.outputs), node.inputs, node.outputs, constants | first, self.graph.functions)
        made = dealt(OPERATORS[node.op](ins, ctx), len(node.outputs))
        scope.update(zip(node.outputs, self.keep(made)))


    def reshape(self, node: Node, ins: list[Value], scope: dict[str, Value]) -> bool:
        """Whether the node makes other rows; then only its value, the order's column (the new rows, from 0) and by's are left."""
        attrs, cols = self.attrs(node.attrs), matrix(ins)
        width = int(attrs["new_shape"][-1]) if attrs.get("new_shape") else -1
        if width in (-1, len(cols)) or not attrs.get("order"):
            return False
        order, by = str(attrs["order"]), attrs.get("by")
        if width < 1:
            raise BadShape(f"rows of {width} values can't be")
        if absent := {c for c in (order, by) if c and c not in self.own}:
            raise MissingInput(f"the data has no column {', '.join(sorted(absent))}")
        kept = [named(c) for c in (order, by) if c]
        made = reshape_rows(self.df.select(*kept, F.array(*cols).alias(HIDDEN)), HIDDEN, width, order, by)
        self.own = [order, *([by] if by else [])]
        self.df = made.select(F.col("row").alias(order), *kept[1:], HIDDEN)
        scope.clear()
        scope[node.outputs[0]] = self.keep([Value([F.get(F.col(HIDDEN), F.lit(k)) for k in range(width)])])[0]
        return True


def _inputs(graph: Graph, df: DataFrame, vector: str | None) -> tuple[list[Input], list[Value]]:
    out, at = [], 0
    for i in graph.inputs:
        if vector is not None:
            cols = [F.get(named(vector), F.lit(at + k)) for k in range(i.width)]
            at += i.width
        else:
            source = i.column or i.name
            if source not in df.columns:
                raise MissingInput(f"the data has no column {source}")
            kind = df.schema[source].dataType.typeName()
            if i.type != "tokens" and kind == "array":
                cols = [F.get(named(source), F.lit(k)) for k in range(i.width)]
            elif i.width > 1:
                raise BadShape(f"{source} must be an array of {i.width}")
            else:
                cols = [named(source)]
        cols = cols if i.type == "tokens" else [c.cast("string") for c in cols] if i.type == "string" else [number(c) for c in cols]
        out.append(Value(cols, i.type))
    return graph.inputs, out


def apply_graph(graph: Graph, df: DataFrame, outputs: list[str] | None = None, vector: str | None = None) -> DataFrame:
    """df with the graph's outputs (or those named) as further columns.

    Wide outputs are arrays. vector names an array column to be dealt out
    over all inputs in order. An output replaces a column of its name. Works
    on streams as well: every row is scored by itself, unless the graph has a
    Reshape that makes other rows. That one reads on through the rows by the
    column named by its attribute order (unique numbers; with by, within each
    group); what it doesn't make is out of reach of later nodes and outputs.
    """
    plan = _Plan(graph, df)
    declared, values = _inputs(graph, df, vector)
    scope = dict(zip([i.name for i in declared], plan.keep(values)))
    if graph.schema:
        for f in graph.schema:
            if f.name not in scope:
                raise GraphError(f"the schema has a feature {f.name} that is no input")
        changed = [f for f in graph.schema if scope[f.name].kind == "number"]
        scope.update(zip([f.name for f in changed], plan.keep([Value([apply_policy(c, f.policy) for c in scope[f.name].cols]) for f in changed])))
    plan.run(graph.nodes, scope)
    wanted = [o for o in graph.outputs if outputs is None or o.name in outputs]
    if outputs is not None and len(wanted) != len(set(outputs)):
        raise UnknownOutput(f"unknown outputs: {', '.join(set(outputs) - {o.name for o in wanted})}")
    made = []
    for o in wanted:
        v = plan.read(o.value or o.name, scope)
        c = v.cols[0] if v.width == 1 else F.array(*v.cols)
        made.append(c.alias(o.name, metadata=({"role": o.role} if o.role else {}) | ({"width": v.width} if v.width != 1 else {})))
    names = {o.name for o in wanted}
    return plan.df.select(*[named(c) for c in plan.own if c not in names], *made)


RANGES = 200


def reshape_rows(df: DataFrame, column: str, width: int, order: str, by: str | None = None) -> DataFrame:
    """An array column read on, row after row, and cut anew into arrays of width: (row, column).

    The one reshaping that changes the number of rows. Rows follow order, a
    number that must be unique, within each group of by. Without by all rows
    are one sequence: its places are counted range by range of order, and
    only the ranges' sums, a fixed number, come to the driver. The last array
    may be short.
    """
    key = named(by) if by else F.lit(0)
    rows = df.select(key.alias("_g"), named(order).alias("_o"), named(column).alias("_x")).where(F.size("_x") > 0)
    ahead = F.lit(0).cast("bigint")
    part = F.lit(0)
    if not by:
        rows = rows.withColumn("_d", F.col("_o").cast("double"))
        bounds = sorted(set(rows.approxQuantile("_d", [i / RANGES for i in range(1, RANGES)], 0.1 / RANGES)))
        if bounds:
            rows = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_d", outputCol="_p").transform(rows)
            part = F.col("_p")
            upto, offsets = 0, []
            for r in sorted(rows.groupBy("_p").agg(F.sum(F.size("_x")).alias("n")).collect()):
                offsets += [F.lit(r["_p"]), F.lit(upto)]
                upto += r["n"]
            ahead = F.element_at(F.create_map(*offsets), part).cast("bigint") if offsets else ahead
    before = W.partitionBy("_g", part).orderBy("_o").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("_g", "_x", (ahead + F.coalesce(F.sum(F.size("_x")).over(before), F.lit(0))).alias("_before"))
    flat = rows.select("_g", "_before", F.posexplode("_x").alias("_i", "_v")).select("_g", (F.col("_before") + F.col("_i")).alias("_at"), "_v")
    cut = flat.groupBy("_g", F.floor(F.col("_at") / width).cast("bigint").alias("row")).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_c"))
    return cut.select(*([F.col("_g").alias(by)] if by else []), "row", F.transform("_c", lambda x: x["_v"]).alias(column))


def to_sparse(column: Column) -> Column:
    """An array of numbers as a map from index to value, without zeros."""
    pairs = F.transform(column, lambda x, i: F.struct(i.alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: F.abs(p["value"]) > 0))
