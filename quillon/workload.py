"""Queries over the driver's tables, one or more for each operator, each with its SQL.

A query is a base (a projection of one table, in SQL that Spark and DuckDB
share), a graph, and for each output column an expression in DuckDB's SQL.
Numbers are compared as whole millionths.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans import Graph, apply_graph


@dataclass(frozen=True)
class Base:
    table: str
    keys: tuple[str, ...]
    exprs: tuple[str, ...]
    duck: tuple[str, ...] = ()
    types: tuple[tuple[str, str], ...] = ()

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").selectExpr(*self.keys, *self.exprs)

    def sql(self) -> str:
        return f"SELECT {', '.join((*self.keys, *(self.duck or self.exprs)))} FROM {self.table}"

    def inputs(self) -> list[dict]:
        kinds = dict(self.types)
        return [{"name": n, "type": kinds.get(n, "number")} for n in (e.rsplit(" AS ", 1)[1] for e in self.exprs)]


LINES = Base(
    "lineitem", ("l_orderkey", "l_linenumber"),
    ("l_quantity AS q", "l_extendedprice AS e", "l_discount AS d", "l_tax AS t", "CAST(l_linenumber AS DOUBLE) AS n",
     "CAST(NULLIF(l_linenumber, 3) AS DOUBLE) AS m", "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS qm",
     "CAST(l_linenumber % 3 AS DOUBLE) AS v1", "CAST((l_partkey + 1) % 3 AS DOUBLE) AS v2", "CAST(l_suppkey % 3 AS DOUBLE) AS v3",
     "l_returnflag AS flag", "l_linestatus AS status"),
    types=(("flag", "string"), ("status", "string")),
)
EVENTS = Base("events", ("event_id",), ("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v", "CAST(user_id AS DOUBLE) AS u", "event_type AS kind"), types=(("kind", "string"),))
CUSTOMERS = Base("customer", ("c_custkey",), ("c_acctbal AS b", "c_mktsegment AS seg", "CAST(c_nationkey AS DOUBLE) AS nat"), types=(("seg", "string"),))
PARTS = Base("part", ("p_partkey",), ("CAST(p_size AS DOUBLE) AS s", "p_retailprice AS r", "p_type AS kind", "p_brand AS brand"), types=(("kind", "string"), ("brand", "string")))
ORDERS = Base("orders", ("o_orderkey",), ("o_totalprice AS p", "o_orderpriority AS prio"), types=(("prio", "string"),))
DIMS = 8
VECTORS = Base(
    "embeddings", ("vec_id",), tuple(f"CAST(embedding[{i}] AS DOUBLE) AS x{i}" for i in range(DIMS)),
    tuple(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(DIMS)),
)
TEXTS = Base("documents", ("doc_id",), ("text AS text",), types=(("text", "string"),))
X = [f"x{i}" for i in range(DIMS)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def node(op: str, inputs: str | list[str], outputs: str | list[str], **attrs: object) -> dict:
    return {"op": op, "inputs": inputs, "outputs": outputs, "attrs": attrs}


def whole(df: DataFrame, keys: tuple[str, ...], outputs: list[str], widths: Mapping[str, int]) -> DataFrame:
    """Keys and outputs, numbers in whole millionths, arrays of numbers as columns, arrays of strings joined."""
    cols = list(map(F.col, keys))
    for o in outputs:
        kind = df.schema[o].dataType
        parts = [(o, F.col(o))]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            parts = [(o, F.array_join(o, "|"))]
        elif isinstance(kind, T.ArrayType):
            parts = [(f"{o}_{i}", F.get(F.col(o), F.lit(i))) for i in range(widths[o])]
        for name, c in parts:
            number = not isinstance(kind, T.StringType) and not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType))
            cols.append((F.floor(c * 1e6 + 0.5) if number else c).cast("bigint" if number else "string").alias(name))
    return df.select(*cols)


def query(name: str, base: Base, nodes: list[dict], want: Mapping[str, str | list[str]], texts: tuple[str, ...] = (), lets: str = "", **graph: object) -> None:
    """Registers a query; want maps outputs to SQL, a list for an array. lets: further SQL between base and outputs, reading ``b`` and giving ``c``."""
    outputs = list(want)
    spec = Graph.of({"version": "0.1.0", "inputs": base.inputs(), "nodes": nodes, "outputs": outputs, **graph})
    sizes = {k: len(v) for k, v in want.items() if isinstance(v, list)}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = base.frame(spark, sf_dir)
        return whole(apply_graph(spec, df), base.keys, outputs, sizes)

    QUERIES[name] = run
    cols = [(k, s) for k, v in want.items() for k, s in ([(f"{k}_{i}", x) for i, x in enumerate(v)] if isinstance(v, list) else [(k, v)])]
    body = ", ".join(f"{s} AS {k}" if k in texts else f"CAST(floor(CAST(({s}) AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS {k}" for k, s in cols)
    ORACLES[name] = f"WITH b AS ({base.sql()}){', ' + lets if lets else ''} SELECT {', '.join(base.keys)}, {body} FROM {'c' if lets else 'b'}"


def num(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def dot_sql(cols: list[str], weights: list[float]) -> str:
    return " + ".join(f"({c}) * {num(w)}" for c, w in zip(cols, weights))


def softmax_sql(cols: list[str]) -> list[str]:
    top = f"greatest({', '.join(cols)})"
    total = " + ".join(f"exp({c} - {top})" for c in cols)
    return [f"exp({c} - {top}) / ({total})" for c in cols]


def argmax_sql(cols: list[str]) -> str:
    """Index of the first largest, all known."""
    top = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} = {top} THEN {i}" for i, c in enumerate(cols)) + " END"


def sigmoid_sql(c: str) -> str:
    return f"1 / (1 + exp(-({c})))"


# 2.1 core

query("core_identity_concat", LINES, [node("core.Identity", "q", "a"), node("core.Concat", ["q", "e", "d"], "w")], {"a": "q", "w": ["q", "e", "d"]})
query("core_gather_take_slots", LINES, [
    node("core.Concat", ["q", "e", "d", "t"], "w"), node("core.Gather", "w", "g", indices=[2, 0]),
    node("core.TakeSlots", ["w", "n"], "s", indices=[4, 1]), node("core.TakeSlots", ["q", "n"], "z", names=["n"]),
], {"g": ["d", "q"], "s": ["n", "e"], "z": "n"})
query("core_clip", LINES, [node("core.Clip", "qm", "a", min=10, max=40), node("core.Clip", ["e"], "b", min=5000)], {"a": "CASE WHEN qm IS NOT NULL THEN greatest(10.0, least(40.0, qm)) END", "b": "greatest(5000.0, e)"})
query("core_argmax", LINES, [node("core.Concat", ["v1", "v2", "m"], "w"), node("core.ArgMax", "w", "a")], {
    "a": "CASE WHEN v1 >= v2 AND (m IS NULL OR v1 >= m) THEN 0 WHEN v2 > v1 AND (m IS NULL OR v2 >= m) THEN 1 ELSE 2 END"})
query("core_select_by_scores", LINES, [
    node("core.Concat", ["v1", "v2", "v3"], "p"), node("core.Concat", ["d", "t", "n"], "s"), node("core.SelectByPrimarySecondaryScore", ["p", "s"], "a"),
], {"a": "CASE WHEN (v1 > v2 OR (v1 = v2 AND d >= t)) AND (v1 > v3 OR (v1 = v3 AND d >= n)) THEN 0 WHEN (v2 > v1 OR (v2 = v1 AND t > d)) AND (v2 > v3 OR (v2 = v3 AND t >= n)) THEN 1 ELSE 2 END"})
query("core_cast", LINES, [node("core.Cast", "e", "i", output_dtype="int64"), node("core.Cast", "e", "f", output_dtype="float32"), node("core.Cast", "e", "g", output_dtype="float64")], {
    "i": "CASE WHEN e < 0 THEN -floor(-e + 0.5) ELSE floor(e + 0.5) END", "f": "CAST(CAST(e AS FLOAT) AS DOUBLE)", "g": "e"})
query("core_reshape_split", LINES, [
    node("core.Concat", ["q", "e", "d"], "w"), node("core.Reshape", "w", "r", new_shape=[-1, 3]), node("core.Split", "r", ["a", "c"], sections=[1, 2]),
], {"a": "q", "c": ["e", "d"]})
query("core_reshape_across", EVENTS, [node("core.Concat", ["v", "u"], "w"), node("core.Reshape", "w", "a", new_shape=[-1, 3], order="event_id")], {"a": ["x0", "x1", "x2"]}, lets="""
l AS (SELECT event_id, 0 AS i, v AS x FROM b UNION ALL SELECT event_id, 1, u FROM b), p AS (SELECT x, row_number() OVER (ORDER BY event_id, i) - 1 AS pos FROM l),
c AS (SELECT pos // 3 AS event_id, max(x) FILTER (pos % 3 = 0) AS x0, max(x) FILTER (pos % 3 = 1) AS x1, max(x) FILTER (pos % 3 = 2) AS x2 FROM p GROUP BY pos // 3)""")
query("core_derive", LINES, [
    node("core.Concat", ["q", "e"], "w"), node("core.Derive", "w", "x", expr="w / (1 + d)"), node("core.Derive", ["q"], "y", expr="twice(q) - t"),
], {"x": ["q / (1 + d)", "e / (1 + d)"], "y": "2 * q - t"}, functions={"twice": {"params": ["a"], "body": "a + a"}})
query("core_select", LINES, [node("core.Select", ["v1", "q", "e"], "a"), node("core.Select", ["n", "q", "e", "d"], "c")], {
    "a": "CASE WHEN v1 >= 1 THEN e ELSE q END", "c": "CASE WHEN n >= 2 THEN d WHEN n >= 1 THEN e ELSE q END"})
query("core_sparse_dense", LINES, [node("core.Concat", ["v1", "q"], "w"), node("core.DenseToSparse", "w", "s"), node("core.SparseToDense", "s", "a")], {"a": ["v1", "q"]})
query("core_sum_average", LINES, [node("core.Sum", ["q", "e", "m"], "a"), node("core.Average", ["q", "e", "d"], "c")], {"a": "q + e + m", "c": "(q + e + d) / 3"})
query("core_min_max_median", LINES, [
    node("core.Min", ["q", "n", "m"], "a"), node("core.Max", ["q", "n", "m"], "c"), node("core.Median", ["q", "n", "v1", "v2"], "k"),
], {"a": "CASE WHEN m IS NOT NULL THEN least(q, n, m) END", "c": "CASE WHEN m IS NOT NULL THEN greatest(q, n, m) END", "k": "list_extract(list_sort([q, n, v1, v2]), 3)"})
query("core_weighted_sum", LINES, [
    node("core.WeightedSum", ["q", "e", "m"], "a", weights=[0.5, 0.25]), node("core.Concat", ["q", "e"], "w"), node("core.WeightedSum", "w", "c", weights=[2, 3]),
    node("core.WeightedAverage", ["q", "e", "d"], "k", weights=[1, 2, 3]),
], {"a": "0.5 * q + 0.25 * e + m", "c": ["2 * q", "3 * e"], "k": "(q + 2 * e + 3 * d) / 6"})
query("core_weighted_median", LINES, [node("core.WeightedMedian", ["v1", "v2", "v3"], "a", weights=[0.2, 0.5, 0.3])], {
    "a": "CASE WHEN 0.2 * CAST(v1 <= 0 AS INT) + 0.5 * CAST(v2 <= 0 AS INT) + 0.3 * CAST(v3 <= 0 AS INT) >= 0.5 THEN 0 WHEN 0.2 * CAST(v1 <= 1 AS INT) + 0.5 * CAST(v2 <= 1 AS INT) + 0.3 * CAST(v3 <= 1 AS INT) >= 0.5 THEN 1 ELSE 2 END"})
_TALLY = [" + ".join(f"{w} * CAST({v} = {c} AS INT)" for w, v in ((1, "v1"), (1, "v2"), (1, "v3"))) for c in range(3)]
_WEIGHED = [" + ".join(f"{w} * CAST({v} = {c} AS INT)" for w, v in ((3, "v1"), (4, "v2"), (2, "v3"))) for c in range(3)]
query("core_votes", LINES, [node("core.MajorityVote", ["v1", "v2", "v3"], "a"), node("core.WeightedMajorityVote", ["v1", "v2", "v3"], "c", weights=[3, 4, 2])], {"a": argmax_sql(_TALLY), "c": argmax_sql(_WEIGHED)})
query("core_soft_vote", LINES, [
    node("core.Concat", ["d", "t"], "p1"), node("core.Concat", ["t", "d"], "p2"), node("core.SoftVote", ["p1", "p2"], ["a", "la"], weights=[3, 1]),
    node("core.SoftVote", ["d", "t", "v1"], ["c", "lc"], normalize_rows=True),
], {
    "a": ["(3 * d + t) / 4", "(3 * t + d) / 4"], "la": "CASE WHEN (3 * t + d) / 4 > (3 * d + t) / 4 THEN 1 ELSE 0 END",
    "c": [f"CASE WHEN d + t + v1 > 0 THEN {c} / (d + t + v1) ELSE {c} END" for c in ("d", "t", "v1")],
    "lc": "CASE WHEN d >= t AND d >= v1 THEN 0 WHEN t >= v1 THEN 1 ELSE 2 END",
})
_SAMME = ["(" + " + ".join(f"CASE WHEN {v} = {c} THEN {w / 9} ELSE {-w / 9 / 2} END" for w, v in ((2, "v1"), (3, "v2"), (4, "v3"))) + ") / 2" for c in range(3)]
query("core_samme_vote", LINES, [node("core.SAMMEVote", ["v1", "v2", "v3"], ["p", "l"], weights=[2, 3, 4], n_classes=3)], {"p": softmax_sql(["s0", "s1", "s2"]), "l": argmax_sql(["s0", "s1", "s2"])},
      lets=f"c AS (SELECT *, {', '.join(f'{s} AS s{i}' for i, s in enumerate(_SAMME))} FROM b)")

# 2.2 feature: scalers

_SCALED = [("q", 25.5, 14.4), ("e", 38000.0, 23000.0), ("m", 4.0, 0.0)]
for _op, _shift in (("StandardScaler", "mean"), ("RobustScaler", "center")):
    query(f"feature_{_op.lower()}", LINES, [node(f"feature.{_op}", [c for c, _, _ in _SCALED], "a", **{_shift: [m for _, m, _ in _SCALED], "scale": [s for _, _, s in _SCALED]})],
          {"a": [f"({c} - {num(m)})" + (f" / {num(s)}" if s else "") for c, m, s in _SCALED]})
query("feature_minmaxscaler", LINES, [node("feature.MinMaxScaler", ["q", "e"], "a", data_min=[1, 900], data_max=[49, 0], feature_range_min=-1, feature_range_max=1)], {"a": ["(q - 1) / 49 * 2 - 1", "(e - 900) * 2 - 1"]})
query("feature_maxabsscaler", LINES, [node("feature.MaxAbsScaler", ["q", "e"], "a", scale=[50, 0])], {"a": ["q / 50", "e"]})
query("feature_normalizer", LINES, [node("feature.Normalizer", ["q", "n", "d"], "a", norm="l2"), node("feature.Normalizer", ["q", "n"], "c", norm="l1"), node("feature.Normalizer", ["d", "t"], "k", norm="max")], {
    "a": [f"{c} / sqrt(q * q + n * n + d * d)" for c in ("q", "n", "d")], "c": [f"{c} / (abs(q) + abs(n))" for c in ("q", "n")],
    "k": [f"CASE WHEN greatest(abs(d), abs(t)) > 1e-12 THEN {c} / greatest(abs(d), abs(t)) ELSE {c} END" for c in ("d", "t")]})
query("feature_powertransformer", CUSTOMERS, [
    node("feature.PowerTransformer", "b", "a", lambdas=[0.5]), node("feature.PowerTransformer", "b", "k", lambdas=[0], mean=[1], scale=[2]), node("feature.PowerTransformer", "b", "c", lambdas=[0.25], method="box_cox"),
    node("feature.PowerTransformer", "b", "e", lambdas=[2]),
], {
    "a": "CASE WHEN b >= 0 THEN (pow(b + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - b, 1.5) - 1) / 1.5 END",
    "k": "(CASE WHEN b >= 0 THEN ln(1 + b) ELSE -(pow(1 - b, 2) - 1) / 2 END - 1) / 2",
    "c": "(pow(greatest(b, 1e-10), 0.25) - 1) / 0.25", "e": "CASE WHEN b >= 0 THEN (pow(b + 1, 2) - 1) / 2 ELSE -ln(1 - b) END",
})
_REFS, _LEVELS = [1.0, 10.0, 25.0, 50.0], [0.0, 0.25, 0.5, 1.0]
_QUANTILE = "CASE WHEN q <= 1 THEN 0.0 WHEN q >= 50 THEN 1.0 " + " ".join(
    f"WHEN q < {b} THEN {num(x)} + (q - {num(a)}) / {num(b - a + 1e-12)} * {num(y - x)}" for a, b, x, y in zip(_REFS, _REFS[1:], _LEVELS, _LEVELS[1:])) + " END"
_PROBIT = "CASE WHEN u < 0.5 THEN -1 ELSE 1 END * (w - (2.515517 + 0.802853 * w + 0.010328 * w * w) / (1 + 1.432788 * w + 0.189269 * w * w + 0.001308 * w * w * w))"
query("feature_quantiletransformer", LINES, [
    node("feature.QuantileTransformer", "q", "a", quantiles=_LEVELS, references=[_REFS]), node("feature.QuantileTransformer", "q", "k", quantiles=_LEVELS, references=[_REFS], output_distribution="normal"),
], {"a": "z", "k": _PROBIT}, lets=f"z0 AS (SELECT *, {_QUANTILE} AS z FROM b), z1 AS (SELECT *, greatest(1e-7, least(1 - 1e-7, z)) AS u FROM z0), c AS (SELECT *, sqrt(-2 * ln(least(u, 1 - u))) AS w FROM z1)")
_MANY_REFS = [round(1 + 49 * (i / 999) ** 1.5, 9) for i in range(1000)]
_MANY = f"CASE WHEN q <= 1 THEN 0.0 WHEN q >= 50 THEN 1.0 ELSE (k - 1) / {num(999)} + (q - r[k]) / (r[k + 1] - r[k] + 1e-12) * (k / {num(999)} - (k - 1) / {num(999)}) END"
query("feature_quantiletransformer_many", LINES, [
    node("feature.QuantileTransformer", "q", "a", quantiles=[i / 999 for i in range(1000)], references=[_MANY_REFS]), node("feature.QuantileTransformer", "q", "k", quantiles=[i / 999 for i in range(1000)], references=[_MANY_REFS], output_distribution="normal"),
], {"a": "z", "k": _PROBIT}, lets=f"x0 AS (SELECT *, CAST({_MANY_REFS!r} AS DOUBLE[]) AS r FROM b), x1 AS (SELECT *, len(list_filter(r, lambda x: x <= q)) AS k FROM x0), z0 AS (SELECT *, {_MANY} AS z FROM x1), "
      "z1 AS (SELECT *, greatest(1e-7, least(1 - 1e-7, z)) AS u FROM z0), c AS (SELECT *, sqrt(-2 * ln(least(u, 1 - u))) AS w FROM z1)")  # fmt: skip
query("feature_mapvalues_many", EVENTS, [node("feature.MapValues", "u", "a", keys=list(range(10_000)), values=[i * 7 % 101 for i in range(10_000)], default_value=-1), node("feature.OrdinalEncoder", "kind", "c", categories=[[*(f"none {i}" for i in range(100)), "click"]], default_values=[-2])],
      {"a": "CASE WHEN u < 10000 THEN CAST(u AS BIGINT) * 7 % 101 ELSE -1 END", "c": "CASE kind WHEN 'click' THEN 100 ELSE -2 END"})
query("feature_splinetransformer", PARTS, [node("feature.SplineTransformer", "s", "a", knots=[1, 1, 20, 50, 50], degree=1)], {"a": [
    "CASE WHEN s < 20 THEN (20 - s) / 19 ELSE 0 END", "CASE WHEN s < 20 THEN (s - 1) / 19 ELSE (50 - s) / 30 END", "CASE WHEN s >= 20 AND s < 50 THEN (s - 20) / 30 ELSE 0 END"]})
query("feature_polynomialfeatures", LINES, [
    node("feature.PolynomialFeatures", ["q", "d"], "a", max_degree=2), node("feature.PolynomialFeatures", ["q", "n"], "c", max_degree=2, interaction_only=True, include_bias=False),
    node("feature.PolynomialFeatures", ["q", "d"], "k", powers=[[2, 1], [0, 3]]),
], {"a": ["1", "d", "d * d", "q", "q * d", "q * q"], "c": ["n", "q", "q * n"], "k": ["q * q * d", "d * d * d"]})

# 2.2 feature: binners, missing values, encoders

query("feature_binarizer", LINES, [node("feature.Binarizer", "qm", "a", threshold=25), node("feature.Binarize", ["q", "d"], ["c", "k"], thresholds=[10, 0.05])], {
    "a": "CASE WHEN qm > 25 THEN 1 ELSE 0 END", "c": "CASE WHEN q > 10 THEN 1 ELSE 0 END", "k": "CASE WHEN d > 0.05 THEN 1 ELSE 0 END"})
query("feature_bucketizer", LINES, [node("feature.Bucketizer", ["qm", "n"], "a", boundaries=[10, 20, 30, 2, 4], boundary_offsets=[0, 3, 5])], {
    "a": ["CASE WHEN qm >= 30 THEN 3 WHEN qm >= 20 THEN 2 WHEN qm >= 10 THEN 1 ELSE 0 END", "CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END"]})
query("feature_discretizer", LINES, [
    node("feature.Discretizer", "qm", "a", bin_left=[0, 10, 30], bin_right=[10, 20, 40], bin_values=[1, 2, 3], right_closed=[False, True, True], default_value=-1, map_missing_to=9),
    node("feature.Discretize", "q", "c", bin_left=[1, 5], bin_right=[5, 9], bin_values=[7, 8]),
], {"a": "CASE WHEN qm IS NULL THEN 9 WHEN qm >= 0 AND qm < 10 THEN 1 WHEN qm BETWEEN 10 AND 20 THEN 2 WHEN qm BETWEEN 30 AND 40 THEN 3 ELSE -1 END", "c": "CASE WHEN q BETWEEN 1 AND 5 THEN 7 WHEN q BETWEEN 5 AND 9 THEN 8 END"})
query("feature_normcontinuous", LINES, [
    node("feature.NormContinuous", "q", "a", orig_points=[10, 20, 40], norm_points=[0, 1, 5]), node("feature.NormContinuous", "q", "c", orig_points=[10, 20, 40], norm_points=[0, 1, 5], outlier_treatment="as_is"),
], {"a": "CASE WHEN q <= 10 THEN 0 WHEN q >= 40 THEN 5 WHEN q <= 20 THEN (q - 10) / 10 ELSE 1 + (q - 20) / 20 * 4 END", "c": "CASE WHEN q <= 10 OR q >= 40 THEN NULL WHEN q <= 20 THEN (q - 10) / 10 ELSE 1 + (q - 20) / 20 * 4 END"})
query("feature_normdiscrete_mapvalues", LINES, [
    node("feature.NormDiscrete", "m", "a", value=2), node("feature.MapValues", "m", "c", keys=[1, 2, 4], values=[10, 20, 40], default_value=-1, map_missing_to=0), node("feature.MapValues", "n", "k", keys=[1], values=[5]),
], {"a": "CASE WHEN m IS NULL THEN NULL WHEN m = 2 THEN 1 ELSE 0 END", "c": "CASE WHEN m IS NULL THEN 0 WHEN m = 1 THEN 10 WHEN m = 2 THEN 20 WHEN m = 4 THEN 40 ELSE -1 END", "k": "CASE WHEN n = 1 THEN 5 END"})
query("feature_imputer", EVENTS, [
    node("feature.Imputer", ["v", "u"], "a", fill_tensor=[99, -1]), node("feature.SimpleImputer", "v", "c", fill_value=7), node("feature.Impute", "v", "k"), node("feature.MissingIndicator", ["v", "u"], "i"),
    node("feature.MissingIndicator", ["v", "u"], "j", feature_indices=[0]),
], {"a": ["coalesce(v, 99)", "coalesce(u, -1)"], "c": "coalesce(v, 7)", "k": "coalesce(v, 0)", "i": ["CASE WHEN v IS NULL THEN 1 ELSE 0 END", "0"], "j": "CASE WHEN v IS NULL THEN 1 ELSE 0 END"})
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]  # one of the five is left out: it is unknown
query("feature_onehotencoder", CUSTOMERS, [
    node("feature.OneHotEncoder", ["seg", "nat"], ["a", "c"], categories=[*_SEGMENTS, 1, 2, 3], category_offsets=[0, 4, 7]), node("feature.OneHotEncode", "nat", "k", categories=["x", "y"], category_offsets=[0, 2]),
], {"a": [f"CASE WHEN seg = '{s}' THEN 1 ELSE 0 END" for s in _SEGMENTS], "c": [f"CASE WHEN nat = {i} THEN 1 ELSE 0 END" for i in (1, 2, 3)], "k": [f"CASE WHEN nat = {i} THEN 1 ELSE 0 END" for i in (0, 1)]})
_ORDINAL = "CASE seg " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_SEGMENTS)) + " END"
query("feature_ordinal_label", CUSTOMERS, [
    node("feature.OrdinalEncoder", ["seg", "nat"], "a", categories=[*_SEGMENTS, 5, 6, 7], category_offsets=[0, 4, 7], default_values=[-1, None]), node("feature.LabelEncoder", "seg", "c", labels=_SEGMENTS),
    node("feature.LabelEncode", "nat", "k", labels=["3", "5", "z"]), node("feature.OrdinalEncoder", "seg", "o", categories=_SEGMENTS, encoded_values=[10, 20, 30, 40]),
], {"a": [f"coalesce({_ORDINAL}, -1)", "CASE nat WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 2 END"], "c": _ORDINAL, "k": "CASE nat WHEN 3 THEN 0 WHEN 5 THEN 1 WHEN 2 THEN 2 END", "o": f"({_ORDINAL}) * 10 + 10"})
query("feature_labelbinarizer", LINES, [
    node("feature.LabelBinarizer", "v1", "a", classes=[0, 1, 2], neg_label=-1), node("feature.LabelBinarizer", "d", "c"), node("feature.MultiLabelBinarizer", ["v1", "v2"], "k", classes=[0, 2]),
], {"a": [f"CASE WHEN v1 = {c} THEN 1 ELSE -1 END" for c in range(3)], "c": "CASE WHEN d >= 0.5 THEN 1 ELSE 0 END", "k": [f"CASE WHEN v1 = {c} OR v2 = {c} THEN 1 ELSE 0 END" for c in (0, 2)]})
query("feature_targetencoder", CUSTOMERS, [node("feature.TargetEncoder", ["seg"], "a", categories=_SEGMENTS, encoded_values=[1.5, 2.5, 3.5, 4.5], default_values=[0.25])], {"a": f"coalesce({_ORDINAL} + 1.5, 0.25)"})

# 2.2 feature: projections

_RNG = np.random.default_rng(3)
_W = _RNG.normal(size=(3, DIMS)).round(3)
_MEAN = _RNG.normal(size=DIMS).round(3).tolist()
_CENTRED = [f"({x} - {num(m)})" for x, m in zip(X, _MEAN)]
_PROJECTED = [dot_sql(X, r.tolist()) for r in _W]
_CENTRE_PROJECTED = [dot_sql(_CENTRED, r.tolist()) for r in _W]
query("feature_truncatedsvd", VECTORS, [node("feature.TruncatedSVD", X, "a", components=_W.tolist())], {"a": _PROJECTED})
query("feature_pca", VECTORS, [node("feature.PCA", X, "a", components=_W.tolist(), mean=_MEAN), node("feature.SparsePCA", X, "c", components=_W.tolist(), mean=_MEAN)], {"a": _CENTRE_PROJECTED, "c": _CENTRE_PROJECTED})
_WHITE = _RNG.normal(size=(2, DIMS)).round(3)
_MIX = np.array([[1.0, 0.5], [-0.25, 2.0]])
query("feature_fastica", VECTORS, [node("feature.FastICA", X, "a", components=_MIX.tolist(), whitening=_WHITE.tolist(), mean=_MEAN)], {"a": [dot_sql(_CENTRED, r) for r in (_MIX @ _WHITE).tolist()]})
_NOISE = (np.arange(DIMS) / 10 + 0.5).tolist()
_PSI = _W / np.asarray(_NOISE)
query("feature_factoranalysis", VECTORS, [node("feature.FactorAnalysis", X, "a", components=_W.tolist(), mean=_MEAN, noise_variance=_NOISE)], {"a": [dot_sql(_CENTRED, r) for r in (np.linalg.inv(np.eye(3) + _PSI @ _W.T) @ _PSI).tolist()]})
query("feature_nmf_lda", VECTORS, [node("feature.NMF", X, "a", components=_W.tolist()), node("feature.LatentDirichletAllocation", X, "c", components=_W.tolist())], {
    "a": [f"greatest(0.0, p{i})" for i in range(3)], "c": softmax_sql(["p0", "p1", "p2"])}, lets=f"c AS (SELECT *, {', '.join(f'{p} AS p{i}' for i, p in enumerate(_PROJECTED))} FROM b)")
_TRAIN = _RNG.normal(size=(6, DIMS)).round(3)
_DUAL = _RNG.normal(size=(2, 6)).round(3)


def _square_sql(cols: list[str], row: list[float]) -> str:
    return " + ".join(f"({c} - {num(v)}) * ({c} - {num(v)})" for c, v in zip(cols, row))


_KERNELS = ", ".join(f"exp(-0.125 * ({_square_sql(X, r)})) AS k{i}" for i, r in enumerate(_TRAIN.tolist()))
_ROW_MEANS, _ALL = [0.1, 0.2, 0.3, 0.1, 0.0, 0.05], 0.15
_KMEAN = "(" + " + ".join(f"k{i}" for i in range(6)) + ") / 6"
query("feature_kernelpca", VECTORS, [
    node("feature.KernelPCA", X, "a", fit_samples=_TRAIN.tolist(), dual_components=_DUAL.tolist(), kernel="rbf", gamma=0.125, kernel_center_row_mean=_ROW_MEANS, kernel_center_all_mean=_ALL),
], {"a": [dot_sql([f"k{i} - {_KMEAN} - {num(_ROW_MEANS[i])} + {num(_ALL)}" for i in range(6)], r) for r in _DUAL.tolist()]}, lets=f"c AS (SELECT *, {_KERNELS} FROM b)")

# 2.3 neighbours

_POINTS = _RNG.normal(size=(20, DIMS)).round(3)
_TARGETS = [float(i % 3) for i in range(20)]
_VALUES = ", ".join(f"({i}, {y}, [{', '.join(map(num, r))}])" for i, (y, r) in enumerate(zip(_TARGETS, _POINTS.tolist())))
_METRICS = {
    "euclidean": f"sqrt({' + '.join(f'({x} - f[{i + 1}]) * ({x} - f[{i + 1}])' for i, x in enumerate(X))})",
    "manhattan": " + ".join(f"abs({x} - f[{i + 1}])" for i, x in enumerate(X)),
    "cosine": f"1 - ({' + '.join(f'{x} * f[{i + 1}]' for i, x in enumerate(X))}) / (sqrt({' + '.join(f'{x} * {x}' for x in X)}) * sqrt({' + '.join(f'f[{i + 1}] * f[{i + 1}]' for i in range(DIMS))}))",
    "minkowski": f"pow({' + '.join(f'pow(abs({x} - f[{i + 1}]), 3)' for i, x in enumerate(X))}, 1.0 / 3)",
}


def _knn(name: str, metric: str, where: str, weight: str, **attrs: object) -> None:
    lets = f"""d AS (SELECT vec_id, y, {_METRICS[metric]} AS dist, i FROM b, (VALUES {_VALUES}) AS t(i, y, f)),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, i) AS rank FROM d),
      w AS (SELECT *, {weight} AS w FROM r WHERE {where}),
      s AS (SELECT vec_id, sum(w) AS total, sum(w * y) AS wy, {', '.join(f'coalesce(sum(w) FILTER (y = {k}), 0) AS w{k}' for k in range(3))} FROM w GROUP BY vec_id),
      c AS (SELECT b.vec_id, coalesce(total, 0) AS total, wy, coalesce(w0, 0) AS w0, coalesce(w1, 0) AS w1, coalesce(w2, 0) AS w2 FROM b LEFT JOIN s USING (vec_id))"""
    if attrs.get("task") == "regression":
        want = {"a": "CASE WHEN total > 0 THEN wy / total ELSE 0 END"}
        outs: str | list[str] = "a"
    else:
        want = {"a": f"CASE WHEN total > 0 THEN {argmax_sql(['w0', 'w1', 'w2'])} ELSE -1 END", "p": [f"CASE WHEN total > 0 THEN w{k} / total ELSE 0 END" for k in range(3)]}
        outs = ["a", "p"]
    query(name, VECTORS, [node("ml.KNN", X, outs, train_features=_POINTS.tolist(), train_targets=_TARGETS, metric=metric, n_classes=3, **attrs)], want, lets=lets)


_knn("ml_knn_uniform", "euclidean", "rank <= 5", "1.0", n_neighbors=5)
_knn("ml_knn_distance", "manhattan", "rank <= 4", "1 / greatest(dist, 1e-12)", n_neighbors=4, weights="distance")
_knn("ml_knn_cosine_regression", "cosine", "rank <= 3", "1 / greatest(dist, 1e-12)", n_neighbors=3, weights="distance", task="regression")
_knn("ml_knn_minkowski", "minkowski", "rank <= 5", "1.0", n_neighbors=5, p=3)
_knn("ml_knn_radius", "euclidean", "dist <= 2.5", "1.0", neighbor_mode="radius", radius=2.5)
_IMPUTE = [[1.0, 10.0], [2.0, None], [30.0, 40.0], [None, 5.0], [45.0, 60.0]]
query("feature_knnimputer", LINES, [node("feature.KNNImputer", ["qm", "n"], "a", train_features=_IMPUTE, n_neighbors=2)], {
    "a": ["coalesce(qm, 1.0)", "n"]})  # the two nearest by n are the rows of 5, which has no quantity, and of 10

# 2.4 text

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = f"translate(text, '{_UP}', '{_LOW}')"
_TOKENS = rf"list_filter(string_split_regex({_LOWER}, '[ \t\n\x0B\f\r]+'), lambda t: t <> '')"
query("text_normalise", TEXTS, [
    node("text.Lowercase", "text", "a"), node("text.Trim", "text", "c"), node("text.NormalizeWhitespace", "text", "k"),
    node("text.StringReplace", "text", "r", old="the", new="THE"), node("text.StringReplace", "text", "o", old="e", new="_", replace_all=False), node("text.RegexReplace", "text", "x", pattern="[0-9]+", replacement="#"),
], {
    "a": f"sha256({_LOWER})", "c": r"sha256(regexp_replace(regexp_replace(text, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', ''))", "k": r"sha256(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))",
    "r": "sha256(replace(text, 'the', 'THE'))", "o": "sha256(regexp_replace(text, 'e', '_'))", "x": "sha256(regexp_replace(text, '[0-9]+', '#', 'g'))",
}, texts=("a", "c", "k", "r", "o", "x"))
query("text_tokenizers", TEXTS, [
    node("text.Tokenizer", "text", "a"), node("text.RegexTokenizer", "text", "c", pattern="[^a-z]+", min_token_length=3), node("text.RegexTokenizer", "text", "k", pattern="[a-z]+", gaps=False),
], {
    "a": f"sha256(array_to_string({_TOKENS}, '|'))", "c": f"sha256(array_to_string(list_filter(string_split_regex({_LOWER}, '[^a-z]+'), lambda t: strlen(t) >= 3), '|'))",
    "k": f"sha256(array_to_string(regexp_extract_all({_LOWER}, '[a-z]+'), '|'))",
}, texts=("a", "c", "k"))
query("text_ngram_stopwords", TEXTS, [
    node("text.Tokenizer", "text", "w"), node("text.NGram", "w", "a", n_min=2, n_max=3), node("text.StopWordsRemover", "w", "c", stop_words=["The", "of"]), node("text.StopWordsRemover", "w", "k", stop_words=["The", "of"], case_sensitive=True),
], {
    "a": "sha256(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), '|'))",
    "c": "sha256(array_to_string(list_filter(w, lambda t: t NOT IN ('the', 'of')), '|'))", "k": "sha256(array_to_string(list_filter(w, lambda t: t <> 'of'), '|'))",
}, texts=("a", "c", "k"), lets=f"c AS (SELECT doc_id, {_TOKENS} AS w FROM b)")
_VOCABULARY = ["the", "of", "and", "la", "der"]
_COUNTS = [f"len(list_filter(w, lambda t: t = '{v}'))" for v in _VOCABULARY]
query("text_count_tfidf", TEXTS, [
    node("text.Tokenizer", "text", "w"), node("text.CountVectorizer", "w", "a", vocabulary=_VOCABULARY), node("text.CountVectorizer", "w", "c", vocabulary=_VOCABULARY, binary=True),
    node("text.TfIdfTransformer", "a", "k", idf=[1.5, 2, 2.5, 3, 3.5]),
], {"a": _COUNTS, "c": [f"least({c}, 1)" for c in _COUNTS], "k": [f"{c} * {1.5 + i / 2}" for i, c in enumerate(_COUNTS)]}, lets=f"c AS (SELECT doc_id, {_TOKENS} AS w FROM b)")
_WIDE = [*_VOCABULARY, *map(str, range(75))]
query("text_count_many", TEXTS, [node("text.Tokenizer", "text", "w"), node("text.CountVectorizer", "w", "a", vocabulary=_WIDE)], {"a": [f"len(list_filter(w, lambda t: t = '{v}'))" for v in _WIDE]}, lets=f"c AS (SELECT doc_id, {_TOKENS} AS w FROM b)")
_VECTORS = [[1.0, 0.5], [0.25, -1.0], [2.0, 0.0], [-0.5, 1.5], [0.75, 0.75]]
_KNOWN = "(" + " + ".join(_COUNTS) + ")"
query("text_word2vec", TEXTS, [node("text.Tokenizer", "text", "w"), node("text.Word2Vec", "w", "a", vocabulary=_VOCABULARY, vectors=_VECTORS)], {
    "a": [f"CASE WHEN {_KNOWN} > 0 THEN ({' + '.join(f'{c} * {num(v[k])}' for c, v in zip(_COUNTS, _VECTORS))}) / {_KNOWN} ELSE 0 END" for k in range(2)]}, lets=f"c AS (SELECT doc_id, {_TOKENS} AS w FROM b)")


def _hash_sql() -> str:
    """Tables up to ``hashed``: each distinct token's murmur3_x86_32 of seed 42, signed; and ``words``: each document's tokens."""
    word = lambda at, n: "('0x' || " + " || ".join(f"substr(x, {at} + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT"
    turn = lambda v, n: f"((({v}) << {n}) | (({v}) >> {32 - n})) & 4294967295"
    mixed = lambda v: f"(({turn(f'(({v}) * 3432918353) & 4294967295', 15)}) * 461845907) & 4294967295"
    step = f"(({turn('xor(h, k)', 13)}) * 5 + 3864292196) & 4294967295"
    tail = "CASE n % 4 " + " ".join(f"WHEN {r} THEN {mixed(word('8 * (n // 4)', r))}" for r in (1, 2, 3)) + " ELSE 0::UBIGINT END"
    return f"""words AS (SELECT doc_id, {_TOKENS} AS w FROM b),
tokens AS (SELECT t, hex(encode(t)) AS x, strlen(t) AS n FROM (SELECT DISTINCT unnest(w) AS t FROM words)),
rounds AS (SELECT t, n, list_reduce([42::UBIGINT] || list_transform(range(n // 4), lambda i: {mixed(word('8 * i', 4))}), lambda h, k: {step}) AS h, {tail} AS e FROM tokens),
ends AS (SELECT t, xor(xor(h, e), n::UBIGINT) AS h FROM rounds),
ends1 AS (SELECT t, (xor(h, h >> 16) * 2246822507) & 4294967295 AS h FROM ends),
ends2 AS (SELECT t, (xor(h, h >> 13) * 3266489909) & 4294967295 AS h FROM ends1),
ends3 AS (SELECT t, xor(h, h >> 16) AS h FROM ends2),
hashed AS (SELECT t, CASE WHEN h >= 2147483648 THEN h::BIGINT - 4294967296 ELSE h::BIGINT END AS h FROM ends3)"""


def _cells_sql(n: int) -> str:
    """Table ``cells``: each document's sums by feature; a negative hash counts down."""
    return f"""{_hash_sql()},
cells AS (SELECT doc_id, ((h % {n}) + {n}) % {n} AS i, sum(CASE WHEN h < 0 THEN -1 ELSE 1 END)::DOUBLE AS x FROM (SELECT doc_id, unnest(w) AS t FROM words) JOIN hashed USING (t) GROUP BY ALL)"""


query("text_hashing", TEXTS, [node("text.Tokenizer", "text", "w"), node("text.HashingVectorizer", "w", "a", num_features=16, alternate_sign=True)], {"a": [f"a{i}" for i in range(16)]}, lets=f"""{_cells_sql(16)},
c AS (SELECT doc_id, {', '.join(f'coalesce(sum(x) FILTER (i = {i}), 0) AS a{i}' for i in range(16))} FROM b LEFT JOIN cells USING (doc_id) GROUP BY doc_id)""")  # fmt: skip
_MANY = 1 << 18
query("text_hashing_wide", TEXTS, [
    node("text.Tokenizer", "text", "w"), node("text.HashingVectorizer", "w", "h", alternate_sign=True), node("text.TfIdfTransformer", "h", "k", idf={"const": "idf"}),
    node("feature.Normalizer", "k", "z", norm="l2"), node("model.Linear", "z", "a", coefficients={"const": "weights"}, intercept=[0.5, -0.25]),
], {"a": ["s0 + 0.5", "s1 - 0.25"]}, constants={"idf": [1 + i % 5 / 4 for i in range(_MANY)], "weights": [[((7 * i + 3 * c) % 11 - 5) / 8 for i in range(_MANY)] for c in range(2)]}, lets=f"""{_cells_sql(_MANY)},
tfs AS (SELECT doc_id, i, x * (1 + (i % 5) / 4) AS x FROM cells),
sums AS (SELECT doc_id, sqrt(sum(x * x)) AS z, {', '.join(f'sum(x * ((7 * i + {3 * c}) % 11 - 5) / 8) AS d{c}' for c in range(2))} FROM tfs GROUP BY doc_id),
c AS (SELECT doc_id, {', '.join(f'coalesce(CASE WHEN z > 1e-12 THEN d{c} / z ELSE d{c} END, 0) AS s{c}' for c in range(2))} FROM b LEFT JOIN sums USING (doc_id))""")  # fmt: skip

for _name in ("text_normalise", "text_tokenizers", "text_ngram_stopwords"):

    def _digest(spark: SparkSession, sf_dir: str, run: Callable = QUERIES[_name]) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select("doc_id", *[F.sha2(F.encode(c, "UTF-8"), 256).alias(c) for c in df.columns if c != "doc_id"])

    QUERIES[_name] = _digest

# 2.5 expressions: every function, a few a query


def expressions(name: str, base: Base, pairs: Mapping[str, tuple[str, str]]) -> None:
    query(f"expr_{name}", base, [node("functions.Compute", [], k, expr=e) for k, (e, _) in pairs.items()], {k: s for k, (_, s) in pairs.items()})


expressions("arithmetic", LINES, {
    "f1": ("add(q, m)", "q + m"), "f2": ("subtract(q, d)", "q - d"), "f3": ("multiply(q, m)", "q * m"), "f4": ("divide(q, v1)", "CASE WHEN v1 <> 0 THEN q / v1 END"), "f5": ("negate(m)", "-m"),
    "f6": ("sub(q, d) + mul(q, t) + div(q, 2) + neg(n)", "q - d + q * t + q / 2 - n"), "f7": ("mod(q, v1)", "CASE WHEN v1 <> 0 THEN q - v1 * floor(q / v1) END"), "f8": ("square(d)", "d * d"),
})
expressions("signs", CUSTOMERS, {
    "f1": ("abs(b)", "abs(b)"), "f2": ("sign(b)", "sign(b)"), "f3": ("mod(b, 7)", "CASE WHEN b < 0 THEN -(-b - 7 * floor(-b / 7)) ELSE b - 7 * floor(b / 7) END"), "f4": ("trunc(b)", "CASE WHEN b < 0 THEN ceil(b) ELSE floor(b) END"),
    "f5": ("floor(b)", "floor(b)"), "f6": ("ceil(b)", "ceil(b)"), "f7": ("round(b)", "CASE WHEN b < 0 THEN -floor(-b + 0.5) ELSE floor(b + 0.5) END"), "f8": ("sign(log(b))", "CASE WHEN b > 0 THEN sign(ln(b)) ELSE 0 END"),
})
expressions("logs", CUSTOMERS, {
    "f1": ("log(b)", "CASE WHEN b > 0 THEN ln(b) END"), "f2": ("log2(b)", "CASE WHEN b > 0 THEN log2(b) END"), "f3": ("log10(b)", "CASE WHEN b > 0 THEN log10(b) END"), "f4": ("log1p(abs(b))", "ln(1 + abs(b))"),
    "f5": ("sqrt(b)", "CASE WHEN b >= 0 THEN sqrt(b) END"), "f6": ("cbrt(b)", "cbrt(b)"), "f7": ("exp(b / 1000)", "exp(b / 1000)"), "f8": ("exp2(b / 1000)", "pow(2, b / 1000)"), "f9": ("pow(abs(b), 0.5)", "sqrt(abs(b))"),
    "f10": ("pow(b, 0.5)", "CASE WHEN b >= 0 THEN sqrt(b) END"),
})
expressions("trigonometry", PARTS, {
    "f1": ("sin(s)", "sin(s)"), "f2": ("cos(s)", "cos(s)"), "f3": ("tan(s / 100)", "tan(s / 100)"), "f4": ("asin(s / 50)", "asin(s / 50)"), "f5": ("acos(s / 25)", "CASE WHEN s <= 25 THEN acos(s / 25) END"),
    "f6": ("atan(s)", "atan(s)"), "f7": ("atan2(s, r)", "atan2(s, r)"),
})
expressions("min_max", LINES, {
    "f1": ("min(q, m)", "CASE WHEN m IS NULL THEN q ELSE least(q, m) END"), "f2": ("min(m, q)", "CASE WHEN m IS NOT NULL THEN least(q, m) END"), "f3": ("max(q, m)", "CASE WHEN m IS NULL THEN q ELSE greatest(q, m) END"),
    "f4": ("max(m, q)", "CASE WHEN m IS NOT NULL THEN greatest(q, m) END"), "f5": ("clamp(qm, 10, 20)", "CASE WHEN qm IS NULL THEN 10 ELSE greatest(10.0, least(qm, 20.0)) END"),
})
expressions("comparisons", LINES, {
    "f1": ("equal(m, 2)", "CASE WHEN m = 2 THEN 1 ELSE 0 END"), "f2": ("not_equal(m, 2)", "CASE WHEN m = 2 THEN 0 ELSE 1 END"), "f3": ("m < 4", "CASE WHEN m < 4 THEN 1 ELSE 0 END"), "f4": ("m <= 4", "CASE WHEN m <= 4 THEN 1 ELSE 0 END"),
    "f5": ("greater_than(m, 4)", "CASE WHEN m > 4 THEN 1 ELSE 0 END"), "f6": ("greater_or_equal(m, 4)", "CASE WHEN m >= 4 THEN 1 ELSE 0 END"), "f7": ("less_than(q, m)", "CASE WHEN q < m THEN 1 ELSE 0 END"),
})
expressions("logic", LINES, {
    "f1": ("v1 and m", "CASE WHEN v1 <> 0 THEN 1 ELSE 0 END"), "f2": ("v1 or v2", "CASE WHEN v1 <> 0 OR v2 <> 0 THEN 1 ELSE 0 END"), "f3": ("not m", "0"), "f4": ("logical_not(v1)", "CASE WHEN v1 = 0 THEN 1 ELSE 0 END"),
    "f5": ("if_(m, q, e)", "q"), "f6": ("if_(v1, q, e)", "CASE WHEN v1 <> 0 THEN q ELSE e END"), "f7": ("is_missing(m)", "CASE WHEN m IS NULL THEN 1 ELSE 0 END"), "f8": ("is_not_missing(m)", "CASE WHEN m IS NULL THEN 0 ELSE 1 END"),
})
expressions("missing", LINES, {
    "f1": ("coalesce(m, qm, d)", "coalesce(m, qm, d)"), "f2": ("fill_missing(m, -5)", "coalesce(m, -5)"), "f3": ("replace_missing(qm, q)", "q"), "f4": ("concat(q, e)", "NULL"), "f5": ("nvl2(q, e, d)", "NULL"), "f6": ("upper(q)", "NULL"),
})
expressions("activations", CUSTOMERS, {
    "f1": ("sigmoid(b / 1000)", sigmoid_sql("b / 1000")), "f2": ("tanh(b / 1000)", "tanh(b / 1000)"), "f3": ("relu(b)", "greatest(b, 0.0)"), "f4": ("softplus(b / 1000)", "ln(1 + exp(b / 1000))"),
    "f5": ("leaky_relu(b)", "CASE WHEN b > 0 THEN b ELSE 0.01 * b END"), "f6": ("leaky_relu(b, 0.2)", "CASE WHEN b > 0 THEN b ELSE 0.2 * b END"), "f7": ("relu(log(b))", "CASE WHEN b > 1 THEN ln(b) ELSE 0 END"),
})

# 2.6 predicates, as one-split trees


def predicates(name: str, base: Base, pairs: Mapping[str, tuple[object, str]]) -> None:
    stump = lambda p: [{"pred": p, "left": 1, "right": 2}, {"leaf": 1.0}, {"leaf": 0.0}]
    query(f"pred_{name}", base, [node("model.Tree", ["m"], k, nodes=stump(p)) for k, (p, _) in pairs.items()], {k: f"CASE WHEN {s} THEN 1 ELSE 0 END" for k, (_, s) in pairs.items()})


_LT, _GE = {"field": "m", "op": "<", "value": 4}, {"field": "q", "op": ">=", "value": 25}
predicates("simple", LINES, {
    "p1": (_LT, "m < 4"), "p2": ({"field": "m", "op": "<=", "value": 4}, "m <= 4"), "p3": ({"field": "m", "op": ">", "value": 4}, "m > 4"), "p4": ({"field": "m", "op": ">=", "value": 4}, "m >= 4"),
    "p5": ({"field": "m", "op": "=", "value": 4}, "m = 4"), "p6": ({"field": "m", "op": "!=", "value": 4}, "m <> 4"), "p7": ({"field": "m", "op": "is_missing"}, "m IS NULL"), "p8": ({"field": "m", "op": "is_not_missing"}, "m IS NOT NULL"),
    "p9": (True, "true"), "p10": ({"field": "m", "op": "=", "value": "x"}, "false"),
})
predicates("sets_compounds", LINES, {
    "p1": ({"field": "m", "op": "in", "values": [1, 2]}, "m IN (1, 2)"), "p2": ({"field": "m", "op": "not_in", "values": [1, 2]}, "m IS NULL OR m NOT IN (1, 2)"), "p3": ({"op": "and", "args": [_LT, _GE]}, "m < 4 AND q >= 25"),
    "p4": ({"op": "or", "args": [_LT, _GE]}, "m < 4 OR q >= 25"), "p5": ({"op": "xor", "args": [_LT, _GE]}, "coalesce(m < 4, false) <> (q >= 25)"), "p6": ({"op": "surrogate", "args": [_LT, _GE]}, "m < 4 OR q >= 25"), "p7": ({"op": "or"}, "false"),
})

# 2.8 policies

query("schema_missing", EVENTS, [node("core.Identity", ["v", "u"], ["a", "c"])], {"a": "coalesce(v, -1)", "c": "CASE WHEN u = 3 THEN -9 ELSE u END"},
      schema=[{"name": "v", "missing": "as_value", "missing_value": -1}, {"name": "u", "missing": "as_value", "missing_values": [3], "missing_value": -9}])
query("schema_discrete", LINES, [node("core.Identity", ["m", "n", "v1", "v2"], ["a", "c", "k", "o"])], {
    "a": "CASE WHEN m IN (1, 2) THEN m END", "c": "CASE WHEN n IN (1, 2) THEN 77 ELSE n END", "k": "v1", "o": "CASE WHEN v2 <> 0 THEN v2 END"},
      schema=[{"name": "m", "valid": [1, 2]}, {"name": "n", "invalid": [1, 2], "on_invalid": "as_value", "invalid_value": 77}, {"name": "v1", "valid": [0], "on_invalid": "as_is"}, {"name": "v2", "invalid": [0], "on_invalid": "as_missing"}])
query("schema_continuous", LINES, [node("core.Identity", ["q", "e", "d"], ["a", "c", "k"])], {
    "a": "greatest(10.0, least(40.0, q))", "c": "CASE WHEN e BETWEEN 5000 AND 50000 THEN e END", "k": "d"},
      schema=[{"name": "q", "intervals": [{"lo": 10, "hi": 40}], "outlier": "as_extreme"}, {"name": "e", "intervals": [{"lo": 5000, "hi": 50000}], "outlier": "as_missing"}, {"name": "d", "intervals": [{"lo": 0, "hi": 0.05, "closure": "co"}]}])

# 2.7 and 2.9 trees


def grow(rng: np.random.Generator, depth: int, cuts: list[tuple[int, list[float]]], width: int = 1, ops: tuple[str, ...] = ("<",)) -> list[dict]:
    """A full tree over features with their possible thresholds."""
    nodes: list[dict] = []

    def build(d: int) -> int:
        at = len(nodes)
        nodes.append({})
        if d == 0:
            v = rng.normal(size=width).tolist()
            nodes[at] = {"leaf": v if width > 1 else v[0]}
        else:
            f, values = cuts[int(rng.integers(len(cuts)))]
            left, right = build(d - 1), build(d - 1)
            nodes[at] = {"feature": f, "op": ops[int(rng.integers(len(ops)))], "threshold": float(values[int(rng.integers(len(values)))]), "left": left, "right": right, "default": ("left", "right")[int(rng.integers(2))]}
            if nodes[at]["op"] in ("in", "not_in"):
                nodes[at]["set"] = sorted({int(v) for v in rng.choice(values, 2)})
        return at

    build(depth)
    return nodes


def tree_sql(nodes: list[dict], cols: list[str], k: int = 0, i: int = 0, missing: str | None = None) -> str:
    n = nodes[i]
    if "leaf" in n:
        v = n["leaf"]
        return num(v[k] if isinstance(v, list) else v)
    c, t, op = cols[n["feature"]], n["threshold"], n.get("op", "<")
    test = {"in": f"trunc({c}) IN ({', '.join(map(str, n.get('set', [0])))})", "not_in": f"trunc({c}) NOT IN ({', '.join(map(str, n.get('set', [0])))})", "is_missing": "false", "==": f"{c} = {t}", "!=": f"{c} <> {t}"}.get(op, f"{c} {op} {num(t)}")
    absent = "true" if (missing or n.get("default", "right")) == "left" or op == "is_missing" else "false"
    return f"CASE WHEN CASE WHEN {c} IS NULL THEN {absent} ELSE {test} END THEN {tree_sql(nodes, cols, k, n['left'], missing)} ELSE {tree_sql(nodes, cols, k, n['right'], missing)} END"


_F = ["qm", "e", "d", "m"]
_CUTS = [(0, [5, 10, 15, 20, 25, 30, 35, 40, 45]), (1, [10000, 20000, 30000, 40000, 50000, 60000, 70000]), (2, [0.01, 0.03, 0.05, 0.07, 0.09]), (3, [1, 2, 4, 5, 6])]
_T = np.random.default_rng(5)
_ALL_OPS = ("<", "<=", ">", ">=", "==", "!=", "in", "not_in", "is_missing")
_STUMPS = [grow(_T, 3, [(0, [5, 10, 25]), (3, [1, 2, 4])], ops=_ALL_OPS) for _ in range(4)]
query("tree_ops", LINES, [node("model.Tree", _F, f"t{i}", nodes=t) for i, t in enumerate(_STUMPS)], {f"t{i}": tree_sql(t, _F) for i, t in enumerate(_STUMPS)})
_TREES = [grow(_T, 4, _CUTS) for _ in range(8)]
_ROW = [tree_sql(t, _F) for t in _TREES]
_LETS = "c AS (SELECT *, " + ", ".join(f"{s} AS t{i}" for i, s in enumerate(_ROW)) + " FROM b)"
_SUM = " + ".join(f"t{i}" for i in range(8))
_WTS = [0.5, 1.0, 1.5, 2.0, 0.25, 0.75, 1.25, 1.0]
_WSUM = " + ".join(f"t{i} * {w}" for i, w in enumerate(_WTS))
for _engine in ("case", "kernel"):
    query(f"forest_aggregations_{_engine}", LINES, [
        node("model.TreeEnsemble", _F, f"a_{a}", trees=_TREES, aggregation=a, base_score=[0.5], tree_weights=_WTS, engine=_engine) for a in ("sum", "average", "weighted_sum", "weighted_average", "soft_vote", "min", "max")
    ], {
        "a_sum": f"0.5 + {_SUM}", "a_average": f"(0.5 + {_SUM}) / 8", "a_weighted_sum": f"0.5 + {_WSUM}", "a_weighted_average": f"(0.5 + {_WSUM}) / {sum(_WTS)}", "a_soft_vote": f"(0.5 + {_SUM}) / 8",
        "a_min": f"least({', '.join(f't{i}' for i in range(8))})", "a_max": f"greatest({', '.join(f't{i}' for i in range(8))})",
    }, lets=_LETS)
_GROUPED = ["t0 + t2 + t4 + t6", "t1 + t3 + t5 + t7"]
query("forest_groups_softmax", LINES, [node("model.TreeEnsemble", _F, ["l", "p"], trees=_TREES, tree_group=[0, 1] * 4, post_transform="softmax")], {"l": argmax_sql([f"({g})" for g in _GROUPED]), "p": softmax_sql([f"({g})" for g in _GROUPED])}, lets=_LETS)
_WIDE = [grow(_T, 3, _CUTS, width=3) for _ in range(4)]
_WIDE_SUMS = ["(" + " + ".join(tree_sql(t, _F, k) for t in _WIDE) + ")" for k in range(3)]
query("forest_vector_leaves", LINES, [node("model.TreeEnsemble", _F, ["l", "p"], trees=_WIDE, aggregation="average")], {"l": argmax_sql(["s0", "s1", "s2"]), "p": ["s0 / 4", "s1 / 4", "s2 / 4"]}, lets=f"c AS (SELECT *, {', '.join(f'{s} AS s{i}' for i, s in enumerate(_WIDE_SUMS))} FROM b)")
_VOTERS = [[{**n, "leaf": float(int(abs(n["leaf"]) * 7) % 3)} if "leaf" in n else n for n in t] for t in _TREES[:5]]
query("forest_majority_vote", LINES, [node("model.TreeEnsemble", _F, ["l", "p"], trees=_VOTERS, aggregation="majority_vote", n_outputs=3)], {
    "l": argmax_sql(["w0", "w1", "w2"]), "p": ["w0 / 5.0", "w1 / 5.0", "w2 / 5.0"]},
      lets=f"v AS (SELECT *, {', '.join(f'{tree_sql(t, _F)} AS t{i}' for i, t in enumerate(_VOTERS))} FROM b), c AS (SELECT *, {', '.join('(' + ' + '.join(f'CAST(t{i} = {k} AS INT)' for i in range(5)) + f') AS w{k}' for k in range(3))} FROM v)")
_POST = {
    "identity": "{}", "sigmoid": "1 / (1 + exp(-({})))", "logit": "1 / (1 + exp(-({})))", "exp": "exp({})", "cloglog": "1 - exp(-exp({}))", "cauchit": "0.5 + atan({}) * 0.318309886", "loglog": "exp(-exp(-({})))",
}
query("forest_post_transforms", LINES, [
    *[node("model.TreeEnsemble", _F, f"p_{k}", trees=_TREES[:2], aggregation="average", post_transform=k) for k in _POST],
    node("model.TreeEnsemble", _F, ["l", "p"], trees=_TREES[:2], post_transform="sigmoid_binary"), node("model.TreeEnsemble", _F, ["l1", "pp"], trees=_TREES[:2], post_transform="sigmoid"),
], {**{f"p_{k}": s.format("(t0 + t1) / 2") for k, s in _POST.items()}, "l": "CASE WHEN t0 + t1 > 0 THEN 1 ELSE 0 END", "p": [f"1 - {sigmoid_sql('t0 + t1')}", sigmoid_sql("t0 + t1")], "l1": f"CASE WHEN {sigmoid_sql('t0 + t1')} >= 0.5 THEN 1 ELSE 0 END", "pp": [f"1 - {sigmoid_sql('t0 + t1')}", sigmoid_sql("t0 + t1")]}, lets=_LETS)
query("forest_probit", LINES, [node("core.Derive", ["d"], "z", expr="d * 10"), node("model.Linear", ["z"], "a", coefficients=[1], post_transform="probit")], {"a": _PROBIT},
      lets="z1 AS (SELECT *, greatest(1e-7, least(1 - 1e-7, d * 10)) AS u FROM b), c AS (SELECT *, sqrt(-2 * ln(least(u, 1 - u))) AS w FROM z1)")

# 2.7 other models

_LIN = [0.05, 0.00002, -8.0]
_LINEAR = dot_sql(["q", "e", "d"], _LIN) + " + (-1.5)"
query("model_linear", LINES, [
    node("model.Linear", ["q", "e", "d"], "a", coefficients=_LIN, intercept=[-1.5]), node("model.Linear", ["q", "e", "d"], "k", coefficients=_LIN, intercept=[-1.5], post_transform="sigmoid"),
    node("model.Linear", ["q", "e", "d"], ["l", "p"], coefficients=_LIN, intercept=[-1.5], post_transform="sigmoid"), node("model.Linear", ["q", "d"], ["l3", "p3"], coefficients=[[0.1, 1], [-0.05, 3], [0.01, -2]], intercept=[0.1, 0.2, 0.3], post_transform="softmax"),
], {
    "a": _LINEAR, "k": [f"1 - {sigmoid_sql(_LINEAR)}", sigmoid_sql(_LINEAR)], "l": f"CASE WHEN {sigmoid_sql(_LINEAR)} > 0.5 THEN 1 ELSE 0 END", "p": [f"1 - {sigmoid_sql(_LINEAR)}", sigmoid_sql(_LINEAR)],
    "l3": argmax_sql(["s0", "s1", "s2"]), "p3": softmax_sql(["s0", "s1", "s2"]),
}, lets="c AS (SELECT *, 0.1 * q + 1 * d + 0.1 AS s0, -0.05 * q + 3 * d + 0.2 AS s1, 0.01 * q - 2 * d + 0.3 AS s2 FROM b)")
_PRIORS = [math.log(0.6), math.log(0.4)]
_MEANS, _VARS = [[20.0, 0.03], [30.0, 0.06]], [[100.0, 0.001], [80.0, 0.002]]


def _bayes(name: str, cols: list[str], logs: list[str], **attrs: object) -> None:
    joint = [f"{s} + {num(p)}" for s, p in zip(logs, _PRIORS)]
    query(f"model_bayes_{name}", LINES, [node("model.NaiveBayes", cols, ["l", "p"], variant=name, class_log_priors=_PRIORS, **attrs)], {"l": argmax_sql(["s0", "s1"]), "p": softmax_sql(["s0", "s1"])},
          lets=f"c AS (SELECT *, {', '.join(f'{s} AS s{i}' for i, s in enumerate(joint))} FROM b)")


_bayes("gaussian", ["q", "d"], [" + ".join(f"-0.5 * (({c} - {num(m)}) * ({c} - {num(m)}) / {num(v + 1e-9)} + {num(math.log(2 * math.pi * (v + 1e-9)))})" for c, m, v in zip(["q", "d"], ms, vs)) for ms, vs in zip(_MEANS, _VARS)], means=_MEANS, variances=_VARS)
_LOGS = [[-0.5, -1.2, -2.0], [-1.0, -0.7, -1.5]]
_bayes("multinomial", ["v1", "v2", "v3"], [dot_sql(["v1", "v2", "v3"], r) for r in _LOGS], feature_log_prob=_LOGS)
_bayes("bernoulli", ["v1", "v2", "v3"], [" + ".join(f"CASE WHEN {c} > 0 THEN {num(p)} ELSE {num(math.log(1 - math.exp(p) + 1e-9))} END" for c, p in zip(["v1", "v2", "v3"], r)) for r in _LOGS], feature_log_prob=_LOGS)
_CATS = [[[-0.1, -2.0, -3.0], [-1.0, -0.5, -2.0]], [[-0.7, -0.8], [-0.2, -1.9]]]
_bayes("categorical", ["v1", "v2"], [" + ".join(f"CASE {c} " + " ".join(f"WHEN {i} THEN {num(p)}" for i, p in enumerate(t[k])) + " ELSE 0.0 END" for c, t in zip(["v1", "v2"], _CATS)) for k in range(2)], feature_log_prob=_CATS)
_CENTRES = [[10.0, 0.02], [25.0, 0.05], [45.0, 0.08]]
_DIST = {
    "squared_euclidean": [f"(q - {a}) * (q - {a}) + (d - {b}) * (d - {b})" for a, b in _CENTRES], "euclidean": [f"sqrt((q - {a}) * (q - {a}) + (d - {b}) * (d - {b}))" for a, b in _CENTRES],
    "manhattan": [f"abs(q - {a}) + abs(d - {b})" for a, b in _CENTRES], "cosine": [f"1 - (q * {a} + d * {b}) / (sqrt((q * q + d * d) * {num(a * a + b * b)}) + 1e-12)" for a, b in _CENTRES],
}
for _kind, _d in _DIST.items():
    _lets = f"c AS (SELECT *, {', '.join(f'{s} AS s{i}' for i, s in enumerate(_d))} FROM b)"
    # equal distances to the last bit differ between engines for the cosine, whose clusters point almost one way
    _want: dict = {"dist": ["s0", "s1", "s2"]} if _kind == "cosine" else {"l": argmax_sql(["-s0", "-s1", "-s2"]), "dist": ["s0", "s1", "s2"]}
    query(f"model_cluster_{_kind}", LINES, [node("model.Clustering", ["q", "d"], ["l", "dist"], centers=_CENTRES, distance=_kind)], _want, lets=_lets)
_MIXW = [0.2, 0.5, 0.3]


def _mixture(kind: str, covariances: list, logs: list[str]) -> None:
    lets = f"c AS (SELECT *, {', '.join(f'{s} + {num(math.log(w + 1e-12))} AS s{i}' for i, (s, w) in enumerate(zip(logs, _MIXW)))} FROM b)"
    query(f"model_mixture_{kind}", LINES, [node("model.Clustering", ["q", "d"], ["l", "p"], variant="gaussian_mixture", covariance_type=kind, means=_CENTRES, covariances=covariances, weights=_MIXW)],
          {"l": argmax_sql(["s0", "s1", "s2"]), "p": softmax_sql(["s0", "s1", "s2"])}, lets=lets)


_L2 = num(2 * 1.8378770664)
_mixture("diag", [[30.0, 0.01], [50.0, 0.02], [40.0, 0.03]], [f"-0.5 * ((q - {a}) * (q - {a}) / {num(u + 1e-9)} + (d - {b}) * (d - {b}) / {num(v + 1e-9)} + {num(math.log(u + 1e-9) + math.log(v + 1e-9))} + {_L2})" for (a, b), (u, v) in zip(_CENTRES, [(30.0, 0.01), (50.0, 0.02), (40.0, 0.03)])])
_mixture("spherical", [[30.0], [50.0], [40.0]], [f"-0.5 * (((q - {a}) * (q - {a}) + (d - {b}) * (d - {b})) / {num(u + 1e-9)} + {num(2 * math.log(u + 1e-9))} + {_L2})" for (a, b), u in zip(_CENTRES, (30.0, 50.0, 40.0))])
_CHOL = [[0.2, 0.1, 0.0, 3.0], [0.15, -0.2, 0.0, 4.0], [0.25, 0.05, 0.0, 2.0]]
_mixture("full", [[c[:2], c[2:]] for c in _CHOL], [f"-0.5 * (({c[0]} * (q - {a})) * ({c[0]} * (q - {a})) + ({c[1]} * (q - {a}) + {c[3]} * (d - {b})) * ({c[1]} * (q - {a}) + {c[3]} * (d - {b})) + {num(-2 * (math.log(c[0] + 1e-12) + math.log(c[3] + 1e-12)))} + {_L2})" for (a, b), c in zip(_CENTRES, _CHOL)])
_SV, _ALPHA = [[10.0, 1.0], [30.0, 2.0], [45.0, 5.0]], [0.5, -1.25, 0.8]


def _kernel_sql(kind: str, gamma: float, coef0: float, degree: int) -> list[str]:
    if kind == "rbf":
        return [f"exp(-{gamma} * ((q - {a}) * (q - {a}) + (n - {b}) * (n - {b})))" for a, b in _SV]
    dots = [f"(q * {a} + n * {b})" for a, b in _SV]
    return dots if kind == "linear" else [f"pow({gamma} * {s} + {coef0}, {degree})" if kind == "poly" else f"tanh({gamma} * {s} + {coef0})" for s in dots]


query("model_svm_linear", LINES, [node("model.SVM", ["q", "n"], ["l", "s"], coefficients=[0.3, -2.0], intercept=[1.0]), node("model.SVM", ["q", "n"], ["l3", "s3"], coefficients=[[0.3, -2.0], [0.1, 1.0]], intercept=[1.0, 0.0])], {
    "l": "CASE WHEN 0.3 * q - 2 * n + 1 >= 0 THEN 1 ELSE 0 END", "s": "0.3 * q - 2 * n + 1", "l3": "CASE WHEN 0.1 * q + n > 0.3 * q - 2 * n + 1 THEN 1 ELSE 0 END", "s3": ["0.3 * q - 2 * n + 1", "0.1 * q + n"]})
for _kind, (_g, _c0, _deg) in {"rbf": (0.01, 0.0, 3), "poly": (0.001, 1.0, 3), "sigmoid": (0.0005, 0.1, 3), "linear": (1.0, 0.0, 3)}.items():
    _raw = dot_sql(_kernel_sql(_kind, _g, _c0, _deg), _ALPHA) + " + 0.1"
    query(f"model_svm_kernel_{_kind}", LINES, [
        node("model.SVM", ["q", "n"], "a", support_vectors=_SV, dual_coefficients=[_ALPHA], intercept=[0.1], kernel=_kind, gamma=_g, coef0=_c0, degree=_deg),
        node("model.SVM", ["q", "n"], ["l", "p"], support_vectors=_SV, dual_coefficients=[_ALPHA], intercept=[0.1], kernel=_kind, gamma=_g, coef0=_c0, degree=_deg, prob_a=[-1.5], prob_b=[0.2]),
    ], {"a": "z", "l": "CASE WHEN z >= 0 THEN 1 ELSE 0 END", "p": ["1 / (1 + exp(-1.5 * -z + 0.2))", "1 - 1 / (1 + exp(-1.5 * -z + 0.2))"]}, lets=f"c AS (SELECT *, {_raw} AS z FROM b)")
_PAIR_SV, _PAIR_DUAL = [[5, 1], [10, 2], [25, 3], [30, 4], [45, 5], [48, 6]], [[1, 0.5, -0.8, -0.7, -0.4, -0.6], [0.6, 0.9, 0.5, 0.5, -0.9, -0.1]]
_PAIRS, _PAIR_B, _PLATT_A, _PLATT_B = [(0, 1), (0, 2), (1, 2)], [0.1, -0.1, 0.05], [-2, -1.5, -1.8], [0.1, 0, -0.1]


def _coupling_sql() -> str:
    """Tables up to ``c``: b with p0, p1, p2, the coupled probabilities of three classes of two support vectors each, round by round."""
    rbf = ", ".join(f"exp(-0.005 * ((q - {x}) * (q - {x}) + (n - {y}) * (n - {y}))) AS k{i}" for i, (x, y) in enumerate(_PAIR_SV))
    own = lambda c, other: " + ".join(f"k{v} * {num(_PAIR_DUAL[other][v])}" for v in (2 * c, 2 * c + 1))
    decision = lambda i, j, w: f"{own(i, j - 1)} + {own(j, i)} + {num(_PAIR_B[w])}"
    sure = ", ".join(f"greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp({num(_PLATT_A[w])} * ({decision(i, j, w)}) + {num(_PLATT_B[w])})))) AS r{i}{j}" for w, (i, j) in enumerate(_PAIRS))
    both = ", ".join(f"1 - r{i}{j} AS r{j}{i}" for i, j in _PAIRS)
    q = lambda i, j: " + ".join(f"r{k}{i} * r{k}{i}" for k in range(3) if k != i) if i == j else f"-r{j}{i} * r{i}{j}"
    cells = [f"q{i}{j}" for i in range(3) for j in range(3)]
    fixed = ", ".join(["q", "n", *cells])
    slopes = ", ".join(f"q{i}0 * p0 + q{i}1 * p1 + q{i}2 * p2 AS s{i}" for i in range(3))
    mean = "(p0 * s0 + p1 * s1 + p2 * s2)"
    inner = f"SELECT *, {slopes} FROM it"
    inner = f"SELECT {fixed}, turn, p0, p1, p2 FROM ({inner}) WHERE turn < 100 AND greatest({', '.join(f'abs(s{i} - {mean})' for i in range(3))}) >= 0.005 / 3"
    for t in range(3):
        moved = ", ".join(f"p{i} + ({mean} - s{t}) / q{t}{t} AS m{i}" if i == t else f"p{i} AS m{i}" for i in range(3))
        scaled = ", ".join(f"greatest(1e-7, m{i} / (m0 + m1 + m2)) AS p{i}" if i == t else f"m{i} / (m0 + m1 + m2) AS p{i}" for i in range(3))
        inner = f"SELECT {fixed}, turn, {scaled} FROM (SELECT {fixed}, turn, {moved} FROM (SELECT *, {slopes} FROM ({inner})))"
    return f"""kv AS (SELECT q, n, {rbf} FROM (SELECT DISTINCT q, n FROM b)),
one AS (SELECT q, n, {sure} FROM kv), two AS (SELECT *, {both} FROM one),
it AS (SELECT q, n, {', '.join(f'{q(i, j)} AS q{i}{j}' for i in range(3) for j in range(3))}, 0 AS turn, 1.0::DOUBLE / 3 AS p0, 1.0::DOUBLE / 3 AS p1, 1.0::DOUBLE / 3 AS p2 FROM two
UNION ALL SELECT {fixed}, turn + 1, p0, p1, p2 FROM ({inner})),
c AS (SELECT b.*, p0, p1, p2 FROM b JOIN (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY q, n ORDER BY turn DESC) = 1) z ON b.q = z.q AND b.n = z.n)"""


query("model_svm_pairwise", LINES, [node("model.SVM", ["q", "n"], ["l", "p"], support_vectors=_PAIR_SV, n_support=[2, 2, 2], dual_coefficients=_PAIR_DUAL, intercept=_PAIR_B, kernel="rbf", gamma=0.005, prob_a=_PLATT_A, prob_b=_PLATT_B)],
      {"l": argmax_sql(["p0", "p1", "p2"]), "p": ["p0", "p1", "p2"]}, lets=_coupling_sql())
ORACLES["model_svm_pairwise"] = ORACLES["model_svm_pairwise"].replace("WITH ", "WITH RECURSIVE ", 1)
_L1, _B1, _OUT, _B2 = [[0.1, -2.0], [-0.05, 3.0], [0.02, 1.0]], [0.1, 0.2, -0.1], [[0.5, -0.25, 1.0], [-0.5, 0.75, 0.25]], [0.05, -0.05]


def _dense(hidden: str) -> list[str]:
    h = [hidden.format(f"({dot_sql(['q', 'd'], r)} + {num(b)})") for r, b in zip(_L1, _B1)]
    return [f"{dot_sql(h, r)} + {num(b)}" for r, b in zip(_OUT, _B2)]


for _act, _h in {"relu": "greatest({}, 0.0)", "tanh": "tanh({})", "logistic": "(1 / (1 + exp(-{})))"}.items():
    query(f"model_network_{_act}", LINES, [node("model.NeuralNetwork", ["q", "d"], ["l", "p"], layers=[{"weights": _L1, "bias": _B1, "activation": _act}, {"weights": _OUT, "bias": _B2, "activation": "softmax"}])], {
        "l": argmax_sql(["s0", "s1"]), "p": softmax_sql(["s0", "s1"])}, lets=f"c AS (SELECT *, {', '.join(f'{s} AS s{i}' for i, s in enumerate(_dense(_h)))} FROM b)")
query("model_network_binary", LINES, [node("model.NeuralNetwork", ["q", "d"], ["l", "p"], layers=[{"weights": [0.1, -30.0], "bias": [-1.0], "activation": "logistic"}])], {
    "l": f"CASE WHEN {sigmoid_sql('0.1 * q - 30 * d - 1')} >= 0.5 THEN 1 ELSE 0 END", "p": [f"1 - {sigmoid_sql('0.1 * q - 30 * d - 1')}", sigmoid_sql("0.1 * q - 30 * d - 1")]})


def _anomaly(name: str, base: Base, cols: list[str], score: str, offset: float, **attrs: object) -> None:
    query(f"model_anomaly_{name}", base, [node("model.AnomalyDetection", cols, ["score", "decision", "y_pred"], variant=name, offset=offset, **attrs)], {
        "score": "z", "decision": f"z - {num(offset)}", "y_pred": f"CASE WHEN z - {num(offset)} >= 0 THEN 1 ELSE -1 END"}, lets=f"c AS (SELECT *, {score} AS z FROM b)")


_PATHS = [[{**n, "leaf": round(abs(n["leaf"]) * 4 + 2, 3)} if "leaf" in n else n for n in t] for t in _TREES[:5]]
_C256 = 2 * (math.log(255) + float(np.euler_gamma)) - 2 * 255 / 256
_anomaly("isolation_forest", LINES, _F, f"-pow(2.0, -({' + '.join(tree_sql([{**n, 'op': '<='} for n in t], _F, missing='right') for t in _PATHS)}) / 5 / {num(_C256)})", -0.5, trees=_PATHS, max_samples=256)
_PREC = [[0.01, 0.2], [0.2, 900.0]]
_anomaly("elliptic_envelope", LINES, ["q", "d"], "-((q - 25) * (0.01 * (q - 25) + 0.2 * (d - 0.05)) + (d - 0.05) * (0.2 * (q - 25) + 900 * (d - 0.05)))", -2.0, location=[25, 0.05], precision=_PREC)
_anomaly("linear_one_class_svm", LINES, ["q", "n"], "0.1 * q - 0.5 * n + 0.25", 0.5, coefficients=[0.1, -0.5], intercept=0.25)
_anomaly("one_class_svm", LINES, ["q", "n"], dot_sql(_kernel_sql("rbf", 0.01, 0.0, 3), _ALPHA) + " + 0.1", 0.0, support_vectors=_SV, dual_coefficients=_ALPHA, intercept=0.1, kernel="rbf", gamma=0.01)
_POINTS = [[float(i * 3 % 50), float(i % 7)] for i in range(60)]
_AWAY = "sqrt((a.x - r.x) * (a.x - r.x) + (a.y - r.y) * (a.y - r.y))"
_FACTOR = f"""r AS (SELECT * FROM (VALUES {', '.join(f'({i}, {num(x)}, {num(y)})' for i, (x, y) in enumerate(_POINTS))}) t(i, x, y)),
rd AS (SELECT a.i AS i, r.i AS j, {_AWAY} AS d FROM r a JOIN r ON a.i <> r.i),
rn AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 4),
kd AS (SELECT i, max(d) AS far FROM rn GROUP BY i),
dens AS (SELECT rn.i AS i, 1 / (avg(greatest(far, d)) + 1e-10) AS p FROM rn JOIN kd ON kd.i = rn.j GROUP BY rn.i),
pts AS (SELECT DISTINCT q AS x, n AS y FROM b),
pd AS (SELECT a.x AS x, a.y AS y, r.i AS j, {_AWAY} AS d FROM pts a CROSS JOIN r),
pn AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY d, j) <= 4),
s AS (SELECT x, y, -avg(p) * (avg(greatest(far, d)) + 1e-10) AS z FROM pn JOIN kd ON kd.i = j JOIN dens ON dens.i = j GROUP BY x, y),
c AS (SELECT b.*, z FROM b JOIN s ON q = x AND n = y)"""
query("model_anomaly_local_outlier_factor", LINES, [node("model.AnomalyDetection", ["q", "n"], ["score", "y_pred"], variant="local_outlier_factor", offset=-1.5, n_neighbors=4, reference_samples=_POINTS)],
      {"score": "z", "y_pred": "CASE WHEN z + 1.5 >= 0 THEN 1 ELSE -1 END"}, lets=_FACTOR)

# Composite and a whole pipeline

query("composite", LINES, [
    {"op": "composite", "bind": {"x": "q", "y": "d"}, "expose": {"r": "a"}, "nodes": [node("core.Sum", ["x", "y"], "s"), node("core.Clip", "s", "r", max=30)]}, node("core.Sum", ["a", "t"], "c"),
], {"a": "least(q + d, 30.0)", "c": "least(q + d, 30.0) + t"})
_PIPE = "0.8 * ((greatest(2.0, least(48.0, q)) - 25) / 14) - 0.4 * ((e - 38000) / 23000) + 0.2 * ((d - 0.05) / 0.03) + CASE flag WHEN 'A' THEN 0.5 WHEN 'N' THEN -0.25 ELSE 0.0 END + 0.1"
PIPELINE = [
    node("feature.StandardScaler", ["q", "e", "d"], "z", mean=[25, 38000, 0.05], scale=[14, 23000, 0.03]), node("feature.OneHotEncoder", "flag", "h", categories=["A", "N", "R"]),
    node("model.Linear", ["z", "h"], ["pred", "prob"], coefficients=[0.8, -0.4, 0.2, 0.5, -0.25, 0.0], intercept=[0.1], post_transform="sigmoid"),
]
_CLIPPED = [{"name": "q", "intervals": [{"lo": 2, "hi": 48}], "outlier": "as_extreme"}]
query("pipeline_linear", LINES, PIPELINE, {"pred": f"CASE WHEN {sigmoid_sql(_PIPE)} > 0.5 THEN 1 ELSE 0 END", "prob": [f"1 - {sigmoid_sql(_PIPE)}", sigmoid_sql(_PIPE)]}, schema=_CLIPPED)
_BIG = np.random.default_rng(11)
BIG_FOREST = [grow(_BIG, 4, _CUTS) for _ in range(100)]
query("pipeline_forest", LINES, [node("feature.Imputer", ["qm"], "qi", fill_value=25), node("model.TreeEnsemble", ["qi", "e", "d", "m"], ["pred", "prob"], trees=BIG_FOREST, aggregation="sum", post_transform="sigmoid")], {
    "pred": f"CASE WHEN {sigmoid_sql('z')} >= 0.5 THEN 1 ELSE 0 END", "prob": [f"1 - {sigmoid_sql('z')}", sigmoid_sql("z")]},
      lets=f"i AS (SELECT * REPLACE (coalesce(qm, 25) AS qm) FROM b), c AS (SELECT *, {' + '.join(tree_sql(t, _F) for t in BIG_FOREST)} AS z FROM i)")
