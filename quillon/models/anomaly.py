"""Anomaly detectors. Higher scores are more normal; the decision is the score less the offset; 1 is normal and -1 is not."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import BadShape, GraphError
from ..operators.kernels import kernel
from ..operators.neighbours import distances, kernel_matrix, nearest_by
from ..operators.registry import Context, Value, dot, matrix, operator, total
from .forest import CASE_NODES, CASE_TREES, Ensemble, Forest, Tree


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + float(np.euler_gamma)) - 2 * (n - 1) / n


def _isolation_forest(x: list[Column], ctx: Context) -> Column:
    """Leaves hold depth plus correction. Splits are ``<=`` whatever they say; a missing value goes right."""
    trees = [Tree.of([n if "leaf" in n else dict(n) | {"op": "<=", "default": "right"} for n in nodes]) for nodes in ctx.need("trees")]
    norm = average_path(float(ctx.get("max_samples", 256)))
    if not trees or norm <= 0:
        return F.lit(0.0)
    mean = Ensemble(trees, "average", [0.0], [1.0] * len(trees), [0] * len(trees), 1)
    if len(trees) <= CASE_TREES and max(len(t.feature) for t in trees) <= CASE_NODES:
        path = mean.columns(x, {})[0]
    else:
        path = kernel(ctx.spark, mean.run(Forest(trees, len(x))), x, 1)[0]
    return -F.pow(F.lit(2.0), -path / norm)


def _elliptic_envelope(x: list[Column], ctx: Context) -> Column:
    n = len(x)
    d = [c - v for c, v in zip(x, ctx.numbers("location", n, 0.0))]
    precision = np.asarray(ctx.get("precision") if ctx.get("precision") is not None else np.eye(n), dtype=float).reshape(n, n)
    return -total([a * dot(d, row.tolist()) for a, row in zip(d, precision)])


class _OneClass:
    def __init__(self, ctx: Context, n: int):
        self.sv = np.asarray(ctx.need("support_vectors"), dtype=float).reshape(-1, n)
        self.dual = np.asarray(ctx.need("dual_coefficients"), dtype=float).reshape(-1)
        self.args = (ctx.get("kernel", "rbf"), float(ctx.get("gamma", 1 / n)), float(ctx.get("coef0", 0.0)), float(ctx.get("degree", 3)))
        self.intercept = float(ctx.get("intercept", 0.0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (kernel_matrix(x, self.sv, *self.args) @ self.dual + self.intercept)[:, None]


class _OutlierFactor:
    """Reference points' k-distances and densities are got once, by blocks."""

    def __init__(self, ctx: Context, n: int):
        self.refs = np.asarray(ctx.need("reference_samples"), dtype=float).reshape(-1, n)
        self.k = int(ctx.get("n_neighbors", 20))
        self.p = float(ctx.get("p", 2))
        self.k_distance = np.zeros(len(self.refs))
        self.density = np.zeros(len(self.refs))
        near, far = [], []
        for at in range(0, len(self.refs), 1024):
            i, d = self._near(self.refs[at : at + 1024], at)
            near.append(i)
            far.append(d)
        if len(self.refs) > 1:
            index, dist = np.concatenate(near), np.concatenate(far)
            self.k_distance = dist[:, -1]
            self.density = self._density(index, dist)

    def _near(self, x: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        metric = {1.0: "manhattan", 2.0: "euclidean"}.get(self.p, "minkowski")
        k = min(self.k, len(self.refs) - (own is not None))

        def distance(a: int, b: int) -> np.ndarray:
            d = distances(x, self.refs[a:b], metric, self.p)
            if own is not None:  # no point is its own neighbour
                mine = own + np.arange(len(x))
                here = np.flatnonzero((mine >= a) & (mine < b))
                d[here, mine[here] - a] = np.inf
            return d

        dist, at = nearest_by(len(self.refs), max(k, 0), distance)
        return at, dist

    def _density(self, index: np.ndarray, dist: np.ndarray) -> np.ndarray:
        return 1 / (np.maximum(self.k_distance[index], dist).mean(axis=1) + 1e-10)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.refs) or self.k <= 0:
            return np.zeros((len(x), 1))
        bad = np.isnan(x).any(axis=1)
        index, dist = self._near(np.where(bad[:, None], 0.0, x))
        out = -(self.density[index].mean(axis=1) / self._density(index, dist))
        return np.where(bad, np.nan, out)[:, None]


def _score(x: list[Column], ctx: Context) -> Column:
    kind = ctx.need("variant")
    if kind == "isolation_forest":
        return _isolation_forest(x, ctx)
    if kind == "elliptic_envelope":
        return _elliptic_envelope(x, ctx)
    if kind == "linear_one_class_svm":
        return dot(x, ctx.numbers("coefficients", len(x), 0.0)) + float(ctx.get("intercept", 0.0))
    if kind == "one_class_svm":
        return kernel(ctx.spark, _OneClass(ctx, len(x)), x, 1)[0]
    if kind == "local_outlier_factor":
        return kernel(ctx.spark, _OutlierFactor(ctx, len(x)), x, 1)[0]
    raise GraphError(f"unknown detector {kind}")


@operator("model", "AnomalyDetection")
def anomaly_detection(ins: list[Value], ctx: Context):
    """One value for each output, by output_roles, or else by what its name holds: decision, pred(iction) or label; else the score."""
    x = matrix(ins)
    if (n := ctx.get("n_features")) is not None and int(n) != len(x):
        raise BadShape(f"{n} features are needed, not {len(x)}")
    score = _score(x, ctx)
    decision = score - F.lit(float(ctx.get("offset", 0.0)))
    made = {"score": score, "decision": decision, "prediction": F.when(decision >= 0, F.lit(1.0)).when(decision < 0, F.lit(-1.0))}

    def role(name: str) -> str:
        low = name.lower()
        return "decision" if "decision" in low else "prediction" if "pred" in low or "label" in low else "score"

    roles = list(ctx.get("output_roles") or [role(n) for n in ctx.out_names])
    return [Value([made[r]]) for r in roles]
