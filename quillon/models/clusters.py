"""Clusterings: nearest prototype, and Gaussian mixtures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import GraphError
from ..operators.registry import Context, Value, argmax, argmin, dot, matrix, operator, total
from .post import softmax

#: A fixed value: log(2 pi), to eleven digits.
LOG_2PI = 1.8378770664


def _distance(x: list[Column], centre: list[float], kind: str) -> Column:
    diffs = [c - F.lit(v) for c, v in zip(x, centre)]
    if kind == "manhattan":
        return total([F.abs(d) for d in diffs])
    if kind == "cosine":
        norm = F.sqrt(total([c * c for c in x]) * float(sum(v * v for v in centre))) + 1e-12
        return 1 - dot(x, centre) / norm
    square = total([d * d for d in diffs])
    if kind == "squared_euclidean":
        return square
    if kind == "euclidean":
        return F.sqrt(square)
    raise GraphError(f"unknown distance {kind}")


def _log_density(x: list[Column], mean: np.ndarray, shape: np.ndarray, kind: str) -> Column:
    """shape: for full an upper triangular factor of the precision, else variances."""
    d = [c - F.lit(float(m)) for c, m in zip(x, mean)]
    n = len(x)
    if kind == "full":
        factor = shape.reshape(n, n)
        parts = [dot(d[: i + 1], factor[: i + 1, i].tolist()) for i in range(n)]
        spread = total([p * p for p in parts])
        log_det = -2 * sum(math.log(v + 1e-12) for v in np.diag(factor))
    else:
        v = np.broadcast_to(shape.reshape(-1), (n,)) + 1e-9
        spread = total([c * c for c in d]) / float(v[0]) if kind == "spherical" else total([c * c / float(w) for c, w in zip(d, v)])
        log_det = n * math.log(v[0]) if kind == "spherical" else float(np.log(v).sum())
    return (spread + F.lit(log_det) + F.lit(n * LOG_2PI)) * -0.5


@operator("model", "Clustering")
def clustering(ins: list[Value], ctx: Context):
    """The cluster's index (ties: the first), and distances to the centres, or posteriors of the mixture."""
    x = matrix(ins)
    if ctx.get("variant", "prototype") == "prototype":
        centres = np.asarray(ctx.need("centers"), dtype=float).reshape(-1, len(x))
        d = [_distance(x, c.tolist(), ctx.get("distance", "squared_euclidean")) for c in centres]
        return [Value([argmin(d)]), Value(d)]
    means, weights = np.asarray(ctx.need("means"), dtype=float).reshape(-1, len(x)), ctx.numbers("weights") or []
    kind = str(ctx.get("covariance_type", "full"))
    if kind not in ("full", "diag", "spherical"):
        raise GraphError(f"unknown covariance {kind}")
    shapes = np.asarray(ctx.need("covariances"), dtype=float).reshape(len(means), -1)
    logs = [_log_density(x, m, s, kind) + F.lit(math.log(w + 1e-12)) for m, s, w in zip(means, shapes, weights)]
    return [Value([argmax(logs)]), Value(softmax(logs))]
