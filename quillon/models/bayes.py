"""Naive Bayes models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import GraphError
from ..operators.kernels import sparse_dot
from ..operators.registry import Context, Value, argmax, matrix, operator, sparse, total
from .post import softmax


def _gaussian(x: list[Column], ctx: Context, n: int) -> list[Column]:
    means, variances = (np.asarray(ctx.need(k), dtype=float).reshape(n, -1) for k in ("means", "variances"))
    eps = float(ctx.get("variance_epsilon", 1e-9))

    def one(c: int) -> Column:
        parts = []
        for f, col in enumerate(x):
            v = float(variances[c, f]) + eps
            d = col - F.lit(float(means[c, f]))
            parts.append((d * d / F.lit(v) + F.lit(math.log(2 * math.pi * v))) * -0.5)
        return total(parts)

    return [one(c) for c in range(n)]


def _multinomial(x: list[Column], ctx: Context, n: int) -> list[Column]:
    logs = np.asarray(ctx.need("feature_log_prob"), dtype=float).reshape(n, -1)
    return [total([c * float(p) for c, p in zip(x, logs[k])]) for k in range(n)]


def _bernoulli(x: list[Column], ctx: Context, n: int) -> list[Column]:
    logs = np.asarray(ctx.need("feature_log_prob"), dtype=float).reshape(n, -1)
    at = float(ctx.get("binarize_threshold", 0.0))
    return [total([F.when(c > at, F.lit(float(p))).otherwise(F.lit(math.log(1 - math.exp(p) + 1e-9))) for c, p in zip(x, logs[k])]) for k in range(n)]


def _categorical(x: list[Column], ctx: Context, n: int) -> list[Column]:
    """feature_log_prob: for each feature a matrix of classes by categories; other categories count nothing."""
    tables = [np.asarray(t, dtype=float).reshape(n, -1) for t in ctx.need("feature_log_prob")]

    def one(c: Column, logs: list[float]) -> Column:
        at = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
        out = F.lit(0.0)
        for i, p in enumerate(logs):
            out = F.when(at == i, F.lit(p)).otherwise(out)
        return out

    return [total([one(c, t[k].tolist()) for c, t in zip(x, tables)]) for k in range(n)]


_VARIANTS = {"gaussian": _gaussian, "multinomial": _multinomial, "bernoulli": _bernoulli, "categorical": _categorical}


@operator("model", "NaiveBayes")
def naive_bayes(ins: list[Value], ctx: Context):
    """The class's index, and the classes' probabilities."""
    priors = ctx.numbers("class_log_priors") or []
    variant = str(ctx.get("variant", "gaussian"))
    if variant not in _VARIANTS or not priors:
        raise GraphError("a known variant and class_log_priors are needed")
    if (wide := sparse(ins)) and variant == "multinomial":
        logs = sparse_dot(ctx.spark, wide, np.asarray(ctx.need("feature_log_prob"), dtype=float).reshape(len(priors), -1))
    else:
        logs = _VARIANTS[variant](matrix(ins), ctx, len(priors))
    joint = [a + F.lit(b) for a, b in zip(logs, priors)]
    return [Value([argmax(joint)]), Value(softmax(joint))]
