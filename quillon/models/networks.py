"""Dense neural networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.expressions import GraphError
from ..operators.kernels import kernel
from ..operators.registry import Context, Value, dot, matrix, operator
from .post import np_sigmoid, post_transform, sigmoid, softmax
from .trees import classified

#: Networks of up to so many weights are column expressions.
SMALL = 256


def _np_softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_EACH = {
    "identity": (lambda c: c, lambda x: x),
    "logistic": (sigmoid, np_sigmoid),
    "tanh": (F.tanh, np.tanh),
    "relu": (lambda c: F.when(c > 0, c).otherwise(F.lit(0.0)), lambda x: np.where(x > 0, x, 0.0)),
    "softmax": (None, _np_softmax),
}


@operator("model", "NeuralNetwork")
def neural_network(ins: list[Value], ctx: Context):
    """layers: weights [outputs][inputs], bias (or none) and activation each. With two names the class and probabilities. Large networks miss all outputs of a row that misses an input."""
    x, layers = matrix(ins), []
    width = len(x)
    for layer in ctx.need("layers"):
        w = np.asarray(layer["weights"], dtype=float).reshape(-1, width)
        width = len(w)
        b = np.asarray(layer.get("bias") or [0.0] * width, dtype=float)
        name = layer.get("activation", "identity")
        if name not in _EACH:
            raise GraphError(f"unknown activation {name}")
        layers.append((w, b, name))
    if sum(w.size for w, _, _ in layers) <= SMALL and len(layers) == 1:
        w, b, name = layers[0]
        cols = [dot(x, r.tolist()) + float(v) for r, v in zip(w, b)]
        cols = softmax(cols) if name == "softmax" else [_EACH[name][0](c) for c in cols]
    else:
        cols = kernel(ctx.spark, _Network(layers), x, width)
    return classified(post_transform(cols, ctx.get("post_transform")), ctx.n_out, lambda p: p >= 0.5)


class _Network:
    """The layers as a function of a matrix, to be sent to executors."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray, str]]):
        self.layers = layers

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        bad = np.isnan(rows).any(axis=1)
        for w, b, name in self.layers:
            rows = _EACH[name][1](rows @ w.T + b)
        return np.where(bad[:, None], np.nan, rows)
