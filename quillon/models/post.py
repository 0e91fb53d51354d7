"""What models do to their raw scores, on columns and on numpy blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import GraphError

#: The rational approximation of the inverse normal distribution function, and the clamp before it.
PROBIT_TOP = (2.515517, 0.802853, 0.010328)
PROBIT_BOTTOM = (1.0, 1.432788, 0.189269, 0.001308)
PROBIT_EPS = 1e-7
#: A fixed value: 1 / pi, to nine digits.
INVERSE_PI = 0.318309886


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is worked out once a row however often f reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def probit(p: Column) -> Column:
    def tail(t: Column) -> Column:
        top = PROBIT_TOP[0] + t * PROBIT_TOP[1] + t * t * PROBIT_TOP[2]
        bottom = PROBIT_BOTTOM[0] + t * PROBIT_BOTTOM[1] + t * t * PROBIT_BOTTOM[2] + t * t * t * PROBIT_BOTTOM[3]
        return t - top / bottom

    def signed(q: Column) -> Column:
        return let(F.sqrt(-2.0 * F.log(F.least(q, 1 - q))), lambda t: F.when(q < 0.5, -tail(t)).otherwise(tail(t)))

    return let(p, lambda v: F.when(v.isNotNull(), let(F.greatest(F.lit(PROBIT_EPS), F.least(F.lit(1 - PROBIT_EPS), v)), signed)))


def np_probit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, PROBIT_EPS, 1 - PROBIT_EPS)
    t = np.sqrt(-2.0 * np.log(np.minimum(q, 1 - q)))
    x = t - np.polyval(PROBIT_TOP[::-1], t) / np.polyval(PROBIT_BOTTOM[::-1], t)
    return np.where(q < 0.5, -x, x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(cols: list[Column]) -> list[Column]:
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    exps = [F.exp(c - top) for c in cols]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / total for e in exps]


_EACH = {
    "identity": lambda x: x,
    "sigmoid": sigmoid,
    "logit": sigmoid,  # by this name, too, the logistic function
    "exp": F.exp,
    "probit": probit,
    "cloglog": lambda x: 1 - F.exp(-F.exp(x)),
    "cauchit": lambda x: 0.5 + F.atan(x) * INVERSE_PI,
    "loglog": lambda x: F.exp(-F.exp(-x)),
}
NAMES = (*_EACH, "softmax", "sigmoid_binary")


def post_transform(cols: list[Column], kind: str | None) -> list[Column]:
    """sigmoid_binary makes two columns of the first one; the others keep the width."""
    kind = kind or "identity"
    if kind == "softmax":
        return softmax(cols)
    if kind == "sigmoid_binary":
        p = sigmoid(cols[0])
        return [1 - p, p]
    if kind not in _EACH:
        raise GraphError(f"unknown post-transform {kind}")
    return [_EACH[kind](c) for c in cols]


def np_sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))
