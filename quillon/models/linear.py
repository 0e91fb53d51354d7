"""Linear models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

from ..operators.kernels import sparse_dot
from ..operators.registry import Context, Value, dot, matrix, operator, sparse
from .post import post_transform
from .trees import classified


def weighed(ins: list[Value], ctx: Context) -> list[tuple[Column, float]]:
    """The inputs, dense or one sparse value, times each row of coefficients; and each row's intercept."""
    wide, given = sparse(ins), np.asarray(ctx.need("coefficients"), dtype=float)
    x = [] if wide else matrix(ins)
    rows = given.reshape(-1, wide.size if wide else len(x))
    made = sparse_dot(ctx.spark, wide, rows) if wide else [dot(x, r.tolist()) for r in rows]
    return list(zip(made, ctx.numbers("intercept", len(rows), 0.0)))


@operator("model", "Linear")
def linear(ins: list[Value], ctx: Context):
    """x times each row of coefficients, plus intercept, post-transformed.

    With two names the class (of one output: over a half) and probabilities;
    with one name, one output and a sigmoid the probabilities of both classes.
    """
    kind = ctx.get("post_transform")
    cols = post_transform([c + b for c, b in weighed(ins, ctx)], kind)
    if ctx.n_out == 1 and len(cols) == 1 and kind == "sigmoid":
        return Value([1 - cols[0], cols[0]])
    return classified(cols, ctx.n_out, lambda p: p > 0.5)
