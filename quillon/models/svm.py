"""Support vector machines: linear and kernel, with Platt scaling and pairwise coupling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import flag
from ..operators.kernels import kernel
from ..operators.neighbours import kernel_matrix
from ..operators.registry import Context, Value, argmax, matrix, operator
from .linear import weighed
from .post import post_transform

#: Fixed values of the coupling: the smallest pairwise and class probabilities, and the tolerance over the number of classes.
LEAST, TOLERANCE = 1e-7, 0.005


def platt(f: Column, a: float, b: float) -> Column:
    """1 / (1 + exp(a f + b))."""
    z = f * a + b
    return F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))


def couple(r: np.ndarray) -> np.ndarray:
    """Class probabilities [rows, classes] from pairwise ones [rows, classes, classes], by the second method of Wu, Lin and Weng (2004).

    A round moves each probability in turn to where its own condition holds, given the others, and scales all to one.
    Rows that have converged stand still; the others go on, at most max(100, classes) rounds.
    """
    n, k, _ = r.shape
    back = np.swapaxes(r, 1, 2)
    q = np.where(np.eye(k, dtype=bool), (back**2 * ~np.eye(k, dtype=bool)).sum(axis=2)[:, :, None], -back * r)
    p = np.full((n, k), 1.0 / k)
    live = np.arange(n)
    for _ in range(max(100, k)):
        now = p[live]
        slope = np.einsum("nij,nj->ni", q[live], now)
        going = np.abs(slope - (now * slope).sum(axis=1, keepdims=True)).max(axis=1) >= TOLERANCE / k
        live, now = live[going], now[going]
        if not len(live):
            break
        for t in range(k):
            slope = np.einsum("nij,nj->ni", q[live], now)
            now[:, t] += ((now * slope).sum(axis=1) - slope[:, t]) / q[live, t, t]
            now /= now.sum(axis=1, keepdims=True)
            now[:, t] = np.maximum(now[:, t], LEAST)
        p[live] = now
    return p


class _Decision:
    """Kernel values times the dual coefficients, plus intercepts; with class sizes the coupled pairwise probabilities."""

    def __init__(self, ctx: Context, n: int):
        self.sv = np.asarray(ctx.need("support_vectors"), dtype=float).reshape(-1, n)
        self.dual = np.asarray(ctx.need("dual_coefficients"), dtype=float).reshape(-1, len(self.sv))
        self.kind, self.gamma = ctx.get("kernel", "rbf"), float(ctx.get("gamma", 1 / n))
        self.coef0, self.degree = float(ctx.get("coef0", 0.0)), float(ctx.get("degree", 3))
        self.intercept = np.asarray(ctx.numbers("intercept") or [0.0])
        self.sizes = [int(s) for s in ctx.get("n_support") or []]
        self.a, self.b = (np.asarray(ctx.numbers(k) or []) for k in ("prob_a", "prob_b"))
        self.pairwise = len(self.sizes) > 2 and len(self.a) > 0
        self.width = len(self.sizes) if self.pairwise else len(self.dual)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bad = np.isnan(x).any(axis=1)
        out = self._of(np.where(bad[:, None], 0.0, x))
        out[bad] = np.nan
        return out

    def _of(self, x: np.ndarray) -> np.ndarray:
        k = kernel_matrix(x, self.sv, self.kind, self.gamma, self.coef0, self.degree)
        if not self.pairwise:
            b = np.zeros(len(self.dual))
            b[: len(self.intercept)] = self.intercept[: len(b)]
            return k @ self.dual.T + b
        start = np.concatenate(([0], np.cumsum(self.sizes)))
        classes, pair = len(self.sizes), 0
        r = np.zeros((len(x), classes, classes))
        for i in range(classes):
            for j in range(i + 1, classes):
                a, b = slice(start[i], start[i + 1]), slice(start[j], start[j + 1])
                d = k[:, a] @ self.dual[j - 1, a] + k[:, b] @ self.dual[i, b] + (self.intercept[pair] if pair < len(self.intercept) else 0.0)
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(self.a[pair] * d + self.b[pair])) if pair < len(self.a) else (d > 0).astype(float)
                r[:, i, j] = np.clip(p, LEAST, 1 - LEAST)
                r[:, j, i] = 1 - r[:, i, j]
                pair += 1
        return couple(r)


@operator("model", "SVM")
def svm(ins: list[Value], ctx: Context):
    """Decision values, post-transformed. With two names the class and its scores.

    Of one output the class is 1 from a decision of 0 on; the scores are both
    classes' Platt probabilities where prob_a is given, else the decision. Of
    more outputs, and of pairwise probabilities, the largest wins.
    """
    if ctx.get("support_vectors") is None:
        raw = [c + b for c, b in weighed(ins, ctx)]
    else:
        x = matrix(ins)
        decision = _Decision(ctx, len(x))
        raw = kernel(ctx.spark, decision, x, decision.width)
        if decision.pairwise:
            return [Value([argmax(raw)]), Value(raw)] if ctx.n_out == 2 else raw
    cols = post_transform(raw, ctx.get("post_transform"))
    if ctx.n_out != 2:
        return cols
    if len(cols) > 1:
        return [Value([argmax(cols)]), Value(cols)]
    label = Value([flag(raw[0] >= 0)])
    if a := ctx.numbers("prob_a"):
        p = 1 - platt(-raw[0], a[0], (ctx.numbers("prob_b") or [0.0])[0])
        return [label, Value([1 - p, p])]
    return [label, Value(cols)]
