"""Operators that compare a row with training rows: numpy kernels on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..functions.expressions import GraphError
from .kernels import kernel
from .registry import Context, Value, matrix, operator


def distances(x: np.ndarray, train: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """[rows, training rows]; one training row's differences at a time where no product gives them, in a fixed order of summation."""
    if metric == "cosine":
        dots = x @ train.T
        norms = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((train * train).sum(axis=1))[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - np.where(norms > 0, dots / norms, 0.0)
    out = np.zeros((len(x), len(train)))
    if metric == "chebyshev" or np.isinf(p) and metric == "minkowski":
        for f in range(x.shape[1]):
            np.maximum(out, np.abs(x[:, f, None] - train[None, :, f]), out=out)
        return out
    for f in range(x.shape[1]):
        d = x[:, f, None] - train[None, :, f]
        out += np.abs(d) if metric == "manhattan" else d * d if metric in ("euclidean", "squared_euclidean") else np.abs(d) ** p
    if metric == "euclidean":
        return np.sqrt(out)
    return out ** (1 / p) if metric == "minkowski" else out


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k smallest distances, by distance, then by index."""
    k = min(k, d.shape[1])
    if d.shape[1] > 4 * k:
        edge = np.partition(d, k - 1, axis=1)[:, k - 1, None]
        d = np.where(d <= edge, d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


#: Training rows that are compared at once.
TILE = 1024


def nearest_by(n: int, k: int, distance: Callable[[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distances, indices) of each row's k nearest of n training rows, by distance, then by index; distance(a, b) compares with the rows from a to b."""
    best: tuple[np.ndarray, np.ndarray] | None = None
    for lo in range(0, max(n, 1), TILE):
        d = distance(lo, min(n, lo + TILE))
        at = nearest(d, k)
        found = np.take_along_axis(d, at, axis=1), at + lo
        if best is not None:
            d, at = (np.concatenate(x, axis=1) for x in zip(best, found))
            order = nearest(d, k)
            found = np.take_along_axis(d, order, axis=1), np.take_along_axis(at, order, axis=1)
        best = found
    return best


def _weights(d: np.ndarray, kind: str) -> np.ndarray:
    if kind != "distance":
        return np.ones_like(d)
    return 1 / np.maximum(d, 1e-12)


@operator("ml", "KNN")
def knn(ins: list[Value], ctx: Context):
    """Vote or mean of the nearest training rows, or of all within a radius.

    Ties go to the smaller distance, then to the smaller index; equal votes
    to the lowest class. Without a neighbour a vote gives outlier_label, a
    mean 0. A row with a missing feature has a missing result.
    """
    x = matrix(ins)
    train = np.asarray(ctx.need("train_features"), dtype=float).reshape(-1, len(x))
    targets = np.asarray(ctx.need("train_targets"), dtype=float).reshape(len(train), -1)[:, 0]
    classify = ctx.get("task", "classification") == "classification"
    metric, p, kind = ctx.get("metric", "euclidean"), float(ctx.get("p", 2)), ctx.get("weights", "uniform")
    if metric not in ("euclidean", "manhattan", "cosine", "minkowski", "chebyshev"):
        raise GraphError(f"unknown metric {metric}")
    k, radius = int(ctx.get("n_neighbors", 5)), float(ctx.get("radius", 1.0)) if ctx.get("neighbor_mode", "knn") == "radius" else None
    classes, outlier = int(ctx.get("n_classes", 2)), float(ctx.get("outlier_label", -1))

    def run(rows: np.ndarray) -> np.ndarray:
        bad = np.isnan(rows).any(axis=1)
        plain = np.where(bad[:, None], 0.0, rows)
        # of tiles of training rows, or of the nearest: the weights' sum, and the votes or the weighted sum of targets
        sums, votes = np.zeros(len(rows)), np.zeros((len(rows), classes if classify else 1))

        def count(w: np.ndarray, y: np.ndarray) -> None:
            nonlocal sums
            sums = sums + w.sum(axis=1)
            for c in range(votes.shape[1]):
                votes[:, c] += (np.where(y == c, w, 0.0) if classify else w * y).sum(axis=1)

        if radius is None:
            d, at = nearest_by(len(train), k, lambda a, b: distances(plain, train[a:b], metric, p))
            count(_weights(d, kind), targets[at])
        else:
            for lo in range(0, len(train), TILE):
                d = distances(plain, train[lo : lo + TILE], metric, p)
                count(_weights(d, kind) * (d <= radius), np.broadcast_to(targets[lo : lo + TILE], d.shape))
        out = np.zeros((len(rows), 1 + classes if classify else 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            if classify:
                out[:, 0] = np.where(sums > 0, votes.argmax(axis=1), outlier)
                out[:, 1:] = np.where(sums[:, None] > 0, votes / sums[:, None], 0.0)
            else:
                out[:, 0] = np.where(sums > 0, votes[:, 0] / sums, 0.0)
        out[bad] = np.nan
        return out

    made = kernel(ctx.spark, run, x, 1 + classes if classify else 1)
    return [Value(made[:1]), Value(made[1:] if classify else made[:1])]


@operator("feature", "KNNImputer")
def knn_imputer(ins: list[Value], ctx: Context):
    """Missing values from the nearest training rows, by the distance over the features that both have.

    The n_neighbors nearest of all training rows count, also those that miss
    the feature themselves; they give nothing, and if none gives anything
    the value stays missing.
    """
    x = matrix(ins)
    train = np.asarray([[np.nan if v is None else v for v in row] for row in ctx.need("train_features")], dtype=float).reshape(-1, len(x))
    k, kind = int(ctx.get("n_neighbors", 5)), ctx.get("weights", "uniform")
    there = ~np.isnan(train)

    def run(rows: np.ndarray) -> np.ndarray:
        out = rows.copy()
        todo = np.flatnonzero(np.isnan(rows).any(axis=1))
        if not len(todo) or not len(train):
            return out
        part = rows[todo]
        known = ~np.isnan(part)

        def distance(a: int, b: int) -> np.ndarray:
            total, count = np.zeros((len(todo), b - a)), np.zeros((len(todo), b - a))
            for f in range(rows.shape[1]):
                both = known[:, f, None] & there[None, a:b, f]
                diff = np.where(both, part[:, f, None] - train[None, a:b, f], 0.0)
                total += diff * diff
                count += both
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(count > 0, np.sqrt(total * rows.shape[1] / count), np.inf)

        near, at = nearest_by(len(train), k, distance)
        w = _weights(near, kind) * np.isfinite(near)
        for f in range(rows.shape[1]):
            gives = there[at, f] * w
            values = np.where(there[at, f], train[at, f], 0.0)
            sums = gives.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                fill = np.where(sums > 0, (gives * values).sum(axis=1) / sums, np.nan)
            out[todo, f] = np.where(known[:, f], part[:, f], fill)
        return out

    return kernel(ctx.spark, run, x, len(x))


def kernel_matrix(x: np.ndarray, train: np.ndarray, kind: str, gamma: float, coef0: float, degree: float) -> np.ndarray:
    if kind == "rbf":
        return np.exp(-gamma * distances(x, train, "squared_euclidean"))
    dots = x @ train.T
    if kind == "linear":
        return dots
    if kind in ("poly", "polynomial"):
        return (gamma * dots + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * dots + coef0)
    raise GraphError(f"unknown kernel {kind}")


@operator("feature", "KernelPCA")
def kernel_pca(ins: list[Value], ctx: Context):
    """Kernel values to the fitted samples, centred if their row means are given, times the components."""
    x = matrix(ins)
    if ctx.get("fit_samples") is None or ctx.get("dual_components") is None:
        return x
    train = np.asarray(ctx.get("fit_samples"), dtype=float).reshape(-1, len(x))
    parts = np.asarray(ctx.get("dual_components"), dtype=float).reshape(-1, len(train))
    kind = ctx.get("kernel", "rbf")
    gamma, coef0, degree = float(ctx.get("gamma", 1 / len(x))), float(ctx.get("coef0", 1.0)), float(ctx.get("degree", 3))
    means, every = ctx.numbers("kernel_center_row_mean", len(train), 0.0) if ctx.get("kernel_center_row_mean") is not None else None, float(ctx.get("kernel_center_all_mean", 0.0))

    def run(rows: np.ndarray) -> np.ndarray:
        k = kernel_matrix(rows, train, kind, gamma, coef0, degree)
        if means is not None:
            k = k - k.mean(axis=1, keepdims=True) - np.asarray(means)[None, :] + every
        return k @ parts.T

    return kernel(ctx.spark, run, x, len(parts))
