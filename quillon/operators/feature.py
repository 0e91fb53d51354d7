"""Feature operators: scalers, encoders, binners and projections with frozen parameters."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import GraphError
from ..functions.values import flag, holds, missing
from ..models.post import np_probit, probit
from .kernels import kernel, sparse_dot, sparse_map
from .registry import Context, Value, argmax, dot, matrix, operator, sparse, total  # noqa: F401


def _lit(v: float | None) -> Column:
    return missing() if v is None or math.isnan(v) else F.lit(float(v))


#: Up to so many levels or keys are CASE expressions.
LADDER = 32


# Scalers


def _shift_scale(ins: list[Value], ctx: Context, shift: str, scale: str) -> list[Column]:
    x = matrix(ins)
    a, b = ctx.numbers(shift, len(x)), ctx.numbers(scale, len(x))
    out = [c if a is None else c - F.lit(m) for c, m in zip(x, a or x)]
    return [c if b is None or s == 0 else c / F.lit(s) for c, s in zip(out, b or out)]


@operator("feature", "StandardScaler")
def standard_scaler(ins: list[Value], ctx: Context):
    return _shift_scale(ins, ctx, "mean", "scale")


@operator("feature", "RobustScaler")
def robust_scaler(ins: list[Value], ctx: Context):
    return _shift_scale(ins, ctx, "center", "scale")


@operator("feature", "MaxAbsScaler")
def max_abs_scaler(ins: list[Value], ctx: Context):
    return _shift_scale(ins, ctx, "center", "scale")


@operator("feature", "MinMaxScaler")
def min_max_scaler(ins: list[Value], ctx: Context):
    """data_max holds the range, not the maximum; a range of 0 does not divide."""
    lo, hi = float(ctx.get("feature_range_min", 0)), float(ctx.get("feature_range_max", 1))
    return [c * F.lit(hi - lo) + F.lit(lo) for c in _shift_scale(ins, ctx, "data_min", "data_max")]


def _divisors(kind: str, n: int, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The norm of each of a sparse value's rows, or 1."""
    if kind == "max":
        norm = np.zeros(n)
        np.maximum.at(norm, rows, np.abs(x))
    else:
        norm = np.bincount(rows, np.abs(x) if kind == "l1" else x * x, n)
        norm = norm if kind == "l1" else np.sqrt(norm)
    return np.where(norm > 1e-12, norm, 1.0)


@operator("feature", "Normalizer")
def normalizer(ins: list[Value], ctx: Context):
    """By the row's l1, max or else l2 norm; a norm up to 1e-12 leaves the row as it is."""
    if wide := sparse(ins):
        divisors = partial(_divisors, ctx.get("norm", "l2"))
        made = sparse_map(wide, lambda n, rows, at, x: x / divisors(n, rows, x)[rows])
        return replace(made, whole=wide.cols[0], divisors=divisors)
    x, kind = matrix(ins), ctx.get("norm", "l2")
    if kind == "l1":
        norm = total([F.abs(c) for c in x])
    elif kind == "max":
        norm = F.greatest(*[F.abs(c) for c in x]) if len(x) > 1 else F.abs(x[0])
        norm = F.when(total(x).isNotNull(), norm)
    else:
        norm = F.sqrt(total([c * c for c in x]))
    return [F.when(norm > 1e-12, c / norm).otherwise(c) for c in x]


@operator("feature", "PowerTransformer")
def power_transformer(ins: list[Value], ctx: Context):
    x = matrix(ins)
    lambdas = ctx.numbers("lambdas", len(x), 0.0)
    box_cox = ctx.get("method", "yeo_johnson") == "box_cox"

    def one(c: Column, k: float) -> Column:
        if box_cox:
            v = F.greatest(c, F.lit(1e-10))
            y = F.log(v) if abs(k) < 1e-8 else (F.pow(v, F.lit(k)) - 1) / k
        else:
            up = F.log1p(c) if abs(k) < 1e-8 else (F.pow(c + 1, F.lit(k)) - 1) / k
            down = -F.log1p(-c) if abs(k - 2) < 1e-8 else -(F.pow(1 - c, F.lit(2 - k)) - 1) / (2 - k)
            y = F.when(c >= 0, up).otherwise(down)
        return F.when(c.isNotNull(), y)

    out = [one(c, k) for c, k in zip(x, lambdas)]
    mean, scale = ctx.numbers("mean", len(x)), ctx.numbers("scale", len(x))
    if ctx.get("standardize", True) and mean is not None and scale is not None:
        out = [(c - m) / s if s else c - m for c, m, s in zip(out, mean, scale)]
    return out


@operator("feature", "QuantileTransformer")
def quantile_transformer(ins: list[Value], ctx: Context):
    """references holds one row of values for each feature, quantiles the levels. Over LADDER levels are searched by a kernel."""
    x = matrix(ins)
    levels = ctx.numbers("quantiles")
    refs = ctx.get("references")
    if levels is None or refs is None:
        return x
    refs = np.asarray(refs, dtype=float).reshape(-1, len(levels))
    normal, steps = ctx.get("output_distribution") == "normal", np.asarray(levels)

    def run(rows: np.ndarray) -> np.ndarray:
        out = np.empty_like(rows)
        for f in range(rows.shape[1]):
            r, c = refs[min(f, len(refs) - 1)], rows[:, f]
            i = np.clip(np.searchsorted(r, c, side="right") - 1, 0, len(r) - 2)
            y = steps[i] + (c - r[i]) / (r[i + 1] - r[i] + 1e-12) * (steps[i + 1] - steps[i])
            y = np.where(c <= r[0], steps[0], np.where(c >= r[-1], steps[-1], y))
            y = np.where(np.isnan(c), np.nan, np.clip(y, 0.0, 1.0))
            out[:, f] = np_probit(y) if normal else y
        return out

    if len(levels) > LADDER:
        return kernel(ctx.spark, run, x, len(x))

    def one(c: Column, r: list[float]) -> Column:
        y = F.when(c <= r[0], F.lit(levels[0])).when(c >= r[-1], F.lit(levels[-1]))
        for i in range(len(r) - 1):
            slope = (levels[i + 1] - levels[i]) / (r[i + 1] - r[i] + 1e-12)
            y = y.when(c < r[i + 1], F.lit(levels[i]) + (c - r[i]) / F.lit(r[i + 1] - r[i] + 1e-12) * (levels[i + 1] - levels[i]) if slope else F.lit(levels[i]))
        y = F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))
        return probit(y) if normal else y

    return [one(c, refs[min(f, len(refs) - 1)].tolist()) for f, c in enumerate(x)]


@operator("feature", "SplineTransformer")
def spline_transformer(ins: list[Value], ctx: Context):
    """Cox-de Boor bases on the given augmented knots, [knots][features]; zero outside them; feature by feature."""
    x = matrix(ins)
    if ctx.get("knots") is None:
        return x
    knots = np.asarray(ctx.get("knots"), dtype=float).reshape(-1, len(x))
    degree, first = int(ctx.get("degree", 3)), 0 if ctx.get("include_bias", True) else 1

    def bases(c: Column, t: list[float]) -> list[Column]:
        last = len(t) - 2
        d = [flag((c >= t[i]) & ((c < t[i + 1]) | (F.lit(i == last) & (c == t[-1])))) for i in range(len(t) - 1)]
        for p in range(1, degree + 1):
            d = [
                (F.when(c.isNotNull(), (c - t[i]) / (t[i + p] - t[i]) * d[i]).otherwise(0.0) if t[i + p] - t[i] > 1e-10 else F.lit(0.0))
                + (F.when(c.isNotNull(), (t[i + p + 1] - c) / (t[i + p + 1] - t[i + 1]) * d[i + 1]).otherwise(0.0) if t[i + p + 1] - t[i + 1] > 1e-10 else F.lit(0.0))
                for i in range(len(d) - 1)
            ]
        return d

    return [b for f, c in enumerate(x) for b in bases(c, knots[:, f].tolist())[first:]]


@operator("feature", "PolynomialFeatures")
def polynomial_features(ins: list[Value], ctx: Context):
    """Products of powers: of the given rows of exponents, or of all of total degree min_degree to max_degree, in lexicographic order."""
    x = matrix(ins)
    if (powers := ctx.get("powers")) is None:
        lo, hi = int(ctx.get("min_degree", 1)), int(ctx.get("max_degree", 2))
        most = 1 if ctx.get("interaction_only", False) else hi
        powers = [e for e in product(range(most + 1), repeat=len(x)) if lo <= sum(e) <= hi]
        if ctx.get("include_bias", True):
            powers = [(0,) * len(x), *powers]
    out = []
    for row in np.asarray(powers, dtype=int).reshape(-1, len(x)).tolist():
        p = F.lit(1.0)
        for c, e in zip(x, row):
            if e:
                p = p * (c if e == 1 else F.pow(c, F.lit(float(e))))
        out.append(p)
    return out


# Binners


@operator("feature", "Binarizer", "Binarize")
def binarizer(ins: list[Value], ctx: Context):
    """1 if over the threshold, else 0, also for a missing value. Thresholds go by column only with as many outputs as inputs."""
    x = matrix(ins)
    t = ctx.numbers("thresholds") or [float(ctx.get("threshold", 0.0))]
    by_column = len(ins) > 1 and len(ins) == ctx.n_out
    return [flag(c > (t[f] if by_column and f < len(t) else t[0])) for f, c in enumerate(x)]


@operator("feature", "Bucketizer")
def bucketizer(ins: list[Value], ctx: Context):
    """Number of the feature's boundaries at or below the value; 0 for a missing one."""
    x = matrix(ins)
    bounds = ctx.numbers("boundaries")
    if bounds is None:
        raise GraphError("boundaries are required")
    offsets = [int(o) for o in ctx.get("boundary_offsets") or [0, len(bounds)]]

    def own(f: int) -> list[float]:
        return bounds[offsets[f] : offsets[f + 1]] if f + 1 < len(offsets) else bounds[offsets[-2] : offsets[-1]]

    def one(c: Column, b: list[float]) -> Column:
        out = F.lit(0.0)
        for i, v in enumerate(b, 1):
            out = F.when(c >= v, F.lit(float(i))).otherwise(out)
        return out

    return [one(c, own(f)) for f, c in enumerate(x)]


@operator("feature", "Discretizer", "Discretize")
def discretizer(ins: list[Value], ctx: Context):
    """The value of the first bin that holds x; both ends are closed unless left_closed or right_closed say otherwise."""
    left, right, values = ctx.numbers("bin_left"), ctx.numbers("bin_right"), ctx.numbers("bin_values")
    if left is None or right is None or values is None:
        raise GraphError("bin_left, bin_right and bin_values are required")
    closed = [list(ctx.get(n) or []) for n in ("left_closed", "right_closed")]
    default, absent = _lit(ctx.get("default_value")), _lit(ctx.get("map_missing_to"))

    def one(c: Column) -> Column:
        out = F.when(c.isNull(), absent)
        for i, (a, b, v) in enumerate(zip(left, right, values)):
            lc, rc = (bool(k[i]) if i < len(k) else True for k in closed)
            low = F.lit(True) if a is None else (c >= a if lc else c > a)
            high = F.lit(True) if b is None else (c <= b if rc else c < b)
            out = out.when(low & high, _lit(v))
        return out.otherwise(default)

    return [one(c) for c in matrix(ins)]


@operator("feature", "NormContinuous")
def norm_continuous(ins: list[Value], ctx: Context):
    """Piecewise linear between points. Outside: the nearest point's value, or with another outlier_treatment missing, the end points included."""
    x = matrix(ins)
    orig, norm = ctx.numbers("orig_points"), ctx.numbers("norm_points")
    if orig is None or norm is None:
        raise GraphError("orig_points and norm_points are required")
    offsets = [int(o) for o in ctx.get("point_offsets") or [0, len(orig)]]
    clamp = ctx.get("outlier_treatment", "as_extreme_values") == "as_extreme_values"
    absent = _lit(ctx.get("map_missing_to"))

    def one(f: int, c: Column) -> Column:
        a, b = (offsets[f], offsets[f + 1]) if f + 1 < len(offsets) else (offsets[-2], offsets[-1])
        o, n = orig[a:b], norm[a:b]
        if len(o) == 1:
            return F.when(c.isNull(), absent).otherwise(F.lit(n[0]))
        out = F.when(c.isNull(), absent)
        out = out.when(c <= o[0], F.lit(n[0]) if clamp else missing()).when(c >= o[-1], F.lit(n[-1]) if clamp else missing())
        for i in range(len(o) - 1):
            if o[i + 1] > o[i]:
                out = out.when(c <= o[i + 1], F.lit(n[i]) + (c - o[i]) / F.lit(o[i + 1] - o[i]) * (n[i + 1] - n[i]))
        return out

    return [one(f, c) for f, c in enumerate(x)]


@operator("feature", "NormDiscrete")
def norm_discrete(ins: list[Value], ctx: Context):
    v, absent = ctx.need("value"), _lit(ctx.get("map_missing_to"))
    return [F.when(c.isNull(), absent).otherwise(flag(c == (F.lit(v) if isinstance(v, str) else float(v)))) for c in matrix(ins)]


@operator("feature", "MapValues")
def map_values(ins: list[Value], ctx: Context):
    """The value of the first equal key, else default_value; a missing input becomes map_missing_to."""
    keys, values = ctx.numbers("keys"), ctx.numbers("values")
    if keys is None or values is None:
        raise GraphError("keys and values are required")
    table = {}
    for k, v in zip(keys, values):
        table.setdefault(k, v)
    default, absent = _lit(ctx.get("default_value")), _lit(ctx.get("map_missing_to"))

    return [F.when(c.isNull(), absent).otherwise(_lookup(c, list(table), list(table.values()), default)) for c in matrix(ins)]


# Missing values


@operator("feature", "Imputer", "Impute", "SimpleImputer")
def imputer(ins: list[Value], ctx: Context):
    x = matrix(ins)
    fill = ctx.numbers("fill_tensor", len(x), 0.0) if ctx.get("fill_tensor") is not None else [float(ctx.get("fill_value", 0.0))] * len(x)
    return [F.coalesce(c, _lit(v)) for c, v in zip(x, fill)]


@operator("feature", "MissingIndicator")
def missing_indicator(ins: list[Value], ctx: Context):
    x = matrix(ins)
    return [flag(x[int(i)].isNull()) for i in (ctx.get("feature_indices") or range(len(x)))]


# Encoders


def _lookup(c: Column, keys: list, values: list[float | None], default: Column) -> Column:
    """values by keys; a CASE for few keys, else a hash table in a kernel, which Arrow fills once a batch."""
    if not keys:
        return default
    if len(keys) <= LADDER:
        out = None
        for k, v in zip(keys, values):
            hit = c == (F.lit(k) if isinstance(k, str) else F.lit(float(k)))
            out = F.when(hit, _lit(v)) if out is None else out.when(hit, _lit(v))
        return out.otherwise(default)
    text = isinstance(keys[0], str)
    known = pa.array([k if text else float(k) for k in keys], pa.string() if text else pa.float64())
    given = np.array([math.nan if v is None else float(v) for v in values])

    def run(column: pa.Array) -> np.ndarray:
        at = pc.index_in(column, value_set=known, skip_nulls=True)
        there, at = at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy(zero_copy_only=False)
        return np.stack([np.where(there, given[at], np.nan), there], axis=1)

    value, there = kernel(None, run, [c], 2, arrays=True)
    return F.when(there == 1.0, value).otherwise(default)


def _blocks(ctx: Context, name: str, offsets: str, n: int) -> list[list]:
    flat = list(ctx.need(name))
    if flat and isinstance(flat[0], (list, tuple)):
        return [list(b) for b in flat]
    if (o := ctx.get(offsets)) is None:
        size = len(flat) // n if n else 0
        return [flat[f * size : (f + 1) * size] for f in range(n)]
    return [flat[int(a) : int(b)] for a, b in zip(o, o[1:])]


def _is_text(v: Value) -> bool:
    return v.kind == "string"


def _columns(ins: list[Value]) -> list[tuple[Column, bool]]:
    return [(c, _is_text(v)) for v in ins for c in v.cols]


@operator("feature", "OneHotEncoder", "OneHotEncode")
def one_hot_encoder(ins: list[Value], ctx: Context):
    """One column for each category; unknown values have none. A number among string categories is an index."""
    cols = _columns(ins)
    out = []
    for (c, text), cats in zip(cols, _blocks(ctx, "categories", "category_offsets", len(cols))):
        by_index = not text and any(isinstance(k, str) for k in cats)
        hits = [flag(c == (F.lit(float(i)) if by_index else F.lit(k if isinstance(k, str) else float(k)))) for i, k in enumerate(cats)]
        out.append(Value(hits, names=[str(k) for k in cats]))
    if ctx.n_out == len(out) > 1:
        return out
    return Value([c for v in out for c in v.cols])


def _index(c: Column, text: bool, cats: list, codes: list[float], default: Column) -> Column:
    if text:
        return _lookup(c, [str(k) for k in cats], codes, default)
    keys, values, seen = [], [], set()
    for i, k in enumerate(cats):
        try:
            v = float(k)
        except ValueError:
            v = float(i)  # a category that is no number stands at its place
        if v not in seen:
            seen.add(v)
            keys.append(v)
            values.append(codes[i])
    return _lookup(c, keys, values, default)


def _encoded(ins: list[Value], ctx: Context, name: str, offsets: str) -> list[Column]:
    cols = _columns(ins)
    defaults = ctx.numbers("default_values", len(cols)) if ctx.get("default_values") is not None else [None] * len(cols)
    out = []
    at = 0
    given = ctx.numbers("encoded_values")
    for (c, text), cats, d in zip(cols, _blocks(ctx, name, offsets, len(cols)), defaults):
        codes = given[at : at + len(cats)] if given else [float(i) for i in range(len(cats))]
        at += len(cats)
        out.append(_index(c, text, cats, codes, _lit(d)))
    return out


@operator("feature", "OrdinalEncoder")
def ordinal_encoder(ins: list[Value], ctx: Context):
    """Place in the feature's categories, or its encoded value; unknown: default_values, or missing."""
    return _encoded(ins, ctx, "categories", "category_offsets")


@operator("feature", "LabelEncoder", "LabelEncode")
def label_encoder(ins: list[Value], ctx: Context):
    if ctx.get("labels") is None:
        return [missing() if text else c for c, text in _columns(ins)]
    return _encoded(ins, ctx, "labels", "label_offsets")


@operator("feature", "LabelBinarizer")
def label_binarizer(ins: list[Value], ctx: Context):
    neg, pos = F.lit(float(ctx.get("neg_label", 0))), F.lit(float(ctx.get("pos_label", 1)))
    classes = ctx.get("classes")
    if not classes:
        return [F.when(c >= 0.5, pos).otherwise(neg) for c in matrix(ins)]
    (c, text), *_ = _columns(ins)
    return [F.when(c == F.lit(str(k) if text else float(k)), pos).otherwise(neg) for k in classes]


@operator("feature", "MultiLabelBinarizer")
def multi_label_binarizer(ins: list[Value], ctx: Context):
    x = matrix(ins)
    return [flag(_any([holds(c == float(k)) for c in x])) for k in ctx.need("classes")]


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


@operator("feature", "TargetEncoder")
def target_encoder(ins: list[Value], ctx: Context):
    """Category to mean; unknown: default_values, or 0. Without offsets the flat list is split evenly."""
    cols = _columns(ins)
    blocks = _blocks(ctx, "categories", "category_offsets", len(cols))
    values, at, out = ctx.numbers("encoded_values"), 0, []
    defaults = ctx.numbers("default_values", len(cols), 0.0)
    for (c, text), cats, d in zip(cols, blocks, defaults):
        out.append(_index(c, text, cats, values[at : at + len(cats)], _lit(d)))
        at += len(cats)
    return out


# Projections


def project(x: list[Column], components: np.ndarray, mean: list[float] | None = None) -> list[Column]:
    """(x - mean) times each row of components, summed from left to right."""
    centred = x if mean is None else [c - F.lit(m) for c, m in zip(x, mean)]
    return [dot(centred, row.tolist()) for row in components]


def _components(ctx: Context, n: int, name: str = "components") -> np.ndarray:
    return np.asarray(ctx.need(name), dtype=float).reshape(-1, n)


@operator("feature", "TruncatedSVD")
def truncated_svd(ins: list[Value], ctx: Context):
    if wide := sparse(ins):
        return sparse_dot(ctx.spark, wide, _components(ctx, wide.size))
    x = matrix(ins)
    return project(x, _components(ctx, len(x)))


@operator("feature", "PCA")
def pca(ins: list[Value], ctx: Context):
    """Centred, not whitened."""
    x = matrix(ins)
    return project(x, _components(ctx, len(x)), ctx.numbers("mean", len(x)))


@operator("feature", "SparsePCA")
def sparse_pca(ins: list[Value], ctx: Context):
    return pca(ins, ctx)


@operator("feature", "FastICA")
def fast_ica(ins: list[Value], ctx: Context):
    """((x - mean) Wt) Ct; the two matrices are folded into one beforehand."""
    x = matrix(ins)
    if (whitening := ctx.get("whitening")) is None:
        return project(x, _components(ctx, len(x)), ctx.numbers("mean", len(x)))
    w = np.asarray(whitening, dtype=float).reshape(-1, len(x))
    return project(x, _components(ctx, len(w)) @ w, ctx.numbers("mean", len(x)))


@operator("feature", "FactorAnalysis")
def factor_analysis(ins: list[Value], ctx: Context):
    """Posterior means of the factors; a plain projection without noise_variance, or if the matrix is singular."""
    x = matrix(ins)
    c = _components(ctx, len(x))
    if (noise := ctx.numbers("noise_variance", len(x))) is not None:
        w = c / np.asarray(noise)
        try:
            c = np.linalg.inv(np.eye(len(c)) + w @ c.T) @ w
        except np.linalg.LinAlgError:
            pass
    return project(x, c, ctx.numbers("mean", len(x)))


@operator("feature", "NMF")
def nmf(ins: list[Value], ctx: Context):
    """The projection, negative values cut to 0."""
    x = matrix(ins)
    return [F.when(c.isNotNull(), F.greatest(F.lit(0.0), c)) for c in project(x, _components(ctx, len(x)))]


@operator("feature", "LatentDirichletAllocation")
def latent_dirichlet_allocation(ins: list[Value], ctx: Context):
    """Softmax of the projection."""
    from ..models.post import softmax

    x = matrix(ins)
    return softmax(project(x, _components(ctx, len(x))))
