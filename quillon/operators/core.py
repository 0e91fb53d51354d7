"""Core operators: shape, selection, and votes across the columns of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import BadShape, GraphError, compile_expr
from ..functions.values import flag, holds
from .registry import Context, Value, argmax, matrix, operator, total


@operator("core", "Identity")
def identity(ins: list[Value], ctx: Context):
    return ins


@operator("core", "Concat")
def concat(ins: list[Value], ctx: Context):
    kinds = {v.kind for v in ins}
    return Value(matrix(ins), kinds.pop() if len(kinds) == 1 else "number")


def _picked(cols: list[Column], indices: list) -> list[Column]:
    for i in indices:
        if not 0 <= int(i) < len(cols):
            raise GraphError(f"index {i} of {len(cols)} columns")
    return [cols[int(i)] for i in indices]


@operator("core", "Gather")
def gather(ins: list[Value], ctx: Context):
    """Columns of the first input by index; no indices: all."""
    indices = ctx.get("indices") or range(ins[0].width)
    return Value(_picked(ins[0].cols, indices), ins[0].kind)


@operator("core", "TakeSlots")
def take_slots(ins: list[Value], ctx: Context):
    """Columns of all inputs side by side, by index or by name."""
    cols = matrix(ins)
    if (names := ctx.get("names")) is not None:
        slots = [n for v, own in zip(ins, ctx.in_names) for n in (v.names or [own] * v.width)]
        for n in names:
            if n not in slots:
                raise GraphError(f"no input is named {n}")
        return Value(_picked(cols, [slots.index(n) for n in names]), ins[0].kind)
    return Value(_picked(cols, ctx.need("indices")), ins[0].kind)


@operator("core", "Clip")
def clip(ins: list[Value], ctx: Context):
    lo, hi = ctx.get("min"), ctx.get("max")

    def one(x: Column) -> Column:
        y = x if hi is None else F.least(x, F.lit(float(hi)))
        y = y if lo is None else F.greatest(y, F.lit(float(lo)))
        return F.when(x.isNotNull(), y)

    return [one(x) for x in matrix(ins)]


@operator("core", "ArgMax")
def arg_max(ins: list[Value], ctx: Context):
    return [argmax(matrix(ins))]


@operator("core", "SelectByPrimarySecondaryScore")
def select_by_scores(ins: list[Value], ctx: Context):
    """Index of the best first score; ties go to the best second score, then to the smallest index."""
    if len(ins) < 2 or ins[0].width != ins[1].width:
        raise GraphError("two inputs of the same width are needed")
    # a later candidate replaces the best one only if it is strictly better, which a missing score never is
    state = F.struct(F.lit(0.0).alias("i"), ins[0].cols[0].alias("p"), ins[1].cols[0].alias("s"))
    rest = F.array(*[F.struct(F.lit(float(k)).alias("i"), p.alias("p"), s.alias("s")) for k, (p, s) in enumerate(zip(ins[0].cols, ins[1].cols))])

    def better(best: Column, x: Column) -> Column:
        wins = (x["p"] > best["p"]) | ((x["p"] == best["p"]) & (x["s"] > best["s"]))
        return F.when(holds(wins), x).otherwise(best)

    return [F.aggregate(rest, state, better, lambda b: b["i"])]


@operator("core", "Cast")
def cast(ins: list[Value], ctx: Context):
    """int32 and int64 round half away from zero and stay numbers; float64 keeps; else to the nearest float."""
    to = ctx.get("output_dtype", "float32")
    if to in ("int32", "int64"):
        return [F.round(x) for x in matrix(ins)]
    if to == "float64":
        return matrix(ins)
    return [x.cast("float").cast("double") for x in matrix(ins)]


@operator("core", "Reshape")
def reshape(ins: list[Value], ctx: Context):
    """Within a row; a shape that changes the number of rows is the compiler's, and needs the attribute order."""
    shape = [int(n) for n in ctx.need("new_shape")]
    cols = matrix(ins)
    if shape[-1] not in (-1, len(cols)):
        raise BadShape("this shape changes the number of rows: it needs the attribute order")
    return cols


@operator("core", "Split")
def split(ins: list[Value], ctx: Context):
    """One value for each width in sections; without sections the input goes to the first output."""
    if not (sections := ctx.get("sections")):
        return [ins[0]]
    out, at = [], 0
    for n in map(int, sections):
        out.append(Value(ins[0].cols[at : at + n], ins[0].kind))
        at += n
    return out


def _expr(ctx: Context) -> object:
    """The attribute expr, which may be None: missing."""
    if "expr" not in ctx.attrs:
        raise GraphError("attribute expr is required")
    return ctx.attrs["expr"]


@operator("core", "Derive")
def derive(ins: list[Value], ctx: Context):
    """An expression; if the first input is wide, once for each of its columns under the input's name."""
    expr = _expr(ctx)
    if not ins or ins[0].width == 1:
        return [compile_expr(expr, ctx.env, ctx.functions)]
    return [compile_expr(expr, dict(ctx.env) | {ctx.in_names[0]: c}, ctx.functions) for c in ins[0].cols]


@operator("core", "Select")
def select(ins: list[Value], ctx: Context):
    """The candidate that the first input, truncated and clamped, points to."""
    candidates = ins[1:]
    if not candidates:
        raise GraphError("there is nothing to select from")
    at = F.coalesce(F.least(F.greatest(ins[0].cols[0], F.lit(0.0)), F.lit(float(len(candidates) - 1))).cast("int"), F.lit(0))
    out = []
    for k in range(candidates[0].width):
        got = candidates[0].cols[k]
        for i, v in enumerate(candidates[1:], 1):
            got = F.when(at == i, v.cols[k]).otherwise(got)
        out.append(got)
    return Value(out, candidates[0].kind)


@operator("core", "SparseToDense")
def sparse_to_dense(ins: list[Value], ctx: Context):
    """Values are dense between nodes, but for a sparse value of more features than columns can hold, which is an error here."""
    return matrix(ins)


@operator("core", "DenseToSparse")
def dense_to_sparse(ins: list[Value], ctx: Context):
    """Values stay dense between nodes; plans.to_sparse makes vectors or maps of them at the edge."""
    return matrix(ins)


def _elementwise(ins: list[Value], f) -> list[Column]:
    if len({v.width for v in ins}) != 1:
        raise GraphError("all inputs must have one width")
    return [f(list(row)) for row in zip(*(v.cols for v in ins))]


def _if_all(row: list[Column], value: Column) -> Column:
    known = row[0].isNotNull()
    for c in row[1:]:
        known = known & c.isNotNull()
    return F.when(known, value)


@operator("core", "Sum")
def sum_(ins: list[Value], ctx: Context):
    return _elementwise(ins, total)


@operator("core", "Average")
def average(ins: list[Value], ctx: Context):
    return _elementwise(ins, lambda row: total(row) / len(row))


@operator("core", "Min")
def min_(ins: list[Value], ctx: Context):
    return _elementwise(ins, lambda row: _if_all(row, F.least(*row)) if len(row) > 1 else row[0])


@operator("core", "Max")
def max_(ins: list[Value], ctx: Context):
    return _elementwise(ins, lambda row: _if_all(row, F.greatest(*row)) if len(row) > 1 else row[0])


@operator("core", "Median")
def median(ins: list[Value], ctx: Context):
    """The upper one of an even number."""
    return _elementwise(ins, lambda row: _if_all(row, F.get(F.sort_array(F.array(*row)), F.lit(len(row) // 2))))


@operator("core", "WeightedSum")
def weighted_sum(ins: list[Value], ctx: Context):
    """A single input is multiplied column by column, and not summed."""
    if len(ins) == 1:
        return [x * w for x, w in zip(ins[0].cols, ctx.numbers("weights", ins[0].width, 1.0))]
    w = ctx.numbers("weights", len(ins), 1.0)
    return _elementwise(ins, lambda row: total([c * k for c, k in zip(row, w)]))


@operator("core", "WeightedAverage")
def weighted_average(ins: list[Value], ctx: Context):
    w = ctx.numbers("weights", len(ins), 1.0)
    return _elementwise(ins, lambda row: total([c * k for c, k in zip(row, w)]) / (sum(w) or 1.0))


@operator("core", "WeightedMedian")
def weighted_median(ins: list[Value], ctx: Context):
    """The first value, in order, that brings the weights to half their total."""
    w = ctx.numbers("weights", len(ins), 1.0)

    def one(row: list[Column]) -> Column:
        pairs = F.array_sort(F.array(*[F.struct(c.alias("v"), F.lit(k).alias("w")) for c, k in zip(row, w)]))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))

        def step(s: Column, p: Column) -> Column:
            upto = s["sum"] + p["w"]
            return F.struct(upto.alias("sum"), F.coalesce(s["v"], F.when(upto >= 0.5 * sum(w), p["v"])).alias("v"))

        return _if_all(row, F.aggregate(pairs, start, step, lambda s: s["v"]))

    return _elementwise(ins, one)


def _votes(ins: list[Value], weights: list[float]) -> list[Column]:
    """The label with the most weight; ties go to the smallest. Missing labels don't vote."""
    labels = [F.when(v.cols[0] < 0, F.ceil(v.cols[0])).otherwise(F.floor(v.cols[0])).cast("double") for v in ins]
    tally = [F.struct(total([F.when(holds(a == b), F.lit(w)).otherwise(F.lit(0.0)) for b, w in zip(labels, weights)]).alias("w"), (-a).alias("l")) for a in labels]
    best = F.array_max(F.filter(F.array(*tally), lambda x: x["l"].isNotNull()))
    return [-best["l"]]


@operator("core", "MajorityVote")
def majority_vote(ins: list[Value], ctx: Context):
    return _votes(ins, [1.0] * len(ins))


@operator("core", "WeightedMajorityVote")
def weighted_majority_vote(ins: list[Value], ctx: Context):
    return _votes(ins, ctx.numbers("weights", len(ins), 1.0))


@operator("core", "SoftVote")
def soft_vote(ins: list[Value], ctx: Context):
    """Weighted mean of probabilities, and the class. Several inputs of one column are the classes themselves, each with its weight."""
    w = ctx.numbers("weights", len(ins), 1.0)
    if len(ins) > 1 and ins[0].width == 1:
        sums = [v.cols[0] * k for v, k in zip(ins, w)]
    else:
        sums = [total([v.cols[c] * k for v, k in zip(ins, w)]) for c in range(ins[0].width)]
    if ctx.get("normalize_rows", False):
        row = total(sums)
        probs = [F.when(row > 0, s / row).otherwise(s) for s in sums]
    else:
        probs = [s / (sum(w) or 1.0) for s in sums]
    label = flag(probs[0] >= 0.5) if len(probs) == 1 else argmax(probs)
    return [Value(probs), Value([label])]


@operator("core", "SAMMEVote")
def samme_vote(ins: list[Value], ctx: Context):
    """Softmax of the weighted votes of a boosted ensemble, and the class."""
    w = ctx.numbers("weights", len(ins), 1.0)
    k = int(ctx.get("n_classes", 2))
    rest = float(max(1, k - 1))
    share = [x / (sum(w) or 1.0) for x in w]
    scores = [total([F.when(v.cols[0].cast("int") == c, F.lit(s)).otherwise(F.lit(-s / rest)) for v, s in zip(ins, share)]) / rest for c in range(k)]
    top = F.greatest(*scores) if k > 1 else scores[0]
    exps = [F.exp(s - top) for s in scores]
    probs = [e / total(exps) for e in exps]
    return [Value(probs), Value([argmax(probs)])]


@operator("functions", "Compute")
def compute(ins: list[Value], ctx: Context):
    """An expression over all values, by name."""
    return [compile_expr(_expr(ctx), ctx.env, ctx.functions)]
