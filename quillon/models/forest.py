"""Tree ensembles.

Small ones are CASE expressions. Larger ones are scored by bit vectors: a
tree's leaves are bits, and a node whose condition fails clears those on its
left, so that the first bit left is the leaf reached. Which nodes fail
depends, feature by feature, only on where the value lies among the
thresholds; for each such cell the cleared bits of all trees are combined
beforehand, and a row takes one lookup a feature. Forests whose tables would
be too large are walked level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from copy import copy
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import GraphError
from ..functions.predicates import compile_predicate
from ..functions.values import holds
from ..operators.kernels import kernel
from ..operators.registry import Context, Value, total

#: Ensembles of more trees, or of a tree with more nodes, run as kernels: measured over 600,000 rows, eight trees of depth 4 take 3.5 s as CASE and 0.9 s as a kernel.
CASE_TREES, CASE_NODES = 2, 31
#: Tables of bit vectors may take so many bytes.
TABLE_BYTES = 192 << 20
LEAF = -1
#: Rows and trees that are worked on at once, so that their tables and bits stay in cache.
ROWS_AT_ONCE, TREES_AT_ONCE = 512, 64
_OPS = ("<", "<=", ">", ">=", "==", "!=", "in", "not_in", "is_missing")


@dataclass
class Tree:
    """Nodes by index from the root, 0. A leaf has feature LEAF and a value for each output."""

    feature: list[int]
    op: list[str]
    threshold: list[float]
    members: list[frozenset[int]]
    left: list[int]
    right: list[int]
    missing_left: list[bool]
    pred: list[object]
    value: list[list[float]]

    @classmethod
    def of(cls, nodes: list[Mapping]) -> Tree:
        t = cls([], [], [], [], [], [], [], [], [])
        for n in nodes:
            leaf = "leaf" in n
            op = n.get("op", "<")
            op = {"=": "=="}.get(op, op)
            if not leaf and op not in _OPS:
                raise GraphError(f"unknown split {op}")
            v = n.get("leaf", 0.0)
            t.feature.append(LEAF if leaf else int(n.get("feature", 0)))
            t.op.append(op)
            t.threshold.append(float(n.get("threshold", 0.0)))
            t.members.append(frozenset(int(m) for m in n.get("set", ())))
            t.left.append(int(n.get("left", 0)))
            t.right.append(int(n.get("right", 0)))
            t.missing_left.append(n.get("default", "right") == "left" or op == "is_missing")
            t.pred.append(n.get("pred"))
            t.value.append([float(x) for x in (v if isinstance(v, (list, tuple)) else [v])])
        return t


def goes_left(op: str, threshold: float, members: frozenset[int], x: np.ndarray) -> np.ndarray:
    """Whether numbers x, none missing, meet the condition."""
    if op in ("in", "not_in"):
        return np.isin(np.trunc(x), list(members)) == (op == "in")
    if op == "is_missing":
        return np.zeros(len(x), dtype=bool)
    return {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "==": np.equal, "!=": np.not_equal}[op](x, threshold)


# As CASE expressions


def _condition(t: Tree, i: int, x: list[Column], env: Mapping[str, Column]) -> Column:
    if t.pred[i] is not None:
        return compile_predicate(t.pred[i], env)
    c, op, v = x[t.feature[i]], t.op[i], F.lit(t.threshold[i])
    if op == "is_missing":
        return c.isNull()
    if op in ("in", "not_in"):
        whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
        hit = whole.isin(sorted(t.members[i])) if t.members[i] else F.when(c.isNotNull(), F.lit(False))
        return holds(hit if op == "in" else ~hit, t.missing_left[i])
    test = {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "==": c == v, "!=": c != v}[op]
    return holds(test, t.missing_left[i])


def tree_case(t: Tree, x: list[Column], env: Mapping[str, Column], k: int, i: int = 0) -> Column:
    """Output k of the leaf that a row reaches."""
    if t.feature[i] == LEAF:
        return F.lit(t.value[i][min(k, len(t.value[i]) - 1)])
    return F.when(_condition(t, i, x, env), tree_case(t, x, env, k, t.left[i])).otherwise(tree_case(t, x, env, k, t.right[i]))


# As kernels


class Forest:
    """Leaf numbers, [rows, trees], for matrices with NaN for missing."""

    def __init__(self, trees: list[Tree], n_features: int):
        self.trees, self.n_trees = trees, len(trees)
        self.leaves: list[list[int]] = []
        spans = []
        for t in trees:
            order: list[int] = []
            stack: list[tuple[int, bool]] = [(0, False)]
            begin: dict[int, int] = {}
            middle: dict[int, int] = {}
            while stack:
                i, done = stack.pop()
                if t.feature[i] == LEAF:
                    order.append(i)
                elif not done:
                    begin[i] = len(order)
                    stack += [(t.right[i], False), (i, True), (t.left[i], False)]
                else:
                    middle[i] = len(order)
            self.leaves.append(order)
            spans.append({i: (begin[i], middle[i]) for i in begin})
        self.words = max(1, -(-max(len(o) for o in self.leaves) // 64))
        self.n_features = n_features
        self.cells: list[np.ndarray] = []
        self.sides: list[str] = []
        self.tables: list[np.ndarray] | None = []
        self.parts: list | None = None
        self._build(spans)

    def _build(self, spans: list[dict[int, tuple[int, int]]]) -> None:
        nodes: list[list[tuple[int, int]]] = [[] for _ in range(self.n_features)]
        for k, t in enumerate(self.trees):
            for i in spans[k]:
                if t.feature[i] < self.n_features:
                    nodes[t.feature[i]].append((k, i))
        width = len(self.trees) * self.words
        points = []
        for own in nodes:
            cuts = set()
            for k, i in own:
                t = self.trees[k]
                cuts |= {float(m + d) for m in t.members[i] for d in (-1, 0, 1)} if t.op[i] in ("in", "not_in") else {t.threshold[i]}
            points.append(np.array(sorted(cuts)))
        if sum((2 * len(p) + 2) * width * 8 for p in points) > TABLE_BYTES:
            self.tables = None
            self._flatten()
            return
        for own, cuts in zip(nodes, points):
            # one value of each cell, and one more cell for missing at the end
            ops = {self.trees[k].op[i] for k, i in own}
            side = "right" if ops <= {"<", ">=", "is_missing"} else "left" if ops <= {"<=", ">", "is_missing"} else ""
            below, above = (np.nextafter(cuts[0], -np.inf) - 1, cuts[-1] + 1 + abs(cuts[-1])) if len(cuts) else (0.0, 0.0)
            if side == "right":  # a cut begins its cell
                at = np.concatenate(([below], cuts))
            elif side == "left":  # a cut ends its cell
                at = np.concatenate((cuts, [above]))
            else:  # below, at and between the cuts
                at = np.empty(2 * len(cuts) + 1)
                at[0], at[1::2] = below, cuts
                at[2:-1:2] = (cuts[1:] + cuts[:-1]) / 2
                at[-1] = above
            table = np.full((len(at) + 1, width), ~np.uint64(0), dtype=np.uint64)
            for k, i in own:
                t = self.trees[k]
                fails = np.append(~goes_left(t.op[i], t.threshold[i], t.members[i], at), not t.missing_left[i])
                lo, hi = spans[k][i]
                for word in range(lo // 64, -(-hi // 64)):
                    a, b = max(lo - 64 * word, 0), min(hi - 64 * word, 64)
                    clear = ~np.uint64(((1 << b) - 1) & ~((1 << a) - 1))
                    table[fails, k * self.words + word] &= clear
            self.cells.append(cuts)
            self.sides.append(side)
            self.tables.append(table)

    def _flatten(self) -> None:
        """All trees' nodes one after another, for the walk; leaves lead to themselves."""
        sizes = [len(t.feature) for t in self.trees]
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.root = base
        get = lambda name, dtype: np.concatenate([np.asarray(getattr(t, name), dtype=dtype) for t in self.trees])
        self.flat_feature = get("feature", np.int64)
        self.flat_threshold = get("threshold", float)
        leaf = self.flat_feature == LEAF
        own = np.arange(len(leaf))
        shift = np.repeat(base, sizes)
        self.flat_left = np.where(leaf, own, get("left", np.int64) + shift)
        self.flat_right = np.where(leaf, own, get("right", np.int64) + shift)
        self.flat_missing = get("missing_left", bool)
        self.flat_op = np.concatenate([np.array([_OPS.index(o) for o in t.op]) for t in self.trees])
        self.flat_members = [m for t in self.trees for m in t.members]
        self.flat_feature = np.where(leaf, 0, self.flat_feature)
        place = np.zeros(len(leaf), dtype=np.int64)
        for b, order in zip(base, self.leaves):
            place[b + np.asarray(order)] = np.arange(len(order))
        self.flat_place = place
        self.ops = sorted(set(self.flat_op[~leaf].tolist()))

    def leaf_numbers(self, x: np.ndarray) -> np.ndarray:
        if self.tables is None:
            return self._walk(x)
        out = np.empty((len(x), self.n_trees), dtype=np.int64)
        for rows, trees, leaves in self.blocks(x):
            out[rows, trees] = leaves
        return out

    def sealed(self) -> Forest:
        """The same without what only building needs: workers get tables, not trees."""
        out = copy(self)
        out.trees, out.leaves = [], []
        return out

    def _cells(self, x: np.ndarray) -> list[np.ndarray]:
        cells = []
        for f, (cuts, side) in enumerate(zip(self.cells, self.sides)):
            c = np.ascontiguousarray(x[:, f])
            cell = np.searchsorted(cuts, c, side=side) if side else np.searchsorted(cuts, c, side="left") + np.searchsorted(cuts, c, side="right")
            cell[np.isnan(c)] = len(cuts) * (1 if side else 2) + 1
            cells.append(cell)
        return cells

    def _parts(self) -> list[tuple[slice, list[tuple[int, np.ndarray]]]]:
        """Blocks of trees with the tables of the features that split in them."""
        if self.parts is None:
            step = max(1, TREES_AT_ONCE // self.words)
            used = [f for f in range(self.n_features) if len(self.cells[f]) or f == 0]
            self.parts = []
            for a in range(0, self.n_trees, step):
                b = min(a + step, self.n_trees)
                self.parts.append((slice(a, b), [(f, np.ascontiguousarray(self.tables[f][:, a * self.words : b * self.words])) for f in used]))
        return self.parts

    def blocks(self, x: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """(rows, trees, leaf numbers) of all blocks; the numbers' array is used again."""
        cells = self._cells(x)
        for trees, tables in self._parts():
            k = trees.stop - trees.start
            bits, more = (np.empty((ROWS_AT_ONCE, k * self.words), dtype=np.uint64) for _ in range(2))
            real = np.empty((ROWS_AT_ONCE, k))
            for at in range(0, len(x), ROWS_AT_ONCE):
                rows = slice(at, min(at + ROWS_AT_ONCE, len(x)))
                n = rows.stop - at
                got, other = bits[:n], more[:n]
                for first, (f, table) in enumerate(tables):
                    np.take(table, cells[f][rows], axis=0, out=other if first else got, mode="clip")
                    if first:
                        np.bitwise_and(got, other, out=got)
                place = 0
                if self.words > 1:
                    wide = got.reshape(n, k, self.words)
                    place = (wide != 0).argmax(axis=2)
                    got = np.ascontiguousarray(np.take_along_axis(wide, place[:, :, None], axis=2)[:, :, 0])
                    other = np.empty_like(got)
                np.negative(got, out=other)
                np.bitwise_and(got, other, out=got)
                exponent = real[:n]
                exponent[...] = got.view(np.int64)  # the one bit's place is the number's exponent; the last bit is the sign besides
                leaves = exponent.view(np.int64)
                np.right_shift(leaves, 52, out=leaves)
                np.bitwise_and(leaves, 2047, out=leaves)
                leaves -= 1023
                if self.words > 1:
                    leaves += 64 * place
                yield rows, trees, leaves

    def _walk(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.root, (len(x), self.n_trees)).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            v = x[rows, self.flat_feature[at]]
            if len(self.ops) == 1 and _OPS[self.ops[0]] in ("<", "<=", ">", ">="):
                left = goes_left(_OPS[self.ops[0]], self.flat_threshold[at], frozenset(), v)
            else:
                left = np.zeros(at.shape, dtype=bool)
                for op in self.ops:
                    mine = self.flat_op[at] == op
                    if _OPS[op] in ("in", "not_in"):
                        for node in np.unique(at[mine]).tolist():
                            here = mine & (at == node)
                            left[here] = goes_left(_OPS[op], 0.0, self.flat_members[node], v[here])
                    else:
                        left[mine] = goes_left(_OPS[op], self.flat_threshold[at[mine]], frozenset(), v[mine])
            left = np.where(np.isnan(v), self.flat_missing[at], left)
            after = np.where(left, self.flat_left[at], self.flat_right[at])
            if (after == at).all():
                return self.flat_place[at]
            at = after


_SUMS = ("sum", "average", "weighted_sum", "weighted_average", "soft_vote")
AGGREGATIONS = (*_SUMS, "min", "max", "majority_vote")


@dataclass
class Ensemble:
    """How the trees' leaves make the outputs.

    average divides the base score too; soft_vote scales by outputs over
    trees; min and max leave the base out. majority_vote is a vote: each
    tree's leaf (of one value, a class; of several, its largest) counts one,
    by weight, and outputs are the classes' shares.
    """

    trees: list[Tree]
    aggregation: str
    base: list[float]
    weights: list[float]
    groups: list[int]
    n_outputs: int

    def factor(self) -> float:
        if self.aggregation == "average":
            return 1 / len(self.trees)
        if self.aggregation == "weighted_average":
            return 1 / (sum(self.weights) or 1.0)
        if self.aggregation == "soft_vote":
            return self.n_outputs / len(self.trees)
        return 1.0

    def weight(self, k: int) -> float:
        return self.weights[k] if self.aggregation in ("weighted_sum", "weighted_average", "majority_vote") else 1.0

    def vector(self) -> bool:
        return max(len(v) for t in self.trees for v in t.value) > 1

    def columns(self, x: list[Column], env: Mapping[str, Column]) -> list[Column]:
        wide, out = self.vector(), []
        if self.aggregation == "majority_vote":
            votes = [self._class_case(t, x, env) for t in self.trees]
            sums = [total([F.when(v == c, F.lit(self.weight(k))).otherwise(F.lit(0.0)) for k, v in enumerate(votes)]) for c in range(self.n_outputs)]
            return [s / (sum(map(self.weight, range(len(self.trees)))) or 1.0) for s in sums]
        for o in range(self.n_outputs):
            own = [(k, tree_case(t, x, env, o)) for k, t in enumerate(self.trees) if wide or self.groups[k] == o]
            cols = [c for _, c in own]
            if self.aggregation in ("min", "max"):
                f = F.least if self.aggregation == "min" else F.greatest
                out.append(f(*cols) if len(cols) > 1 else cols[0] if cols else F.lit(self.base[o]))
                continue
            scaled = [c if self.weight(k) == 1 else c * F.lit(self.weight(k)) for k, c in own]
            value = total([F.lit(self.base[o]), *scaled])
            out.append(value if self.factor() == 1 else value * F.lit(self.factor()))
        return out

    def _class_case(self, t: Tree, x: list[Column], env: Mapping[str, Column]) -> Column:
        vote = Tree(t.feature, t.op, t.threshold, t.members, t.left, t.right, t.missing_left, t.pred, [[float(_class(v))] for v in t.value])
        return tree_case(vote, x, env, 0)

    def run(self, forest: Forest):
        """A function of a matrix: the raw outputs."""
        wide = self.vector()
        size = max(len(o) for o in forest.leaves)
        depth = len(self.trees)
        values = np.zeros((depth, size, self.n_outputs))
        for k, (t, order) in enumerate(zip(self.trees, forest.leaves)):
            for n, i in enumerate(order):
                if self.aggregation == "majority_vote":
                    values[k, n, _class(t.value[i])] = self.weight(k)
                elif wide:
                    v = t.value[i]
                    values[k, n] = [v[min(o, len(v) - 1)] * self.weight(k) for o in range(self.n_outputs)]
                else:
                    values[k, n, self.groups[k]] = t.value[i][0] * self.weight(k)
        flat = values.reshape(depth * size, self.n_outputs)
        shift = np.arange(depth) * size
        groups, narrow = np.asarray(self.groups), not wide and self.aggregation != "majority_vote"
        scalar = flat[np.arange(len(flat)), np.repeat(groups, size)] if narrow else None
        members = [np.flatnonzero(groups == o) for o in range(self.n_outputs)]
        votes = sum(map(self.weight, range(depth))) or 1.0
        # all that goes to the workers
        forest, n_outputs, aggregation, base, factor = forest.sealed(), self.n_outputs, self.aggregation, self.base, self.factor()
        adds = narrow and n_outputs == 1 and aggregation in _SUMS and forest.tables is not None

        def sums(x: np.ndarray) -> np.ndarray:
            """One output that adds up: block by block, without a matrix of all leaves."""
            out = np.zeros(len(x))
            held = np.empty((ROWS_AT_ONCE, TREES_AT_ONCE))
            for rows, trees, leaves in forest.blocks(x):
                leaves += shift[trees]
                v = np.take(scalar, leaves, out=held.reshape(-1)[: leaves.size].reshape(leaves.shape), mode="clip")
                out[rows] += v.sum(axis=1)
            return ((out + base[0]) * factor)[:, None]

        def run(x: np.ndarray) -> np.ndarray:
            if adds:
                return sums(x)
            at = forest.leaf_numbers(x) + shift
            out = np.empty((len(x), n_outputs))
            for o in range(n_outputs):
                v = scalar[at[:, members[o]] if n_outputs > 1 else at] if narrow else flat[at, o]
                if aggregation in ("min", "max"):
                    out[:, o] = getattr(v, aggregation)(axis=1) if v.shape[1] else base[o]
                elif aggregation == "majority_vote":
                    out[:, o] = v.sum(axis=1) / votes
                else:
                    out[:, o] = (v.sum(axis=1) + base[o]) * factor
            return out

        return run


def _class(value: list[float]) -> int:
    return int(value[0]) if len(value) == 1 else int(np.argmax(value))


#: Forests that were built last, by the declaration that they were built of: a loaded graph is applied many times.
_BUILT: dict[tuple, tuple[list, Callable, int]] = {}
FORESTS_AT_HAND = 8


def score(ins: list[Value], ctx: Context) -> list[Column]:
    """Raw outputs of the node's trees."""
    x = [c for v in ins for c in v.cols]
    raw = ctx.need("trees")
    key = (id(raw), len(x), *(repr(ctx.get(n)) for n in ("aggregation", "tree_group", "n_outputs", "base_score", "tree_weights", "engine")))
    if key in _BUILT and _BUILT[key][0] is raw:
        return kernel(ctx.spark, _BUILT[key][1], x, _BUILT[key][2])
    trees = [Tree.of(nodes) for nodes in raw]
    if not trees:
        raise GraphError("there are no trees")
    aggregation = str(ctx.get("aggregation", "sum"))
    if aggregation not in AGGREGATIONS:
        raise GraphError(f"unknown aggregation {aggregation}")
    groups = [int(g) for g in ctx.get("tree_group") or [0] * len(trees)]
    width = max(len(v) for t in trees for v in t.value)
    if aggregation == "majority_vote":
        n_out = int(ctx.get("n_outputs") or 1 + max(_class(v) for t in trees for i, v in enumerate(t.value) if t.feature[i] == LEAF))
    else:
        n_out = max(groups) + 1 if ctx.get("tree_group") else width
    base = ctx.numbers("base_score") or [0.0]
    if len(base) not in (1, n_out):
        raise GraphError(f"{len(base)} base scores for {n_out} outputs")
    base = base * n_out if len(base) == 1 else base
    ensemble = Ensemble(trees, aggregation, base, ctx.numbers("tree_weights", len(trees), 1.0), groups, n_out)
    small = len(trees) <= CASE_TREES and max(len(t.feature) for t in trees) <= CASE_NODES
    if ctx.get("engine") == "case" or any(p is not None for t in trees for p in t.pred) or (small and ctx.get("engine") != "kernel"):
        return ensemble.columns(x, ctx.env)
    run = ensemble.run(Forest(trees, len(x)))
    while len(_BUILT) >= FORESTS_AT_HAND:
        _BUILT.pop(next(iter(_BUILT)))
    _BUILT[key] = raw, run, n_out
    return kernel(ctx.spark, run, x, n_out)

