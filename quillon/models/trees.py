"""Tree and TreeEnsemble nodes."""

from __future__ import annotations

from ..functions.values import flag
from ..operators.registry import Context, Value, argmax, operator
from .forest import score
from .post import post_transform


def classified(cols: list, n_out: int, positive) -> list[Value] | list:
    """With two output names: class and probabilities; positive tells the class of a single output."""
    if n_out != 2:
        return cols
    if len(cols) == 1:
        return [Value([flag(positive(cols[0]))]), Value([1 - cols[0], cols[0]])]
    return [Value([argmax(cols)]), Value(cols)]


@operator("model", "TreeEnsemble")
def tree_ensemble(ins: list[Value], ctx: Context):
    """Post-transformed outputs; with two names the class (of one output: at least a half) and the probabilities."""
    cols = post_transform(score(ins, ctx), ctx.get("post_transform"))
    return classified(cols, ctx.n_out, lambda p: p >= 0.5)


@operator("model", "Tree")
def tree(ins: list[Value], ctx: Context):
    """A single tree, given as nodes."""
    ctx.attrs = dict(ctx.attrs) | {"trees": [ctx.need("nodes")]}
    return tree_ensemble(ins, ctx)
