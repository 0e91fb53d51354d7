"""Small graphs on literal rows."""

from __future__ import annotations

from quillon import ScoringModel


def apply(spark, rows, nodes, outputs, types=None, **graph):
    """Each output's values, in order of the rows (a list of dicts)."""
    names = list(rows[0])
    types = types or {}
    kinds = {n: "string" if types.get(n) == "string" else "array<string>" if types.get(n) == "tokens" else "double" for n in names}
    data = [(i, *[r[n] if r[n] is None or kinds[n] != "double" else float(r[n]) for n in names]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "row_ long, " + ", ".join(f"`{n}` {kinds[n]}" for n in names))
    model = ScoringModel({"version": "0.1.0", "inputs": [{"name": n, "type": types.get(n, "number")} for n in names], "nodes": nodes, "outputs": outputs, **graph})
    got = model.transform(df).orderBy("row_").collect()
    return {o: [r[o] for r in got] for o in outputs}


def node(op, inputs, outputs, **attrs):
    return {"op": op, "inputs": inputs, "outputs": outputs, "attrs": attrs}


def wide(*rows):
    """Rows of numbers as columns x0, x1 and so on."""
    return [{f"x{i}": v for i, v in enumerate(r)} for r in rows]


def close(got, want, tol=1e-6):
    if isinstance(want, (list, tuple)):
        assert len(got) == len(want), (got, want)
        for g, w in zip(got, want):
            close(g, w, tol)
    elif want is None or isinstance(want, (str, bool)):
        assert got == want, (got, want)
    else:
        assert got is not None and abs(got - want) <= tol + tol * abs(want), (got, want)
