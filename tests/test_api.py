import json
import os

import numpy as np
import pandas as pd
import pytest

from quillon import Graph, GraphError, ScoringModel
from quillon.plans import reshape_rows, to_sparse
from quillon.sources import read_matrix_csv, read_table, write_scores_csv, write_table
from quillon.streaming import score_stream, start_scoring

from .helpers import node

STUMP = {
    "version": "0.1.0", "inputs": ["x0", "x1"], "outputs": [{"name": "score", "role": "prediction"}],
    "nodes": [node("model.Tree", ["x0", "x1"], ["score"], nodes=[{"feature": 0, "threshold": 0.5, "left": 1, "right": 2}, {"leaf": 2.0}, {"leaf": -2.0}])],
    "verification": [{"inputs": {"x0": [0.0, 1.0], "x1": [0.0, 0.0]}, "outputs": {"score": [2.0, -2.0]}}],
}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_local_data(spark):
    model = ScoringModel(STUMP)
    want = [2.0, -2.0, -2.0]
    rows = [[0, 9], [1, 9], [np.nan, 9]]
    assert model.predict(rows).tolist() == want
    assert model.predict(pd.DataFrame(rows, columns=["x0", "x1"])).tolist() == want
    assert model.predict({"x0": [0, 1, np.nan], "x1": [9, 9, 9]}).tolist() == want
    assert model.predict({"anything": rows}).tolist() == want  # one wide input is dealt out, whatever its name
    assert model.session().bind("x0", [0, 1]).bind("x1", [0, 0]).run().get("score").tolist() == [2.0, -2.0]
    assert model.fit() is model and model.verify() == []
    with pytest.raises(GraphError):
        model.predict([[1, 2, 3]])
    with pytest.raises(GraphError):
        model.predict({"x0": [1.0], "y": [1.0]})


def test_a_wrong_case_is_reported(spark):
    bad = json.loads(json.dumps(STUMP))
    bad["verification"][0]["outputs"]["score"] = [2.0, None]
    assert len(ScoringModel(bad).verify()) == 1


def test_saving(spark, tmp_path):
    path = str(tmp_path / "m.json")
    full = dict(STUMP, functions={"f": {"params": ["a"], "body": "a + 1"}}, schema=[{"name": "x0", "missing": "as_value", "missing_value": 0}], constants={"c": 3})
    ScoringModel(full).save(path)
    again = ScoringModel.load(path)
    assert again.graph.to_dict() == Graph.of(full).to_dict() and again.predict([[np.nan, 1]]).tolist() == [2.0]
    with pytest.raises(GraphError):
        ScoringModel.loads(b"\xff not json")


def test_versions_warn():
    with pytest.warns(UserWarning):
        Graph.of(dict(STUMP, version="0.2.0"))
    with pytest.warns(UserWarning):
        Graph.of(dict(STUMP, version="x"))


def test_bad_graphs(spark):
    for change in ({"outputs": []}, {"inputs": ["x0", "x0"]}, {"outputs": [{"name": "score", "role": "nonsense"}]}, {"inputs": [{"name": "x0", "type": "decimal"}]}, {"nodes": [{"op": "core.Sum", "wrong": 1}]}):
        with pytest.raises(GraphError):
            Graph.of({**STUMP, **change})
    df = spark.createDataFrame([(1.0, 2.0)], "x0 double, x1 double")
    for change in ({"outputs": ["none"]}, {"schema": [{"name": "x9"}]}, {"nodes": [node("core.Sum", ["x0", "x7"], ["score"])]}, {"schema": [{"name": "x0", "missing": "nonsense"}]}):
        with pytest.raises(GraphError):
            ScoringModel({**STUMP, **change}).transform(df)
    with pytest.raises(GraphError):
        ScoringModel(STUMP).transform(df, ["nothing"])


def test_frames(spark):
    model = ScoringModel({
        "version": "0.1.0", "inputs": [{"name": "a", "column": "odd.name `x`"}, {"name": "v", "width": 2}, {"name": "i", "type": "number"}],
        "nodes": [node("core.Sum", ["a", "i"], ["s"]), node("core.WeightedSum", ["v"], ["w"], weights=[{"const": "k"}, 2] if False else [1, 2]), node("core.Concat", ["v", "k"], ["c"])],
        "constants": {"k": 5}, "outputs": ["s", "w", "c", {"name": "odd.name `x`", "value": "a"}],
    })
    df = spark.createDataFrame([(1.5, [1.0, 2.0], 2**40 + 1, "keep", 7)], "`odd.name ``x``` double, v array<double>, i long, extra string, __q0 int")
    got = model.transform(df.drop("__q0")).first()
    assert (got["s"], got["w"], got["c"], got["extra"], got["odd.name `x`"]) == (2**40 + 2.5, [1.0, 4.0], [1.0, 2.0, 5.0], "keep", 1.5)


def test_plans_have_no_shuffle_and_prune_columns(spark):
    from quillon import workload

    for name in ("pipeline_linear", "pipeline_forest", "text_count_tfidf", "model_cluster_euclidean", "ml_knn_uniform"):
        assert exchanges(workload.QUERIES[name](spark, "/root/testdata/sf0.001")) == 0, name
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    model = ScoringModel({"version": "0.1.0", "inputs": [{"name": "q", "column": "l_quantity"}, {"name": "e", "column": "l_extendedprice"}], "nodes": [node("core.Clip", ["q"], ["a"], max=3), node("core.Clip", ["e"], ["b"], max=3)], "outputs": ["a", "b"]})
    plan = model.transform(df).where("l_orderkey > 5").select("a")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan.split("ReadSchema")[1] and "GreaterThan(l_orderkey,5)" in plan


def test_partitioning_does_not_matter(spark):
    from quillon import workload

    base = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    graph = Graph.of({"version": "0.1.0", "inputs": [{"name": "q", "column": "l_quantity"}, {"name": "e", "column": "l_extendedprice"}, {"name": "d", "column": "l_discount"}, {"name": "m", "column": "l_tax"}],
                      "nodes": [node("model.TreeEnsemble", ["q", "e", "d", "m"], ["s"], trees=workload.BIG_FOREST)], "outputs": ["s"]})
    from quillon import apply_graph

    key = ["l_orderkey", "l_linenumber"]
    one = sorted(map(tuple, apply_graph(graph, base.coalesce(1)).select(*key, "s").collect()))
    many = sorted(map(tuple, apply_graph(graph, base.repartition(13)).select(*key, "s").collect()))
    assert one == many


def test_composite_scopes(spark):
    inner = {"op": "composite", "bind": {"x": "x0"}, "expose": {"y": "r"}, "nodes": [node("core.WeightedSum", ["x"], ["y"], weights=[3]), {"op": "composite", "bind": {"z": "y"}, "expose": {"z": "y"}, "nodes": []}]}
    graph = {"version": "0.1.0", "inputs": ["x0"], "nodes": [inner, node("core.Sum", ["r", "x0"], ["s"])], "outputs": ["s"]}
    assert ScoringModel(graph).predict([[2.0]]).tolist() == [8.0]
    leak = dict(graph, nodes=[inner, node("core.Sum", ["y", "x0"], ["s"])])
    with pytest.raises(GraphError):
        ScoringModel(leak).predict([[2.0]])


def test_reshape_rows_and_sparse(spark):
    df = spark.createDataFrame([(i, "g" if i < 3 else "h", [float(2 * i), float(2 * i + 1)]) for i in range(5)], "i long, g string, x array<double>")
    assert {r.row: r.x for r in reshape_rows(df, "x", 4, "i").collect()} == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
    assert {(r.g, r.row): r.x for r in reshape_rows(df, "x", 3, "i", "g").collect()} == {("g", 0): [0, 1, 2], ("g", 1): [3, 4, 5], ("h", 0): [6, 7, 8], ("h", 1): [9]}
    assert reshape_rows(df, "x", 1, "i").count() == 10
    assert df.where("i = 0").select(to_sparse(df["x"]).alias("m")).first()["m"] == {1: 1.0}


def test_error_kinds(spark):
    from quillon.functions import expressions as kinds

    df = spark.createDataFrame([(1.0,)], "x0 double")
    graph = lambda *nodes, out="a": {"version": "0.1.0", "inputs": ["x0"], "outputs": [out], "nodes": list(nodes)}
    cases = [
        (kinds.UnknownOperator, lambda: ScoringModel(graph(node("core.Nothing", ["x0"], ["a"]))).transform(df)),
        (kinds.MissingInput, lambda: ScoringModel(graph(node("core.Identity", ["y"], ["a"]))).transform(df)),
        (kinds.MissingInput, lambda: ScoringModel(STUMP).transform(df)),
        (kinds.MissingAttribute, lambda: ScoringModel(graph(node("model.TreeEnsemble", ["x0"], ["a"]))).transform(df)),
        (kinds.UnknownOutput, lambda: ScoringModel(graph(node("core.Identity", ["x0"], ["a"]))).transform(df, ["b"])),
        (kinds.BadShape, lambda: ScoringModel(STUMP).predict([[1.0, 2.0, 3.0]])),
        (kinds.BadFormat, lambda: ScoringModel.loads("no json")),
    ]
    for kind, call in cases:
        with pytest.raises(kind) as e:
            call()
        assert isinstance(e.value, GraphError) and e.value.kind != GraphError.kind


def test_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("0,1\n0.7,\nx,3\n")
    df = read_matrix_csv(spark, str(tmp_path / "in.csv"), ["x0", "x1"])
    model = ScoringModel(dict(STUMP, outputs=["score", "both"], nodes=[*STUMP["nodes"], node("core.Concat", ["x0", "score"], ["both"])]))
    write_scores_csv(model.transform(df), str(tmp_path / "out"), ["score", "both"])
    lines = [line for f in sorted(os.listdir(tmp_path / "out")) if f.startswith("part") for line in (tmp_path / "out" / f).read_text().splitlines()]
    assert lines[:3] == ["score,both_0,both_1", "2.000000,0.000000,2.000000", "-2.000000,0.700000,-2.000000"]
    some = spark.createDataFrame([(None,), ([1.0, 2.0],)], "both array<double>").coalesce(1)
    with pytest.raises(ValueError):
        write_scores_csv(some, str(tmp_path / "no"), ["both"])
    write_scores_csv(some, str(tmp_path / "null"), ["both"], {"both": 2})
    part = next(f for f in os.listdir(tmp_path / "null") if f.startswith("part"))
    assert [x.replace('""', "") for x in (tmp_path / "null" / part).read_text().splitlines()] == ["both_0,both_1", ",", "1.000000,2.000000"]
    with pytest.raises(Exception, match="not 1 wide"):
        write_scores_csv(some, str(tmp_path / "bad"), ["both"], {"both": 1})
    for kind in ("parquet", "orc", "json"):
        write_table(df, str(tmp_path / kind), kind)
        assert read_table(spark, str(tmp_path / kind), kind).count() == 3
    write_table(df, str(tmp_path / "by"), partition_by=["x1"])
    assert read_table(spark, str(tmp_path / "by")).count() == 3
    with pytest.raises(ValueError):
        read_table(spark, "x", "nothing")


def test_streams(spark, tmp_path):
    model = ScoringModel(STUMP)
    spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "x0 double, x1 double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x0 double, x1 double").parquet(str(tmp_path / "in"))
    assert score_stream(model, stream).isStreaming
    query = start_scoring(model, stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    query.awaitTermination(120)
    assert sorted(r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [-2.0, 2.0]
    with pytest.raises(ValueError):
        score_stream(model, spark.range(1))
