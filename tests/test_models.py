import math

import numpy as np
import pytest

from quillon import GraphError
from quillon.models.forest import Ensemble, Forest, Tree
from quillon.models.svm import couple
from quillon.workload import grow

from .helpers import apply, close, node, wide

N = None


def stump(f, t, left, right, **more):
    return [{"feature": f, "threshold": t, "left": 1, "right": 2, **more}, {"leaf": left}, {"leaf": right}]


def walk(tree, row, i=0):
    n = tree[i]
    while "leaf" not in n:
        x, op, t = row[n["feature"]], n.get("op", "<"), n.get("threshold", 0)
        if x is None or math.isnan(x):
            left = n.get("default", "right") == "left" or op == "is_missing"
        elif op in ("in", "not_in"):
            left = (math.trunc(x) in n["set"]) == (op == "in")
        else:
            left = {"<": x < t, "<=": x <= t, ">": x > t, ">=": x >= t, "==": x == t, "!=": x != t, "is_missing": False}[op]
        n = tree[n["left"] if left else n["right"]]
    return n["leaf"]


def test_stumps(spark):
    trees = [stump(0, 0.5, 1, -1), stump(1, 0.5, 2, -2), stump(0, 0, 0.5, -0.5)]
    for engine in ("case", "kernel"):
        got = apply(spark, wide((0, 0), (0, 1), (1, 0), (1, 1), (N, 0)), [
            node("model.TreeEnsemble", ["x0", "x1"], ["a"], trees=trees, engine=engine), node("model.TreeEnsemble", ["x0", "x1"], ["b"], trees=trees, aggregation="average", base_score=[3], engine=engine),
            node("model.Tree", ["x0"], ["c"], nodes=stump(0, 0.5, 5, -5, default="left")), node("model.TreeEnsemble", ["x0", "x1"], ["l", "p"], trees=trees, post_transform="sigmoid", engine=engine),
        ], ["a", "b", "c", "l", "p"])
        close(got["a"], [2.5, -1.5, 0.5, -3.5, 0.5])
        close(got["b"], [5.5 / 3, 0.5, 3.5 / 3, -0.5 / 3, 3.5 / 3])
        close(got["c"], [5, 5, -5, -5, 5])
        close(got["l"], [1, 0, 1, 0, 1])
        close(sum(got["p"][0]), 1)


@pytest.mark.parametrize("depth", [3, 7])
@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_kernels_walk_like_a_tree(monkeypatch, depth, limit):
    monkeypatch.setattr("quillon.models.forest.TABLE_BYTES", limit)
    rng = np.random.default_rng(depth)
    cuts = [(0, [1, 2, 3, 4, 5]), (1, [-1.5, 0, 0.25, 7]), (2, [0, 1])]
    ops = ("<", "<=", ">", ">=", "==", "!=", "in", "not_in", "is_missing")
    trees = [grow(rng, depth, cuts, ops=ops) for _ in range(12)]
    x = rng.choice([-2.0, -1.5, -1, -0.5, 0, 0.25, 1, 1.5, 2, 3, 4, 4.7, 5, 6, 7, 100, np.nan], (400, 3))
    forest = Forest([Tree.of(t) for t in trees], 3)
    assert (forest.tables is None) == (limit == 0) and forest.words == (2 if depth == 7 else 1)
    e = Ensemble([Tree.of(t) for t in trees], "sum", [0.0], [1.0] * 12, [0] * 12, 1)
    want = [sum(walk(t, row) for t in trees) for row in x.tolist()]
    assert np.allclose(e.run(forest)(x)[:, 0], want)


def test_vote_and_groups(spark):
    trees = [stump(0, 1, 0, 2), stump(0, 2, 0, 2), stump(0, 3, 1, 2)]
    got = apply(spark, wide((0,), (1.5,), (9,)), [
        node("model.TreeEnsemble", ["x0"], ["l", "p"], trees=trees, aggregation="majority_vote"), node("model.TreeEnsemble", ["x0"], ["l2", "p2"], trees=trees, aggregation="majority_vote", engine="kernel"),
        node("model.TreeEnsemble", ["x0"], ["g"], trees=trees, tree_group=[0, 1, 0]), node("model.TreeEnsemble", ["x0"], ["m"], trees=trees, aggregation="min", base_score=[100]),
    ], ["l", "p", "l2", "p2", "g", "m"])
    close([got["l"], got["l2"]], [[0, 0, 2]] * 2)
    close(got["p"][0], [2 / 3, 1 / 3, 0])
    close(got["p2"], got["p"])
    close(got["g"], [[1, 0], [3, 0], [4, 2]])
    close(got["m"], [0, 0, 2])
    with pytest.raises(GraphError):
        apply(spark, wide((0,)), [node("model.TreeEnsemble", ["x0"], ["a"], trees=trees, base_score=[1, 2])], ["a"])


def test_post_transforms(spark):
    kinds = {"sigmoid": 1 / (1 + math.exp(-0.4)), "logit": 1 / (1 + math.exp(-0.4)), "exp": math.exp(0.4), "cloglog": 1 - math.exp(-math.exp(0.4)), "cauchit": 0.5 + math.atan(0.4) / math.pi, "loglog": math.exp(-math.exp(-0.4)), "probit": -0.2533}
    got = apply(spark, wide((0.4,)), [node("model.SVM", ["x0"], [k], coefficients=[1], post_transform=k) for k in kinds] + [node("model.SVM", ["x0"], ["two"], coefficients=[1], post_transform="sigmoid_binary")], [*kinds, "two"])
    for k, w in kinds.items():
        close(got[k], [w], 1e-3 if k == "probit" else 1e-8)
    close(got["two"][0], [1 - kinds["sigmoid"], kinds["sigmoid"]])


def test_linear_ties(spark):
    got = apply(spark, wide((0,), (1,), (N,)), [
        node("model.Linear", ["x0"], ["l", "p"], coefficients=[1], post_transform="sigmoid"), node("model.Linear", ["x0"], ["b"], coefficients=[1], post_transform="sigmoid"), node("model.SVM", ["x0"], ["s", "d"], coefficients=[1]),
        node("model.NeuralNetwork", ["x0"], ["n", "q"], layers=[{"weights": [1], "activation": "logistic"}]), node("model.Linear", ["x0"], ["m"], coefficients=[[1], [2]], intercept=[0, -1]),
    ], ["l", "p", "b", "s", "d", "n", "q", "m"])
    close([got["l"], got["s"], got["n"]], [[0, 1, 0], [1, 1, 0], [1, 1, 0]])  # over a half; from zero; from a half
    close(got["b"][0], [0.5, 0.5])
    close(got["m"][1], [1, 1])


def test_bayes(spark):
    half = [math.log(0.5)] * 2
    got = apply(spark, wide((0, 1), (10, 0)), [
        node("model.NaiveBayes", ["x0"], ["l", "p"], variant="gaussian", class_log_priors=half, means=[[0], [10]], variances=[[1], [1]]),
        node("model.NaiveBayes", ["x1"], ["k", "q"], variant="categorical", class_log_priors=half, feature_log_prob=[[[math.log(0.9), math.log(0.1)], [math.log(0.2), math.log(0.8)]]]),
        node("model.NaiveBayes", ["x0"], ["m", "r"], variant="categorical", class_log_priors=half, feature_log_prob=[[[-1.0], [-2.0]]]),
    ], ["l", "p", "k", "q", "m", "r"])
    close([got["l"], got["k"], got["m"]], [[0, 1], [1, 0], [0, 0]])
    close(sum(got["p"][0]), 1)
    close(got["q"][0], [0.1 / 0.9, 0.8 / 0.9])
    close(got["r"][1], [0.5, 0.5])  # a category out of range counts nothing


def test_clusters(spark):
    got = apply(spark, wide((1, 1), (9, 9), (5, 5)), [
        node("model.Clustering", ["x0", "x1"], ["l", "d"], centers=[[0, 0], [10, 10]]),
        node("model.Clustering", ["x0", "x1"], ["m", "p"], variant="gaussian_mixture", covariance_type="full", means=[[0, 0], [10, 10]], covariances=[[[1, 0], [0, 1]]] * 2, weights=[0.5, 0.5]),
    ], ["l", "d", "m", "p"])
    close([got["l"], got["m"]], [[0, 1, 0]] * 2)
    close(got["d"][0], [2, 162])
    close(got["p"][2], [0.5, 0.5])


def test_networks(spark):
    layers = [{"weights": [[1, -1], [2, 0.5]], "bias": [0.5, -1], "activation": "tanh"}, {"weights": [[1, 1], [-1, 2]], "activation": "softmax"}]
    h = np.tanh(np.array([[1, -1], [2, 0.5]]) @ [0.3, -0.2] + [0.5, -1])
    o = np.exp(np.array([[1, 1], [-1, 2]]) @ h)
    got = apply(spark, wide((0.3, -0.2), (N, 1)), [node("model.NeuralNetwork", ["x0", "x1"], ["l", "p"], layers=layers)], ["l", "p"])
    close(got["p"][0], (o / o.sum()).tolist())
    assert got["l"][0] == float(o.argmax()) and got["p"][1] == [N, N]


def test_svm(spark):
    sv, dual = [[0, 0], [1, 1]], [[0.5, -0.25]]
    d = 0.1 + 0.5 * math.exp(-0.5) - 0.25 * math.exp(-0.5)
    got = apply(spark, wide((1, 0)), [
        node("model.SVM", ["x0", "x1"], ["a"], support_vectors=sv, dual_coefficients=dual, intercept=[0.1], gamma=0.5), node("model.SVM", ["x0", "x1"], ["l", "p"], support_vectors=sv, dual_coefficients=dual, intercept=[0.1], gamma=0.5, prob_a=[-2], prob_b=[0.3]),
        node("model.AnomalyDetection", ["x0", "x1"], ["score", "decision_function", "y_pred"], variant="one_class_svm", support_vectors=sv, dual_coefficients=dual[0], intercept=0.1, gamma=0.5, offset=1.0),
        node("model.SVM", ["x0", "x1"], ["c", "q"], support_vectors=[[0, 0], [1, 1], [2, 0]], n_support=[1, 1, 1], dual_coefficients=[[1, -1, -0.5], [0.5, 0.7, -0.9]], intercept=[0.1, 0.2, -0.1], gamma=0.5, prob_a=[-1, -2, -1.5], prob_b=[0, 0.1, 0.2]),
    ], ["a", "l", "p", "score", "decision_function", "y_pred", "c", "q"])
    close(got["a"], [d])
    p = 1 - 1 / (1 + math.exp(-2 * -d + 0.3))
    close([got["l"], got["p"]], [[1], [[1 - p, p]]])
    close([got["score"], got["decision_function"], got["y_pred"]], [[d], [d - 1], [-1]])
    close(sum(got["q"][0]), 1)


def test_coupling_solves_its_equations():
    rng = np.random.default_rng(2)
    for k in (3, 5):
        r = np.full((50, k, k), 0.5)
        for i in range(k):
            for j in range(i + 1, k):
                r[:, i, j] = rng.uniform(0.05, 0.95, 50)
                r[:, j, i] = 1 - r[:, i, j]
        p = couple(r)
        assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()
        true = rng.dirichlet(np.ones(k), 50)
        ideal = true[:, :, None] / (true[:, :, None] + true[:, None, :])
        assert np.abs(couple(ideal) - true).max() < 0.02


def lof(x, refs, k):
    dist = lambda a, b: math.dist(a, b)
    near = lambda p, skip: sorted((dist(p, r), i) for i, r in enumerate(refs) if i != skip)[:k]
    kd = [near(r, i)[-1][0] for i, r in enumerate(refs)]
    lrd = lambda p, skip: 1 / (sum(max(kd[i], d) for d, i in near(p, skip)) / k + 1e-10)
    own = [lrd(r, i) for i, r in enumerate(refs)]
    return -(sum(own[i] for _, i in near(x, -1)) / k / lrd(x, -1))


def test_anomalies(spark):
    refs = [(float(i % 5), float(i * i % 7)) for i in range(30)]
    got = apply(spark, wide((1, 1), (2, -1), (30, 30)), [
        node("model.AnomalyDetection", ["x0", "x1"], ["score"], variant="linear_one_class_svm", coefficients=[1, 2], intercept=0.5), node("model.AnomalyDetection", ["x0", "x1"], ["lof_score"], variant="local_outlier_factor", reference_samples=refs, n_neighbors=4),
        node("model.AnomalyDetection", ["x0", "x1"], ["label"], variant="elliptic_envelope", offset=-3), node("model.AnomalyDetection", ["x0"], ["iso"], variant="isolation_forest", trees=[stump(0, 1.0, 2, 4), stump(0, 5, 3, 1)], max_samples=2),
    ], ["score", "lof_score", "label", "iso"])
    close(got["score"], [3.5, 0.5, 90.5])
    close(got["lof_score"], [lof(x, refs, 4) for x in ((1, 1), (2, -1), (30, 30))])
    close(got["label"], [1, -1, -1])
    close(got["iso"], [-(2**-2.5), -(2**-3.5), -(2**-2.5)])
    with pytest.raises(GraphError):
        apply(spark, wide((1, 1)), [node("model.AnomalyDetection", ["x0"], ["s"], variant="linear_one_class_svm", coefficients=[1], n_features=2)], ["s"])
