import math

import pytest
from pyspark.ml.feature import HashingTF

from quillon import GraphError, ScoringModel

from .helpers import apply, close, node, wide

N = None


def test_scalers(spark):
    got = apply(spark, wide((0, 10), (5, 20), (N, 0)), [
        node("feature.MinMaxScaler", ["x0", "x1"], ["a"], data_min=[0, 10], data_max=[10, 10]), node("feature.MinMaxScaler", ["x0"], ["b"], data_min=[0], data_max=[10], feature_range_min=-1, feature_range_max=1),
        node("feature.RobustScaler", ["x0", "x1"], ["c"], center=[5, 0], scale=[2, 4]), node("feature.MaxAbsScaler", ["x0", "x1"], ["d"], scale=[4, 8]), node("feature.StandardScaler", ["x0"], ["e"], scale=[0]),
    ], ["a", "b", "c", "d", "e"])
    close(got["a"], [[0, 0], [0.5, 1], [N, -1]])
    close(got["b"], [-1, 0, N])
    close(got["c"], [[-2.5, 2.5], [0, 5], [N, 0]])
    close(got["d"], [[0, 1.25], [1.25, 2.5], [N, 0]])
    close(got["e"], [0, 5, N])


def test_normalizer_and_power(spark):
    got = apply(spark, wide((1, 2, 3), (2, 5, 3), (0, 0, 0)), [node("feature.Normalizer", ["x0", "x1", "x2"], [k], norm=k) for k in ("l1", "max", "l2")], ["l1", "max", "l2"])
    close(got["l1"][0], [1 / 6, 2 / 6, 3 / 6])
    close(got["max"][1], [0.4, 1, 0.6])
    close(got["l2"][2], [0, 0, 0])
    got = apply(spark, wide((3,), (math.e,), (-3,), (N,)), [
        node("feature.PowerTransformer", ["x0"], ["a"], lambdas=[2]), node("feature.PowerTransformer", ["x0"], ["b"], lambdas=[0], method="box_cox"), node("feature.PowerTransformer", ["x0"], ["c"], lambdas=[0]),
    ], ["a", "b", "c"])
    close(got["a"], [7.5, ((math.e + 1) ** 2 - 1) / 2, -math.log(4), N])
    close(got["b"], [math.log(3), 1, math.log(1e-10), N])
    close(got["c"], [math.log(4), math.log1p(math.e), -(16 - 1) / 2, N])


def test_quantile_spline_polynomial(spark):
    got = apply(spark, wide((0,), (5,), (10,), (1.5,), (N,)), [
        node("feature.QuantileTransformer", ["x0"], ["a"], quantiles=[0, 0.5, 1], references=[[0, 5, 10]]), node("feature.SplineTransformer", ["x0"], ["b"], knots=[0, 0, 1, 2, 2], degree=1),
    ], ["a", "b"])
    close(got["a"], [0, 0.5, 1, 0.15, N])
    close(sum(got["b"][3]), 1)
    close(got["b"][2], [0, 0, 0])
    got = apply(spark, wide((2, 3)), [
        node("feature.PolynomialFeatures", ["x0", "x1"], ["a"], include_bias=False), node("feature.PolynomialFeatures", ["x0", "x1"], ["b"], min_degree=0),
        node("feature.PolynomialFeatures", ["x0", "x1"], ["c"], powers=[[2, 1]]),
    ], ["a", "b", "c"])
    assert sorted(got["a"][0]) == [2, 3, 4, 6, 9]
    close(got["b"][0], [1, 1, 3, 9, 2, 6, 4])  # a bias of its own, and the empty product
    close(got["c"], [12])


def test_binners(spark):
    got = apply(spark, wide((-1,), (0,), (1.5,), (3,), (5,), (N,)), [
        node("feature.Bucketizer", ["x0"], ["a"], boundaries=[0, 2, 4]), node("feature.Binarizer", ["x0"], ["b"]), node("feature.Discretizer", ["x0"], ["c"], bin_left=[N, 1], bin_right=[1, 3], bin_values=[7, 8]),
        node("feature.NormContinuous", ["x0"], ["d"], orig_points=[0, 3], norm_points=[0, 6], outlier_treatment="as_missing", map_missing_to=-1), node("feature.NormDiscrete", ["x0"], ["e"], value=3),
        node("feature.MapValues", ["x0"], ["f"], keys=[0, 0, 3], values=[1, 2, 5], default_value=9),
    ], ["a", "b", "c", "d", "e", "f"])
    close(got["a"], [0, 1, 1, 2, 3, 0])
    close(got["b"], [0, 0, 1, 1, 1, 0])
    close(got["c"], [7, 7, 8, 8, N, N])
    close(got["d"], [N, N, 3, N, N, -1])
    close(got["e"], [0, 0, 0, 1, 0, N])
    close(got["f"], [9, 1, 9, 5, 9, N])


def test_missing_values(spark):
    got = apply(spark, wide((1, N, 3), (N, 5, N)), [
        node("feature.Imputer", ["x0", "x1"], ["a"], fill_tensor=[99, -1]), node("feature.MissingIndicator", ["x0", "x1", "x2"], ["b"]), node("feature.Imputer", ["x0", "x2"], ["c", "d"], fill_value=7),
    ], ["a", "b", "c", "d"])
    close(got["a"], [[1, -1], [99, 5]])
    close(got["b"], [[0, 1, 0], [1, 0, 1]])
    close([got["c"], got["d"]], [[1, 7], [3, 7]])


def test_knn_imputer(spark):
    train = [[1, 10], [2, N], [3, 30], [N, 12]]
    got = apply(spark, wide((N, 11), (1, N), (2, 5), (N, N)), [
        node("feature.KNNImputer", ["x0", "x1"], ["a"], train_features=train, n_neighbors=2), node("feature.KNNImputer", ["x0", "x1"], ["b"], train_features=train, n_neighbors=1),
        node("feature.KNNImputer", ["x0", "x1"], ["c"], train_features=train, n_neighbors=3, weights="distance"),
    ], ["a", "b", "c"])
    close(got["a"], [[1, 11], [1, 10], [2, 5], [N, N]])
    close(got["b"][:2], [[1, 11], [1, 10]])
    close(got["c"][0], [(1 / 1 * 1 + 3 / 19) / (1 + 1 / 19), 11])


def test_encoders(spark):
    rows = [{"s": "b", "t": "z", "n": 1}, {"s": "a", "t": "x", "n": 2}, {"s": "?", "t": "y", "n": 99}, {"s": N, "t": "y", "n": N}]
    got = apply(spark, rows, [
        node("feature.OrdinalEncoder", ["s", "t"], ["a"], categories=["a", "b", "x", "y", "z"], category_offsets=[0, 2, 5]), node("feature.OrdinalEncoder", ["n"], ["b"], categories=["1", "2", "q"]),
        node("feature.LabelEncoder", ["n"], ["c"], labels=["1", "3", "q"]), node("feature.TargetEncoder", ["n"], ["d"], categories=[1, 2, 3], encoded_values=[10, 20, 30], default_values=[15]),
        node("feature.OneHotEncoder", ["s", "n"], ["e"], categories=["a", "b", 0, 1, 2], category_offsets=[0, 2, 5]), node("feature.LabelEncoder", ["s"], ["f"], labels=[f"k{i}" for i in range(40)] + ["a"]),
        node("feature.OneHotEncoder", ["n"], ["g"], categories=["p", "q"]), node("feature.LabelEncoder", ["n"], ["h"]),
    ], ["a", "b", "c", "d", "e", "f", "g", "h"], types={"s": "string", "t": "string"})
    close(got["a"], [[1, 2], [0, 0], [N, 1], [N, 1]])
    close(got["b"], [0, 1, N, N])
    close(got["c"], [0, 2, N, N])
    close(got["d"], [10, 20, 15, 15])
    close(got["e"], [[0, 1, 0, 1, 0], [1, 0, 0, 0, 1], [0] * 5, [0] * 5])
    close(got["f"], [N, 40, N, N])
    close(got["g"], [[0, 1], [0, 0], [0, 0], [0, 0]])
    close(got["h"], [1, 2, 99, N])


def test_label_binarizers(spark):
    got = apply(spark, wide((10, 30), (20, -1), (0.3, N)), [
        node("feature.MultiLabelBinarizer", ["x0", "x1"], ["a"], classes=[10, 20, 30]), node("feature.LabelBinarizer", ["x0"], ["b"]), node("feature.LabelBinarizer", ["x0"], ["c"], classes=[10, 20]),
    ], ["a", "b", "c"])
    close(got["a"], [[1, 0, 1], [0, 1, 0], [0, 0, 0]])
    close(got["b"], [1, 1, 0])
    close(got["c"], [[1, 0], [0, 1], [0, 0]])


def test_projections(spark):
    got = apply(spark, wide((3, 5), (1, 2), (-1, -1)), [
        node("feature.TruncatedSVD", ["x0", "x1"], ["a"], components=[[1, 0], [0, 1]]), node("feature.FactorAnalysis", ["x0", "x1"], ["b"], components=[[1, 0]], mean=[1, 2]), node("feature.NMF", ["x0", "x1"], ["c"], components=[[1, 2]]),
        node("feature.PCA", ["x0", "x1"], ["d"], components=[[0.5, 0.5]], mean=[1, 1]), node("feature.FastICA", ["x0", "x1"], ["e"], components=[[2, 1]], whitening=[[1, 0], [0, 3]], mean=[1, 1]),
        node("feature.LatentDirichletAllocation", ["x0", "x1"], ["f"], components=[[100, 0], [0, 1]]), node("feature.FactorAnalysis", ["x0", "x1"], ["g"], components=[[1, 2]], mean=[0, 0], noise_variance=[1, 2]),
    ], ["a", "b", "c", "d", "e", "f", "g"])
    close(got["a"], [[3, 5], [1, 2], [-1, -1]])
    close(got["b"], [2, 0, -2])
    close(got["c"], [13, 5, 0])
    close(got["d"], [3, 0.5, -2])
    close(got["e"], [2 * 2 + 3 * 4, 3, 2 * -2 + 3 * -2])
    close(got["f"][0], [1, 0])
    close(got["g"], [(3 + 5) / 4, 3 / 4, -2 / 4])


def test_kernel_pca(spark):
    train, dual, x = [[0.0, 1.0], [2.0, -1.0]], [[0.5, -0.25]], (1.0, 2.0)
    kinds = {"linear": lambda a: sum(p * q for p, q in zip(a, x)), "poly": lambda a: (0.5 * sum(p * q for p, q in zip(a, x)) + 1) ** 3, "sigmoid": lambda a: math.tanh(0.5 * sum(p * q for p, q in zip(a, x)) + 1), "rbf": lambda a: math.exp(-0.5 * sum((p - q) ** 2 for p, q in zip(a, x)))}
    nodes = [node("feature.KernelPCA", ["x0", "x1"], [k], fit_samples=train, dual_components=dual, kernel=k) for k in kinds]
    got = apply(spark, wide(x), nodes, list(kinds))
    for k, f in kinds.items():
        close(got[k], [0.5 * f(train[0]) - 0.25 * f(train[1])])


def test_votes(spark):
    got = apply(spark, wide((1, 2, 2), (0, 1, 2), (1, N, 1)), [
        node("core.MajorityVote", ["x0", "x1", "x2"], ["a"]), node("core.WeightedMajorityVote", ["x0", "x1", "x2"], ["b"], weights=[5, 1, 1]), node("core.WeightedMedian", ["x0", "x1", "x2"], ["c"], weights=[1, 1, 3]),
        node("core.Median", ["x0", "x1"], ["d"]), node("core.ArgMax", ["x0", "x1", "x2"], ["e"]), node("core.SAMMEVote", ["x0", "x2"], ["p", "l"], n_classes=3),
    ], ["a", "b", "c", "d", "e", "p", "l"])
    close(got["a"], [2, 0, 1])
    close(got["b"], [1, 0, 1])
    close(got["c"], [2, 2, N])
    close(got["d"], [2, 1, N])
    close(got["e"], [1, 2, 0])
    close(sum(got["p"][0]), 1)
    close(got["l"], [1, 0, 1])
    got = apply(spark, wide((1, 0, 0, 1)), [node("core.Concat", ["x0", "x1"], ["p"]), node("core.Concat", ["x2", "x3"], ["q"]), node("core.SoftVote", ["p", "q"], ["a", "l"], weights=[3, 1])], ["a", "l"])
    close([got["a"], got["l"]], [[[0.75, 0.25]], [0]])


def test_selection(spark):
    got = apply(spark, wide((0, 5, 7), (9, 5, 7), (-3, 5, 7), (N, 5, N)), [
        node("core.Select", ["x0", "x1", "x2"], ["a"]), node("core.Clip", ["x0"], ["b"], min=0, max=5), node("core.Split", ["w"], ["c", "d"], sections=[1, 2]), node("core.Gather", ["w"], ["e"]),
    ][1:2] + [node("core.Concat", ["x0", "x1", "x2"], ["w"]), node("core.Select", ["x0", "x1", "x2"], ["a"]), node("core.Split", ["w"], ["c", "d"], sections=[1, 2]), node("core.Gather", ["w"], ["e"]),
       node("core.SelectByPrimarySecondaryScore", ["d", "d"], ["f"]), node("core.Sum", ["d", "d"], ["g"])], ["a", "b", "c", "d", "e", "f", "g"])
    close(got["a"], [5, 7, 5, 5])
    close(got["b"], [0, 5, 0, N])
    close(got["d"], [[5, 7], [5, 7], [5, 7], [5, N]])
    close(got["e"][0], [0, 5, 7])
    close(got["f"], [1, 1, 1, 0])
    close(got["g"], [[10, 14], [10, 14], [10, 14], [10, N]])
    with pytest.raises(GraphError):
        apply(spark, wide((1, 2)), [node("core.Gather", ["x0"], ["a"], indices=[3])], ["a"])
    with pytest.raises(GraphError):
        apply(spark, wide((1, 2)), [node("core.Nothing", ["x0"], ["a"])], ["a"])


def test_knn(spark):
    train, y = [[0], [1], [10], [11]], [0, 0, 1, 1]
    got = apply(spark, wide((0.4,), (10.4,), (5.5,), (N,)), [
        node("ml.KNN", ["x0"], ["a", "p"], train_features=train, train_targets=y, n_neighbors=3), node("ml.KNN", ["x0"], ["b"], train_features=train, train_targets=y, n_neighbors=2, task="regression"),
        node("ml.KNN", ["x0"], ["c"], train_features=train, train_targets=y, neighbor_mode="radius", radius=1, outlier_label=7), node("ml.KNN", ["x0"], ["d"], train_features=train, train_targets=y, n_neighbors=4),
        node("ml.KNN", ["x0"], ["e"], train_features=train, train_targets=[1, 2, 3, 4], task="regression", n_neighbors=2, weights="distance"),
    ], ["a", "p", "b", "c", "d", "e"])
    close(got["a"], [0, 1, 0, N])
    close(got["p"][:2], [[2 / 3, 1 / 3], [1 / 3, 2 / 3]])
    close(got["b"][:2], [0, 1])
    close(got["c"], [0, 1, 7, N])
    close(got["d"], [0, 0, 0, N])  # equal votes go to the lowest class
    close(got["e"][0], (1 / 0.4 * 1 + 1 / 0.6 * 2) / (1 / 0.4 + 1 / 0.6))


def test_text(spark):
    rows = [{"s": "  À Hello,\tWORLD hello \n"}, {"s": ""}, {"s": N}]
    got = apply(spark, rows, [
        node("text.Lowercase", ["s"], ["a"]), node("text.Trim", ["s"], ["b"]), node("text.NormalizeWhitespace", ["s"], ["c"]), node("text.StringReplace", ["s"], ["d"], old="l", new="L", replace_all=False),
        node("text.RegexReplace", ["s"], ["e"], pattern="([a-z])l", replacement="<$1>$&"), node("text.Tokenizer", ["s"], ["t"]), node("text.RegexTokenizer", ["s"], ["u"], pattern="[^a-z]+", min_token_length=2),
        node("text.NGram", ["t"], ["n"], n_min=1, n_max=2), node("text.StopWordsRemover", ["t"], ["w"], stop_words=["HELLO"]), node("text.CountVectorizer", ["t"], ["v"], vocabulary=["hello", "world", "hello"]),
        node("text.Word2Vec", ["t"], ["x"], vocabulary=["hello", "world"], vectors=[[1, 2], [3, 4]]), node("text.HashingVectorizer", ["t"], ["h"], num_features=8), node("text.HashingVectorizer", ["t"], ["m"]),
    ], ["a", "b", "c", "d", "e", "t", "u", "n", "w", "v", "x", "h", "m"], types={"s": "string"})
    assert got["a"][0] == "  À hello,\tworld hello \n" and got["b"][:2] == ["À Hello,\tWORLD hello", ""] and got["c"][0] == " À Hello, WORLD hello "
    assert got["d"][0] == "  À HeLlo,\tWORLD hello \n" and got["e"][0] == "  À H<e>ello,\tWORLD h<e>ello \n"
    assert got["t"] == [["À", "hello,", "world", "hello"], [], N] and got["u"][0] == ["hello", "world", "hello"]
    assert got["n"][0] == ["À", "hello,", "world", "hello", "À hello,", "hello, world", "world hello"] and got["n"][1] == []
    assert got["w"][0] == ["À", "hello,", "world"]
    close(got["v"][:2], [[0, 1, 1], [0, 0, 0]])
    close(got["x"][:2], [[2, 3], [0, 0]])
    from pyspark.ml.feature import HashingTF

    tokens = spark.createDataFrame([(got["t"][0],)], "t array<string>")
    want = HashingTF(numFeatures=1 << 18, inputCol="t", outputCol="f").transform(tokens).first()["f"]
    assert got["m"][0] == dict(zip(want.indices.tolist(), want.values.tolist())) and sum(got["h"][0]) == 4


def test_wide_sparse_values(spark):
    words = ["alpha", "beta", "été", "😀", "a" * 41]
    place = {w: HashingTF(numFeatures=1 << 18).indexOf(w) for w in words}
    size = 1 << 18
    weights = [[0.0] * size for _ in range(2)]
    for k, w in enumerate(words):
        weights[0][place[w]], weights[1][place[w]] = k + 1.0, -1.0
    rows = [{"w": ["alpha", "alpha", "été"]}, {"w": [*words, ""]}, {"w": []}, {"w": None}, {"w": [None, "beta"]}]
    got = apply(spark, rows, [
        node("text.HashingVectorizer", "w", "h"), node("text.TfIdfTransformer", "h", "t", idf=[2.0] * size), *[node("feature.Normalizer", "h", k, norm=k) for k in ("l1", "max", "l2")],
        node("model.Linear", "t", "lin", coefficients=weights, intercept=[1, 0]), node("feature.TruncatedSVD", "h", "svd", components=weights), node("model.SVM", "h", "svm", coefficients=weights, intercept=[0, 0]),
        node("model.NaiveBayes", "h", ["c", "p"], variant="multinomial", feature_log_prob=weights, class_log_priors=[0, 0]),
    ], ["h", "t", "l1", "max", "l2", "lin", "svd", "svm", "c"], types={"w": "tokens"})
    assert got["h"][0] == {place["alpha"]: 2, place["été"]: 1} and got["h"][1] == {place[w]: 1 for w in words} and got["h"][2] == got["h"][3] == {} and got["h"][4] == {place["beta"]: 1}
    assert got["t"][0] == {place["alpha"]: 4, place["été"]: 2}
    close(got["l1"][0][place["alpha"]], 2 / 3)
    close(got["max"][0][place["été"]], 0.5)
    close(got["l2"][0][place["été"]], 5**-0.5)
    close(got["lin"], [[11, -6], [31, -10], [1, 0], [1, 0], [5, -2]])
    close(got["svd"], [[5, -3], [15, -5], [0, 0], [0, 0], [2, -1]])
    assert got["svm"] == got["svd"] and got["c"] == [0, 0, 0, 0, 0]
    for nodes in ([node("feature.Binarizer", "h", "b")], [node("core.SparseToDense", "h", "b")], [node("feature.TruncatedSVD", "h", "b", components=[[1.0] * 4])]):
        with pytest.raises((GraphError, ValueError)):
            apply(spark, rows, [node("text.HashingVectorizer", "w", "h"), *nodes], ["b"], types={"w": "tokens"})


def test_wide_normalised_sums_divide_once(spark):
    words, size = ["alpha", "beta", "gamma"], 1 << 18
    place = {w: HashingTF(numFeatures=size).indexOf(w) for w in words}
    weights, counts = [[0.0] * size for _ in range(2)], [[a, b, c] for a in range(1, 4) for b in range(4) for c in range(4)]
    for w, x, y in zip(words, (0.625, -0.375, 1.25), (1.0, 2.0, 3.0)):
        weights[0][place[w]], weights[1][place[w]] = x, y
    rows = [{"w": [w for w, n in zip(words, c) for _ in range(n)]} for c in counts] + [{"w": []}, {"w": None}]
    norms = {"l1": sum, "max": max, "l2": lambda c: math.sqrt(sum(n * n for n in c))}
    huge = {"coefficients": [[1e308] * size]}
    got = apply(spark, rows, [
        node("text.HashingVectorizer", "w", "h"), *[node("feature.Normalizer", "h", k, norm=k) for k in norms], *[node("model.Linear", k, f"{k}_lin", coefficients=weights, intercept=[0, 0]) for k in norms],
        node("feature.TruncatedSVD", "l2", "svd", components=weights), node("feature.Normalizer", "l2", "again", norm="l1"), node("feature.TruncatedSVD", "again", "twice", components=weights),
        node("text.TfIdfTransformer", "l1", "t", idf=[2.0] * size), node("model.Linear", "t", "t_lin", coefficients=weights, intercept=[0, 0]), node("model.Linear", "l1", "huge", intercept=[0], **huge),
    ], [*norms, *[f"{k}_lin" for k in norms], "svd", "twice", "t_lin", "huge"], types={"w": "tokens"})
    for k, norm in norms.items():
        assert got[f"{k}_lin"] == [*[[(0.625 * a - 0.375 * b + 1.25 * c) / norm([a, b, c]), (a + 2.0 * b + 3.0 * c) / norm([a, b, c])] for a, b, c in counts], [0, 0], [0, 0]]
        assert got[k] == [*[{place[w]: n / norm(c) for w, n in zip(words, c) if n} for c in counts], {}, {}]
    assert got["svd"] == got["l2_lin"]
    close(got["twice"], got["l1_lin"])
    close(got["t_lin"], [[2 * v for v in r] for r in got["l1_lin"]])
    close(got["huge"], [1e308] * len(counts) + [0, 0])  # the sums before division overflow


def test_reshape_across_rows(spark):
    df = spark.createDataFrame([(1, "g", 1.0, 2.0, "x"), (5, "g", 3.0, None, "y"), (7, "h", 5.0, 6.0, None)], "i long, g string, a double, b double, other string")
    wide = [node("core.Concat", ["a", "b"], "w")]
    graph = {"version": "0.1.0", "inputs": ["a", "b"], "outputs": ["r"]}
    got = ScoringModel({**graph, "nodes": [*wide, node("core.Reshape", "w", "r", new_shape=[-1, 4], order="i")]}).transform(df)
    assert got.columns == ["i", "r"] and {r.i: r.r for r in got.collect()} == {0: [1, 2, 3, N], 1: [5, 6, N, N]}
    one = ScoringModel({**graph, "nodes": [*wide, node("core.Reshape", "w", "c", new_shape=[-1, 1], order="i", by="g"), node("core.Clip", "c", "r", max=4)]}).transform(df)
    assert sorted(((r.g, r.i, r.r) for r in one.collect()), key=str) == [("g", 0, 1), ("g", 1, 2), ("g", 2, 3), ("g", 3, N), ("h", 0, 4), ("h", 1, 4)]
    assert ScoringModel({**graph, "nodes": [*wide, node("core.Reshape", "w", "r", new_shape=[-1, 4], order="i")]}).transform(df.limit(0)).count() == 0
    for bad in (dict(new_shape=[-1, 4]), dict(new_shape=[-1, 4], order="absent"), dict(new_shape=[-1, 0], order="i")):
        with pytest.raises(GraphError):
            ScoringModel({**graph, "nodes": [*wide, node("core.Reshape", "w", "r", **bad)]}).transform(df)
    with pytest.raises(GraphError):  # what the reshaping leaves behind is gone
        ScoringModel({**graph, "nodes": [*wide, node("core.Reshape", "w", "z", new_shape=[-1, 4], order="i"), node("core.Sum", ["a", "b"], "r")]}).transform(df)
