import numpy as np
import pytest

from quillon.llm import mixing

DATA = "/root/testdata/sf0.01"


def best(p, t, want):
    """The rates nearest to one that meet the totals, by Newton's method on their multipliers."""
    share, u = t / t.sum(), np.zeros(p.shape[1])
    for _ in range(200):
        r = np.maximum(0, 1 + p @ u)
        on = r > 0
        m = (share[on, None] * p[on]).T @ p[on]
        u -= np.linalg.pinv(m) @ ((share[:, None] * r[:, None] * p).sum(axis=0) - want)
    return np.maximum(0, 1 + p @ u)


def test_rates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    q = np.floor(rng.dirichlet([1, 1, 0.5], 40) * mixing.GRID).astype(int)
    q[:, 0] += mixing.GRID - q.sum(axis=1)
    t = rng.integers(1, 500, 40)
    cells = spark.createDataFrame([(x.tolist(), int(n)) for x, n in zip(q, t)], "_q array<int>, tokens long")
    for targets in ({"good": 0.6, "poor": 0.3, "toxic": 0.1}, {"good": 0.75, "poor": 0.24, "toxic": 0.01}):
        got = {tuple(r._q): r.rate for r in mixing.solve(cells, targets).collect()}
        have = np.array([got[tuple(x)] for x in q.tolist()])
        want = best(q / mixing.GRID, t.astype(float), np.array(list(targets.values())))
        total = lambda r: (t[:, None] * r[:, None] * q / mixing.GRID).sum(axis=0) / t.sum()
        assert (have >= 0).all() and np.abs(total(want) / list(targets.values()) - 1).max() < 1e-6
        assert np.abs(total(have) / list(targets.values()) - 1).max() < 1e-3
        # no farther from one than the nearest rates by much
        distance = lambda r: (t * (r - 1) ** 2).sum()
        assert distance(have) < 1.2 * distance(want) + 1e-6


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rows = {r.doc_id: r for r in mixing.summary(docs, labels).collect()}
    assert len(rows) == docs.count()
    tokens = sum(r.n_tokens for r in rows.values())
    text = {r.doc_id: r.text for r in docs.collect()}
    classifier = mixing.fit(docs, labels)
    exact = {i: classifier.exact(t)[1] for i, t in text.items()}
    for d, name in enumerate(mixing.DOMAINS):
        assert sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in rows.values()) / tokens == pytest.approx(mixing.TARGETS[name], rel=0.002), name
        # with posteriors that are not rounded
        assert sum(r.rate * r.n_tokens * exact[i][d] for i, r in rows.items()) / tokens == pytest.approx(mixing.TARGETS[name], rel=0.01), name
    assert all(abs(r.copies - r.rate) < 1 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in rows.values())


def test_held_out_accuracy(spark):
    """The classifier, fitted on the labels of even ids, against those of odd ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    classifier = mixing.fit(docs, labels.where("doc_id % 2 = 0"))
    truth = {r.doc_id: 2 if r.toxic else 0 if r.quality else 1 for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [(truth[r.doc_id], classifier.posterior(r.text)[1]) for r in docs.collect() if r.doc_id in truth]
    assert len(rows) > 500 and sum(int(np.argmax(q)) == y for y, q in rows) / len(rows) > 0.9


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0, "x"), (3, 0, 1, "x"), (None, 1, 1, "x"), (5, None, 0, "x"), (4, 0, 1, "x")], "doc_id long, quality int, toxic int, _q string")
    rows = mixing.summary(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2, 6))
    assert mixing.summary(odd, labels.limit(0)).count() == odd.count()
    assert mixing.summary(odd.limit(0), labels).count() == 0
    assert set(odd.columns) <= set(mixing.mix(odd, labels).columns)


def test_documents_labelled_good_stay_in_the_mix(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rows = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    good = {r.doc_id for r in labels.collect() if r.quality and not r.toxic} & {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(good - rows.keys()) <= 0.01 * len(good)  # what the classifier takes for toxic
    assert all(r.rate > 0 for r in rows.values())
    clean = [r for r in rows.values() if r.p_good >= max(r.p_poor, r.p_toxic)]
    assert len(clean) >= 0.98 * len(good) and all(r.rate >= 1 and r.copies >= 1 for r in clean)
    # the targets' shares are of tokens
    total = {d: sum(r.rate * len(mixing._WORD.findall((r.text or "").encode().lower())) * r[f"p_{d}"] for r in rows.values()) for d in mixing.DOMAINS}
    share = {d: x / sum(total.values()) for d, x in total.items()}
    assert all(share[d] == pytest.approx(mixing.TARGETS[d], rel=0.01) for d in mixing.DOMAINS), share
