import hashlib
from collections import Counter

import numpy as np

from quillon.llm import sampling

DATA = "/root/testdata/sf0.001"


def jaccard(a, b):
    x, y = Counter(a.encode().lower().split()), Counter(b.encode().lower().split())
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def test_collision_rate_is_the_similarity():
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(60):
        words = [f"w{i}" for i in rng.integers(0, 60, 120)]
        pairs.append((" ".join(words[:80]), " ".join(words[int(rng.integers(5, 40)) :])))
    a, b = (sampling.signatures([p[k] for p in pairs], 512) for k in (0, 1))
    error = sampling.likeness(a, b) - np.array([jaccard(*p) for p in pairs])
    assert abs(error.mean()) < 0.02 and error.std() < 0.04


def test_a_text_has_one_signature_wherever_it_stands():
    texts = ["a b c a", "x " * 400 + "y z", "", "A  b\nC a"]
    together = sampling.signatures(texts)
    for t, s in zip(texts, together):
        assert (sampling.signatures([t])[0] == s).all()
    assert (together[0] == together[3]).all() and not together[2].any()


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    rows = {r.doc_id: r for r in sampling.against_neighbours(docs).collect()}
    errors = []
    for i, d in enumerate(ids):
        after = texts[ids[(i + 1) % len(ids)]]
        k = len(texts[d]) // 4
        want = texts[d][: len(texts[d]) - k] + after[:k]
        assert hashlib.sha256(rows[d].edited.encode()).digest() == hashlib.sha256(want.encode()).digest()
        errors.append((rows[d].near_edited - jaccard(texts[d], want), rows[d].near_next - jaccard(texts[d], after)))
        own = np.frombuffer(bytes.fromhex(rows[d].fingerprint), ">u2")
        assert rows[d].near_edited == (own == np.frombuffer(bytes.fromhex(rows[d].edited_fingerprint), ">u2")).mean()
        assert rows[d].near_next == (own == np.frombuffer(bytes.fromhex(rows[ids[(i + 1) % len(ids)]].fingerprint), ">u2")).mean()
    assert np.abs(np.mean(errors, axis=0)).max() < 0.03


def test_odd_rows(odd, frame):
    rows = sampling.against_neighbours(odd).collect()
    assert len(rows) == odd.count()
    lone = sampling.against_neighbours(frame([(7, "abcdefgh", "en", "s")])).collect()
    assert [(r.edited, r.near_next) for r in lone] == [("abcdefab", 1.0)]
    order = sampling.against_neighbours(frame([(2, "x" * 8, "en", "s"), (None, "n" * 8, "en", "s"), (1, "y" * 8, "en", "s")])).collect()
    assert {r.doc_id: r.edited for r in order} == {1: "y" * 6 + "xx", 2: "x" * 6 + "nn", None: "n" * 6 + "yy"}
    assert sampling.against_neighbours(odd.limit(0)).count() == 0


def test_blocks_change_no_signature(monkeypatch):
    texts = [" ".join(f"w{i % k}" for i in range(3 * k)) for k in (5, 40, 300, 2000)] + ["", "a"]
    whole = sampling.signatures(texts)
    for terms in (64, 400):
        monkeypatch.setattr(sampling, "TERMS", terms)
        assert (sampling.signatures(texts) == whole).all()


def test_a_hot_id_is_cut_by_its_texts(spark):
    rows = [(None if i % 3 == 0 else i, f"text number {i} " * 5) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sampling.against_neighbours(docs).collect()
    order = [r for r in docs.selectExpr("coalesce(doc_id, 9223372036854775807) AS id", "xxhash64(text) AS tag", "text").collect()]
    order.sort(key=lambda r: (r.id, r.tag))
    want = {r.text: sampling.edited(r.text, order[(n + 1) % len(order)].text) for n, r in enumerate(order)}
    assert len(got) == 300 and {r.text: r.edited for r in got} == want
