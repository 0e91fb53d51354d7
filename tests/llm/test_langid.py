import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillon.llm import langid

DATA = "/root/testdata/sf0.01"


def brute_viterbi(s, switch):
    n, k = s.shape
    v = s[0].copy()
    for t in range(1, n):
        v = np.maximum(v, v.max() - switch) + s[t]
    return v.max()


def value(s, path, switch):
    return s[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(size=(int(rng.integers(1, 40)), int(rng.integers(1, 5)))) * rng.choice([1, 6, 15])
        path = langid.viterbi(s, 20.0)
        assert abs(value(s, path, 20.0) - brute_viterbi(s, 20.0)) < 1e-9


def test_held_out_accuracy_and_mixed_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.predict(docs).where("held_out").collect()
    assert len(rows) > 100 and sum(truth[r.doc_id] == r._lang for r in rows) / len(rows) > 0.98
    model = langid.train(docs)
    text = {r.lang: r.text for r in docs.where("n_chars > 3000").limit(400).collect()}
    a, b = text["en"][:600], text["de"][:400]
    lang, score, spans = model.predict(a + "\n" + b)
    assert lang == "en" and [s[0] for s in spans] == ["en", "de"] and abs(spans[1][1] - 600) < 40 and 0.4 < score < 0.8


def plain_words(text):
    """(start, letters) of the runs of letters."""
    out = []
    for i, c in enumerate(text or ""):
        if c.isalpha():
            if out and out[-1][0] + len(out[-1][1]) == i:
                out[-1][1].append(c)
            else:
                out.append((i, [c]))
    return out


def plain_bits(word):
    """Each letter's pair and triple, as the buckets they are counted in; script of the word's first letter."""
    low = [0, *(ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word), 0]
    top = lambda x: (x * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) >> 48
    pairs, triples = [], []
    for a, b, c in zip(low, low[1:], low[2:]):
        pairs.append(top(b * 0x9E3779B1 + c * 0x85EBCA77))
        triples.append(top(a * 0x27D4EB2F + b * 0x9E3779B1 + c * 0x85EBCA77))
    return pairs, triples, [name for first, name in langid.SCRIPTS if first <= ord(word[0])][-1]


def plain_predictions(rows):
    """doc_id: (language, score), learned and searched word by word in plain Python."""
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    counts, scripts = {}, {}
    for r in rows:
        if r.text is not None and r.lang is not None and not held(r.doc_id):
            pairs, triples = counts.setdefault(r.lang, (Counter(), Counter()))
            for _, word in plain_words(r.text):
                p, t, script = plain_bits(word)
                pairs.update(p)
                triples.update(t)
                scripts.setdefault(r.lang, Counter())[script] += len(word)
    langs, logs, known = sorted(scripts), {}, {}
    for x in langs:
        for half in (0, 1):
            total = math.log(sum(counts[x][half].values()) + langid.SMOOTH * langid.BUCKETS)
            logs[x, half] = lambda b, n=counts[x][half], total=total: 0.5 * (math.log(n[b] + langid.SMOOTH) - total)
        known[x] = {s for s, n in scripts[x].items() if n >= langid.SCRIPT_SHARE * sum(scripts[x].values())}
    scored, out = {}, {}

    def scores(word):
        key = "".join(word)
        if key not in scored:
            p, t, script = plain_bits(word)
            own = [x for x in langs if script in known[x]] or langs
            scored[key] = [sum(map(logs[x, 0], p)) + sum(map(logs[x, 1], t)) if x in own else langid.NEVER for x in langs]
        return scored[key]

    for r in rows:
        words = plain_words(r.text)
        if not words:
            out[r.doc_id] = ("und", 0.0)
            continue
        s, back = [scores(w) for _, w in words], []
        v = list(s[0])
        for now in s[1:]:
            top = max(range(len(langs)), key=lambda k: v[k])
            came = [top if v[top] - langid.SWITCH > v[k] else k for k in range(len(langs))]
            v = [(v[came[k]] - langid.SWITCH * (came[k] != k)) + now[k] for k in range(len(langs))]
            back.append(came)
        path = [max(range(len(langs)), key=lambda k: v[k])]
        for came in reversed(back):
            path.append(came[path[-1]])
        letters = Counter()
        for k, (_, w) in zip(reversed(path), words):
            letters[k] += len(w)
        main = min(letters, key=lambda k: (-letters[k], k))
        share = [math.exp(x[main] - max(x)) / sum(math.exp(y - max(x)) for y in x) for x in s]
        out[r.doc_id] = (langs[main], sum(p * len(w) for p, (_, w) in zip(share, words)) / sum(len(w) for _, w in words))
    return out


def test_whole_table_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_predictions(docs.collect())
    got = langid.predict(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        assert r._lang == want[r.doc_id][0] and abs(r._score - want[r.doc_id][1]) < 1e-3, (r.doc_id, r._lang, r._score, want[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_scripts_narrow_the_candidates(frame):
    rows = [(i, "привет как дела у тебя сегодня", "ru", "s") for i in range(20)] + [(100 + i, "hello how are you today my friend", "en", "s") for i in range(20)]
    model = langid.train(frame(rows))
    assert model.predict("дом hello")[2] and model.predict("абвгд")[0] == "ru" and model.predict("zzz")[0] == "en"
    assert model.predict("漢字")[0] in ("en", "ru")  # no language has the script: all are candidates


def test_odd_rows(odd):
    rows = langid.predict(odd).collect()
    assert len(rows) == odd.count()
    assert all(r._lang == "und" and r._score == 0 for r in rows if r.doc_id in (1, 2, 6))
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert langid.predict(odd.limit(0)).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(1, 0)).where("false").unionByName(odd)
    assert {r._lang for r in langid.identify(unlabelled, langid.train(odd.where("lang is null"))).collect()} == {"und"}


def test_a_text_is_sent_once_and_rows_leave_by_parts(frame):
    from types import SimpleNamespace

    from quillon.llm.common import PART

    table = frame([(i, f"hello how are you {chr(97 + i % 26) * 3}", "en", "s") for i in range(2 * PART + 9)])
    model = langid.train(table)
    plan = langid.identify(table, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in plan
    docs = pa.array([{"doc_id": i, "text": None if i % 7 == 0 else f"hello {i}"} for i in range(2 * PART + 9)])
    # a batch may be a slice of another
    batch = pa.RecordBatch.from_arrays([docs], names=["_doc"]).slice(3)
    got = list(langid._identified(SimpleNamespace(value=model), 1)(iter([batch])))
    assert [b.num_rows for b in got] == [PART, PART, 6]
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["_doc"] for r in rows] == docs.to_pylist()[3:]
    assert all((r["_lang"], r["_score"]) == model.predict(r["_doc"]["text"])[:2] for r in rows)
