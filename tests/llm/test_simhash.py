import random

import numpy as np
import xxhash

from quillon.llm import simhash

DATA = "/root/testdata/sf0.001"


def brute(texts):
    out = []
    for t in texts:
        raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        for c in "\t\n\x0b\x0c\r":
            raw = raw.replace(c, " ")
        w = [x for x in raw.split(" ") if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    return out


def label(ids, prints):
    p = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 3
    comp = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            m = min(comp[j] for j in np.flatnonzero(near[i]))
            if m < comp[i]:
                comp[i], changed = m, True
    return {ids[i]: min(ids[j] for j in range(len(ids)) if comp[j] == comp[i]) for i in range(len(ids))}


def test_golay_is_perfect():
    errors, count = simhash.golay()
    assert set(count.tolist()) == {1, 6}
    weights = np.bitwise_count(errors[:, 0].astype(np.uint64))
    assert weights.max() == 3 and (weights == 3).sum() == 1771


def test_fingerprints_within_three_bits_share_a_key():
    rnd = random.Random(1)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randint(0, 3)):
            y ^= 1 << b
        ask = set(simhash.keys(np.array([x], dtype=np.uint64), True)[1].tolist())
        answer = set(simhash.keys(np.array([y], dtype=np.uint64), False)[1].tolist())
        assert ask & answer


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in simhash.classes(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    prints = brute([texts[i] for i in ids])
    assert [rows[i].fp % 2**64 for i in ids] == prints
    assert {i: rows[i].component_id for i in ids} == label(ids, prints)


def test_hot_keys_lose_no_link(spark):
    rnd = random.Random(2)
    centre = rnd.getrandbits(64)
    prints = {centre}
    while len(prints) < 80:
        x = rnd.choice(sorted(prints))
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rnd.getrandbits(64) for _ in range(40)}
    signed = np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    from quillon.llm.components import components

    want = label(signed, [x % 2**64 for x in signed])
    for hot in (2, 10_000):
        got = {r.node: r.root for r in components(simhash.links(frame, hot)).collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "a b c d", 7), (3, "a b c d", 7), (None, "a b c d", 8), (4, "A  b\tc\nd", 9), (5, "word " * 50_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumnRenamed("fp", "component_id")
    got = sorted((r.doc_id or 0, r.fp, r.component_id) for r in simhash.classes(docs).collect())
    assert [(a, c) for a, _, c in got if a != 5] == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    assert got[1][1] == 0
    kept = simhash.dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5] and kept.columns == docs.columns
    assert simhash.classes(docs.limit(0)).count() == 0


def test_hot_keys_count_every_link(spark):
    rnd = random.Random(4)
    prints = {rnd.getrandbits(64) for _ in range(2)}
    while len(prints) < 120:
        x = rnd.choice(sorted(prints))
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            x ^= 1 << b
        prints.add(x)
    p = np.array(sorted(prints), dtype=np.uint64)
    want = dict(zip(p.view(np.int64).tolist(), ((np.bitwise_count(p[:, None] ^ p[None, :]) <= 3).sum(axis=1) - 1).tolist()))
    frame = spark.createDataFrame([(x,) for x in want], "fp long")
    for hot in (2, 10, 10_000):
        met, members = simhash._met(frame, hot)
        assert (members is None) == (hot == 10_000)
        got = {r.dfp: r.n for r in simhash.degrees(met, members).collect()}
        assert {x: got.get(x, 0) for x in want} == want, hot


def test_dense_cubes_count_every_link(spark):
    rnd = random.Random(6)
    for size, free in ((200, 8), (400, 10), (400, 12)):
        base, bits = rnd.getrandbits(64), rnd.sample(range(64), free)
        cube = [base ^ sum(1 << b for i, b in enumerate(bits) if x >> i & 1) for x in rnd.sample(range(1 << free), size)]
        p = np.array(sorted(cube), dtype=np.uint64)
        near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 3
        signed = p.view(np.int64).tolist()
        frame = spark.createDataFrame([(x,) for x in signed], "fp long")
        for hot in (2, simhash.HOT):
            got = {r.dfp: r.n for r in simhash.degrees(*simhash._met(frame, hot)).collect()}
            assert [got.get(x, 0) for x in signed] == (near.sum(axis=1) - 1).tolist(), (size, free, hot)


def test_components_of_null_ids_stay_apart(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "quite another text is here"), (7, "one of id seven"), (7, "and some other words")]
    kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})


def test_rows_made_of_fingerprints_are_not_broadcast(spark):
    from quillon.llm.common import stored

    rnd = random.Random(8)
    centre = rnd.getrandbits(64)
    prints = {centre ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)} | {rnd.getrandbits(64) for _ in range(50)}
    signed = np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist()
    # a stored table of known size, small enough for Spark to broadcast
    frame = stored(spark.createDataFrame([(x,) for x in signed], "fp long"), "prints")
    for hot in (2, 10_000):
        met, members = simhash._met(frame, hot)
        assert (members is None) == (hot == 10_000)
        made = [simhash.links(frame, hot)] if members is None else [simhash.ball_links(members), simhash._counted(members)]
        for df in made:
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan
