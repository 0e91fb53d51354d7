import random
from collections import Counter

from quillon.llm import nearcopies


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Groups under all pairs of Jaccard similarity 0.8 or more, exactly."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s or {None} for j in where[x] if j > i).items():
            if not s or 5 * k >= 4 * len(s | sets[j]):
                root[top(i)] = top(j)
    out = {}
    for i in range(len(texts)):
        out.setdefault(top(i), set()).add(i)
    return sorted(map(sorted, out.values()))


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.root, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_whole_table_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    docs = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "doc_id long, text string")
    want = brute([r.text for r in rows])
    assert len(want) < len(rows)
    for hot in (2, nearcopies.HOT):
        assert grouped(nearcopies.groups(docs, hot).collect()) == want


def test_stage_drops_what_simhash_misses(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = {rows[min(g)].doc_id for g in brute([r.text for r in rows])}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_chains_in_crowded_keys(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(3):
        now = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for _ in range(60):  # a walk: its ends are far apart, each step is near
            for _ in range(rnd.randint(1, 4)):
                now[rnd.randrange(len(now))] = f"w{rnd.randrange(10**6)}"
            texts.append(" ".join(now))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (2, 10, 10_000):
        assert grouped(nearcopies.groups(docs, hot).collect()) == brute(texts), hot


def test_pairs_at_the_threshold(spark):
    """Of pairs at a similarity of 0.8 to 0.82, no closer, hardly one is missed."""
    rnd, texts = random.Random(8), []
    while len(texts) < 800:
        a = [f"v{rnd.randrange(10**7)}" for _ in range(rnd.randint(180, 300))]
        b = list(a)
        at = rnd.randrange(10, len(a) - 100)
        while 5 * len(shingles(" ".join(a)) & shingles(" ".join(b))) > 4.1 * len(shingles(" ".join(a)) | shingles(" ".join(b))):
            b[at] = f"x{rnd.randrange(10**7)}"
            at += 1
        if 5 * len(shingles(" ".join(a)) & shingles(" ".join(b))) >= 4 * len(shingles(" ".join(a)) | shingles(" ".join(b))):
            texts += [" ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(len(g) == 2 for g in grouped(nearcopies.groups(docs).collect())) >= 0.99 * len(texts) / 2


def test_odd_rows(odd):
    kept = nearcopies.dedup(odd)
    assert kept.columns == odd.columns
    # nulls, empties and blanks are one group, the copies of 3 another; both texts of id 5 are on their own
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 5]
    assert nearcopies.dedup(odd.limit(0)).count() == 0
