import re

from quillon.llm import common, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        b = words(t)
        n = min(8, len(b))
        if not n:
            continue
        wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(i)
    return len(w), len(hit), len(found), sorted(str(i) for i in found if i is not None)


ITEMS = [(1, "one two three four five six seven eight nine"), (2, "Lone"), (3, "a b c"), (4, None), (None, "ghost words here"), (5, ""), (12, "one two three four five six seven eight nine"), (7, "\u00c9t\u00e9 na\u00efve 5G")]


def test_against_brute_force(frame, benchmark):
    texts = [
        "x One, two-three four five six seven eight NINE y", "lone lone", "a b c a b c", "a-b.c lone", "\u00e9t\u00e9 na\u00efve 5g", "\u00c9t\u00e9 NA\u00efVE 5g", "two three four five six seven eight nine ten", None, "", "...",
        "ghost words here", "w " * 40_000 + "a b c",
    ]
    docs = frame([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in decontaminate.contamination(docs, benchmark(ITEMS)).collect()}
    assert got == {i: brute(t, ITEMS) for i, t in enumerate(texts)}


def test_odd_rows(odd, benchmark):
    found = decontaminate.contamination(odd, benchmark([(1, "alpha beta gamma alpha"), (2, "beta gamma")])).collect()
    assert len(found) == odd.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.contaminated))
    assert by[3] == [(60, 60, 2, True)] * 2 and by[4] == [(60, 60, 2, True)] and sorted(by[None]) == [(0, 0, 0, False), (60, 60, 2, True)]
    assert by[1] == [(0, 0, 0, False)] and len(by[5]) == 2


def test_removal(odd, frame, benchmark):
    kept = decontaminate.decontaminate(odd, benchmark([(1, "alpha beta gamma alpha"), (2, "beta gamma"), (3, "other text")]))
    assert kept.columns == odd.columns
    rows = {(r.doc_id, r.text is None): r for r in kept.collect()}
    assert not any(r.text and "alpha" in r.text for r in rows.values())
    assert rows[5, False] is not None and {r.text for r in kept.where("doc_id = 5 and n_chars < 100").collect()} == {"  of one id"}


def test_empty(frame, benchmark):
    docs = frame([(1, "a b", "en", "s")])
    assert [(r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, benchmark([])).collect()] == [(2, 0, 0)]
    assert decontaminate.contamination(docs.limit(0), benchmark([(1, "a b")])).count() == 0
    assert decontaminate.decontaminate(docs, benchmark([])).count() == 1


def test_without_any_broadcast(spark, frame, benchmark, odd, monkeypatch):
    """A benchmark beyond the broadcast's bound: the same rows, and neither words nor texts of windows in a shuffle."""
    docs, items = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = lambda d, b: sorted(map(repr, decontaminate.contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()))
    mine = benchmark([(1, "alpha beta gamma alpha"), (2, "beta gamma")])
    before = rows(docs, items), rows(odd, mine), sorted(map(repr, decontaminate.decontaminate(docs, items).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert (rows(docs, items), rows(odd, mine), sorted(map(repr, decontaminate.decontaminate(docs, items).collect()))) == before
    light = decontaminate._candidates(docs, [8], []).select("id", "_key", "_pos", "_len", "_wh0").repartition("_wh0")
    sent = light._jdf.queryExecution().optimizedPlan().output().mkString(",")
    assert [x.partition("#")[0] for x in sent.split(",")] == ["id", "_key", "_pos", "_len", "_wh0"]
