import corpus_pipeline
from quillon.llm.common import stored, table

from .test_nearcopies import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    before, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    from quillon.llm import decontaminate

    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, DATA), f"test-{name}")
        now = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= ids
        if name != "mixing":
            assert after.schema.names == docs.schema.names
        if name == "near_dedup":
            rows = before.orderBy("doc_id").collect()
            assert {rows[min(g)].doc_id for g in brute([r.text for r in rows])} == set(now)
        if name == "decontamination":
            left = decontaminate.contamination(after, table(spark, DATA, "benchmark")).where("n_items > 1").count()
            gone = {r.doc_id for r in decontaminate.contamination(before, table(spark, DATA, "benchmark")).where("contaminated").collect()}
            assert left == 0 and gone == ids - set(now)
        before, ids = after, set(now)


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 50 and {"doc_id", "text", "rate", "copies"} <= set(out.columns)


def through(spark, docs):
    """Each stage's rows, by name."""
    made, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = stored(stage(spark, before, DATA), f"odd-{name}")
        made[name] = before
    return made


def test_odd_rows_through_all_stages(spark, odd, frame):
    """Null, empty and blank texts go for want of a language, of repeats one row stays, clashing columns keep their values."""
    plain = table(spark, DATA, "documents").where("lang = 'en' and n_chars between 100 and 5000").select("doc_id", "text", "lang", "source").collect()
    long = " ".join(r.text for r in plain)
    rows = [(1_000_000 + i, r.text, r.lang, r.source) for i, r in enumerate(plain)] + [(2_000_000, long, "en", None), (2_000_000, long, "en", None), (None, long, None, None), (2_000_001, " ".join(reversed(long.split())), None, "far")]
    docs = odd.unionByName(frame(rows))
    made = through(spark, docs)
    for name, df in made.items():
        assert df.columns[: len(docs.columns)] == docs.columns or name == "mixing"
        assert set(docs.columns) <= set(df.columns)
        assert all(r._doc == "x" and r._key == 1 and r._gone == "y" and r.tag == "z" and r.id == "w" and r.hash == 2 and r._lang == "v" for r in df.collect())
    ids = lambda name: [r.doc_id for r in made[name].select("doc_id").collect()]
    texts = lambda name: [r.text for r in made[name].select("text").collect()]
    assert all(t and t.strip() for t in texts("language_id")) and {1, 2, 6}.isdisjoint(ids("language_id"))
    assert len(ids("line_dedup")) == len(ids("language_id"))
    assert ids("language_id").count(2_000_000) == 2 and ids("near_dedup").count(2_000_000) == 1 and None not in ids("near_dedup")
    assert ids("language_id").count(3) == 2 and ids("near_dedup").count(3) == 1 and 4 not in ids("near_dedup")
    assert len(set(texts("near_dedup"))) == len(texts("near_dedup"))
    assert set(ids("mixing")) <= set(ids("decontamination")) <= set(ids("near_dedup"))
    assert all(r.rate > 0 and r.copies >= 0 for r in made["mixing"].collect())


def test_empty_and_all_null_tables(spark, frame):
    empty = frame([(1, "a text", "en", "s")]).limit(0)
    for docs in (empty, frame([(None, None, None, None), (None, None, None, None), (7, None, None, None)])):
        assert [df.count() for df in through(spark, docs).values()] == [0] * 5
    nulls = frame([(None, None, None, None), (None, "", None, None), (7, None, None, None)])
    assert corpus_pipeline.line_dedup(spark, nulls, DATA).count() == 3
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, nulls, DATA).collect()] == [7]
    assert corpus_pipeline.benchmark_decontamination(spark, nulls, DATA).count() == 3
    assert corpus_pipeline.source_mixing(spark, nulls, DATA).count() <= 3
