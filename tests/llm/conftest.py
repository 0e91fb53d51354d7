import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _key long, _gone string, tag string, id string, rate double, hash long, _lang string"


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text, lang, source), with further columns whose names clash with the operators' own."""

    def make(rows):
        full = [(d, t, lang, s, None if t is None else len(t), "x", 1, "y", "z", "w", 0.5, 2, "v") for d, t, lang, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd(frame):
    """Nulls, empty and long texts, repeated rows and ids, ties."""
    return frame([
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "alpha beta\ngamma " * 20, "en", None), (3, "alpha beta\ngamma " * 20, "en", None), (4, "alpha beta\ngamma " * 20, None, "b"),
        (None, "alpha beta\ngamma " * 20, "en", "c"), (None, None, None, None), (5, "\u00e9t\u00e9 \U0001f600 " * 30_000, "fr", "a"), (5, "other text of one id", "en", "b"), (6, " \n\t\n", "en", "a"),
    ])


@pytest.fixture
def benchmark(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "item_id long, text string, h long, words string")

    return make
