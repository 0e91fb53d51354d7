"""Language identification of mixed text.

Words are runs of letters. The script of a word's first letter narrows its
candidate languages to those learned with that script; counts of letter pairs
and triples score the word in each. A Viterbi search over the words, with a
penalty for each switch of language, labels spans of the text.

What is learned are counts over all labelled documents: fixed-size tables
that each task fills and Spark adds up. One row for each language reaches the
driver, one after another, however many documents there are; the model takes
half a megabyte a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import of, packed, parts, place_of, unpacked

BUCKETS = 1 << 16
#: First code points of script ranges (fixed values, by Unicode block), and names.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other2"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other3"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "symbols"), (0x2C80, "other4"), (0x3040, "kana"),
    (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other5"), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other6"), (0x20000, "han"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = list(dict.fromkeys(n for _, n in SCRIPTS))
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 1e-3
#: Nats that a switch of language costs, and the score of a language that is no candidate for a word.
SWITCH, NEVER = 20.0, -1e6
#: More languages than this are an error: the model would no longer be small.
LANGUAGES = 512
SMOOTH = 0.5
UNKNOWN = "und"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points up to 0xFFFF: whether it is a letter; its lower case where that is one such code point."""
    chars = [chr(c) for c in range(0x10000)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 and ord(x) < 0x10000 else ord(c) for c in chars], dtype=np.uint32)
    return np.array([c.isalpha() for c in chars]), lower


@dataclass
class Words:
    """A text's words: starts and ends in code points, where each begins among the letters, scripts, and the letters' feature buckets."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    script: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray


def words_of(text: str) -> Words | None:
    letters, lower = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = np.minimum(points, 0xFFFF)
    is_letter, folded = letters[low], lower[low]
    if len(points) and points.max() > 0xFFFF:
        for c in np.unique(points[points > 0xFFFF]).tolist():
            is_letter[points == c] = c < 0x110000 and chr(c).isalpha()
            folded[points == c] = c
    if not is_letter.any():
        return None
    edge = np.diff(np.concatenate(([0], is_letter.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # the letters with one zero between words
    where = np.flatnonzero(is_letter)
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(where)) + np.repeat(np.arange(1, len(start) + 1), size)
    line = np.zeros(len(where) + len(start) + 1, dtype=np.uint64)
    line[place] = folded[where]
    a, b, c = line[place - 1], line[place], line[place + 1]
    pairs = (b * np.uint64(0x9E3779B1) + c * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)
    triples = (a * np.uint64(0x27D4EB2F) + b * np.uint64(0x9E3779B1) + c * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)
    script = _SCRIPT[np.searchsorted(_STARTS, points[start], side="right") - 1]
    return Words(start, end, at, script, pairs.astype(np.int64), triples.astype(np.int64))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # [2 * BUCKETS, languages]: half the log probabilities of pairs, then of triples
    fits: np.ndarray  # [scripts, languages]

    def scores(self, w: Words) -> np.ndarray:
        """[words, languages]: log likelihoods of each word's candidates, the languages of its script; of all, if none has the script."""
        size = np.diff(np.append(w.at, len(w.pairs)))
        out = np.full((len(w.at), len(self.langs)), NEVER)
        for script in np.unique(w.script).tolist():
            own = np.flatnonzero(self.fits[script])
            own = own if len(own) else np.arange(len(self.langs))
            mine = w.script == script
            letters = slice(None) if mine.all() else np.repeat(mine, size)
            at = np.cumsum(size[mine]) - size[mine]
            pairs, triples = w.pairs[letters], BUCKETS + w.triples[letters]
            every = len(own) == len(self.langs)
            scored = self.table[pairs] + self.table[triples] if every else self.table[np.ix_(pairs, own)] + self.table[np.ix_(triples, own)]
            out[np.ix_(mine, own)] = np.add.reduceat(scored, at, axis=0)
        return out

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """Main language, score and spans. The main language labels most letters (ties: the first by name); the score is its mean posterior over letters, word by word."""
        w = words_of(text or "") if self.langs else None
        if w is None:
            return UNKNOWN, 0.0, []
        s = self.scores(w)
        path = viterbi(s)
        size = w.end - w.start
        letters = np.bincount(path, weights=size, minlength=len(self.langs))
        main = int(letters.argmax())
        p = np.exp(s - s.max(axis=1, keepdims=True))
        score = float((p[:, main] / p.sum(axis=1) * size).sum() / size.sum())
        cut = np.flatnonzero(np.diff(path)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(path)])) - 1
        spans = [(self.langs[path[i]], int(w.start[i]), int(w.end[j])) for i, j in zip(first, last)]
        return self.langs[main], min(1.0, max(0.0, score)), spans


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path through s [words, languages]; ties take the first language, and stay.

    Most texts have one language throughout, and need no search: if no run of
    words gains more than half a switch by any other language, then no path
    with p > 1 pieces, each gaining that much at most, makes up for its p - 1
    or more switches.
    """
    n, k = s.shape
    best = int(s.sum(axis=0).argmax())
    gain = np.concatenate((np.zeros((1, k)), np.cumsum(s - s[:, [best]], axis=0)))
    if ((gain - np.minimum.accumulate(gain, axis=0)).max(axis=0) <= switch / 2).all():
        return np.full(n, best)
    back = np.empty((n, k), dtype=np.int64)
    v, stay = s[0].copy(), np.arange(k)
    for t in range(1, n):
        top = int(v.argmax())
        moved = v[top] - switch > v
        back[t] = np.where(moved, top, stay)
        v = np.where(moved, v[top] - switch, v) + s[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = v.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column(0), b.column(1)):
            if w := words_of(text.as_py()):
                t = tables.setdefault(lang.as_py(), np.zeros(2 * BUCKETS + len(_NAMES), dtype=np.int64))
                t[:BUCKETS] += np.bincount(w.pairs, minlength=BUCKETS)
                t[BUCKETS : 2 * BUCKETS] += np.bincount(w.triples, minlength=BUCKETS)
                t[2 * BUCKETS :] += np.bincount(w.script, weights=w.end - w.start, minlength=len(_NAMES)).astype(np.int64)
    for lang, t in tables.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])], names=["lang", "bucket", "n"])


def _dense(table: pa.Table) -> pa.Table:
    """A language's counts as one row of bytes."""
    counts = np.zeros(2 * BUCKETS + len(_NAMES), dtype=np.int64)
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([counts.tobytes()], pa.binary())})


def train(labelled: DataFrame) -> Model:
    """From (text, lang); rows with a null in either teach nothing. All rows count. More than LANGUAGES languages are an error."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null").mapInArrow(_count, "lang string, bucket int, n long")
    sums = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    learned: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in sums.groupBy("lang").applyInArrow(_dense, "lang string, counts binary").toLocalIterator():
        if len(learned) == LANGUAGES:
            raise ValueError(f"over {LANGUAGES} languages are labelled")
        counts = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
        halves = counts[: 2 * BUCKETS].reshape(2, BUCKETS)
        logs = 0.5 * np.log((halves + SMOOTH) / (halves.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS))
        scripts = counts[2 * BUCKETS :]
        learned[r["lang"]] = logs.reshape(-1).astype(np.float32), scripts >= SCRIPT_SHARE * scripts.sum()
    langs = sorted(learned)
    if not langs:
        return Model([], np.zeros((2 * BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    return Model(langs, np.stack([learned[x][0] for x in langs], axis=1), np.stack([learned[x][1] for x in langs], axis=1))


def held_out(doc_id: Column) -> Column:
    """The documents that teach nothing: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _identified(shared, place: int):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts in parts(batches, place):
            found = [shared.value.predict(t.as_py()) for t in texts]
            spans = pa.array([[{"lang": x, "start": i, "end": j} for x, i, j in f[2]] for f in found], kind)
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans]
            yield pa.RecordBatch.from_arrays([docs, *new], names=["_doc", "_lang", "_score", "_spans"])

    return run


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of documents: _doc (all its columns), _lang, _score, _spans (array of lang, start, end in code points).

    A text that is null, empty or without letters has language und, score 0
    and no spans; so has every text if nothing was learned.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = packed(documents)
    span = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([rows.schema["_doc"], T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_spans", span)])
    return rows.mapInArrow(_identified(shared, place_of("text", documents)), schema)


def predict(documents: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out, and identifies all: doc_id, held_out, _lang, _score, _spans."""
    model = train(documents.where(~held_out(F.col("doc_id"))))
    found = identify(documents.select("doc_id", "text"), model)
    return found.select(of("doc_id").alias("doc_id"), held_out(of("doc_id")).alias("held_out"), "_lang", "_score", "_spans")


def keep_identified(documents: DataFrame, min_score: float = 0.3) -> DataFrame:
    """documents whose language is known, with a score of min_score at least; all columns stay."""
    model = train(documents.where(~held_out(F.col("doc_id"))))
    found = identify(documents, model)
    return unpacked(found.where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= min_score)), documents)
