"""Mixing sources to target weights with soft membership.

A classifier fitted on the labelled table gives each document posteriors of
the domains. Rates, one for each document and none negative, are chosen so
that the expected tokens of each domain, sum(rate * tokens * posterior), meet
the targets in the least-squares sense, from rates of one on: projected
gradient steps, each one aggregation in Spark. Misses are weighed by the
inverse of the domains' second moments, so that a scarce domain's target is
met as closely, and as soon, as an ample one's.

Posteriors are whole ten-thousandths. Documents with equal posteriors have
equal rates at every step, so the steps run on one row for each posterior that
occurs; their number is bounded by the grid, not by the data. A document's
rate follows from its posteriors and the steps' residuals alone. What the
rounding of posteriors moves is tested to be under a hundredth of each target.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, of, packed, small, stored

DOMAINS = ("good", "poor", "toxic")
#: Shares of the token budget.
TARGETS = {"good": 0.84, "poor": 0.15, "toxic": 0.01}
#: The labelled sample: at most so many rows, those of the smallest hashes.
TRAIN_ROWS = 20_000
#: Words in the lexicon, and how many labelled documents must hold one.
LEXICON, LEAST = 100, 5
GRID = 10_000
#: Steps at most; they end once all misses are under this share of their targets, or no longer change.
STEPS, CLOSE = 60, 1e-4
#: The state is written after so many steps.
KEEP = 10
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-")
SHAPES = 7


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """What a text looks like: shares of signs, capitals, digits and of distinct words, sizes of words, lines and text."""
    n = max(1, len(text))
    share = lambda kind: (len(text) - len(text.translate(None, kind))) / n
    k = max(1, len(words))
    return [min(1.0, 10 * share(_SIGNS)), share(_UPPER), share(_DIGITS), len(set(words)) / k, sum(map(len, words)) / k / 10, np.log1p(k) / 10, np.log1p(text.count(b"\n")) / 10]


@dataclass
class Classifier:
    lexicon: dict[bytes, int]
    weights: np.ndarray  # [words of the lexicon + SHAPES + 1, domains]

    def exact(self, text: str | None) -> tuple[int, np.ndarray]:
        """Tokens and the domains' posteriors."""
        raw = (text or "").encode("utf-8")
        words = _WORD.findall(raw.lower())
        at = [self.lexicon[w] for w in set(words) & self.lexicon.keys()]
        dense = np.array([*shape(raw, words), 1.0])
        z = self.weights[at].sum(axis=0) + dense @ self.weights[len(self.lexicon) :]
        p = np.exp(z - z.max())
        return len(words), p / p.sum()

    def posterior(self, text: str | None) -> tuple[int, list[int]]:
        """Tokens, and ten-thousandths for each domain, which sum to GRID; ties of rounding go to the first domains."""
        n, p = self.exact(text)
        exact = p * GRID
        q = np.floor(exact).astype(int)
        q[np.argsort(q - exact, kind="stable")[: GRID - q.sum()]] += 1
        return n, q.tolist()


def _sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, y): the labelled sample. Rows with a null id, text or label teach nothing; of an id's labels the smallest counts."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.min(F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "y")
    return documents.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).where("text is not null").select("text", "y")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, y in zip(b.column(0), b.column(1)):
            words = sorted(set(_WORD.findall(text.as_py().encode("utf-8").lower())))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([y.as_py()] * len(words), pa.int32())], names=["word", "y"])


def _lexicon(sample: DataFrame) -> dict[bytes, int]:
    """The words whose share of documents differs most between one domain and the others."""
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    rows = sample.mapInArrow(_words, "word binary, y int")
    count = rows.groupBy("word").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("y") == k, 1)).alias(f"n{k}") for k in range(len(DOMAINS))])
    total, score = sum(sizes.values()), F.lit(0.0)
    for k in range(len(DOMAINS)):
        inside = (F.col(f"n{k}") + 0.5) / (sizes.get(k, 0) + 1.0)
        outside = (F.col("n") - F.col(f"n{k}") + 0.5) / (total - sizes.get(k, 0) + 1.0)
        score = F.greatest(score, F.log(inside / outside) * F.sqrt(F.col(f"n{k}").cast("double")))
    top = count.where(F.col("n") >= LEAST).withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "word").limit(LEXICON).select("word").collect()
    return {bytes(r["word"]): i for i, r in enumerate(top)}


def _features(lexicon: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, dense = [], []
            for t in b.column(0):
                raw = t.as_py().encode("utf-8")
                words = _WORD.findall(raw.lower())
                at.append(sorted(lexicon[w] for w in set(words) & lexicon.keys()))
                dense.append(shape(raw, words))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64())), b.column(1)], names=["at", "dense", "y"])

    return run


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, steps: int = 300) -> Classifier:
    """Softmax regression on a bounded sample of labelled rows; without any, all domains are equally likely."""
    sample = stored(_sample(documents, labels, rows), "labelled")
    lexicon = _lexicon(sample)
    got = sample.mapInArrow(_features(lexicon), "at array<int>, dense array<double>, y int").collect()  # rows at most
    weights = np.zeros((len(lexicon) + SHAPES + 1, len(DOMAINS)))
    if not got:
        return Classifier(lexicon, weights)
    got.sort(key=lambda r: (r["y"], r["at"], r["dense"]))
    x = np.zeros((len(got), len(weights)), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, r["at"]] = 1
        x[i, len(lexicon) : -1] = r["dense"]
    x[:, -1] = 1
    y = np.eye(len(DOMAINS), dtype=np.float32)[[r["y"] for r in got]]
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        z = x @ weights.astype(np.float32)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (p / p.sum(axis=1, keepdims=True) - y) / len(x) + 1e-3 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Classifier(lexicon, weights)


def with_posteriors(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """Per row of documents: _doc (all its columns), _tokens and _q, ten-thousandths for each domain."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)
    rows = packed(documents).select("_doc", of("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.posterior(t.as_py()) for t in b.column(1)]
            new = [pa.array([n for n, _ in found], pa.int64()), pa.array([q for _, q in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["_doc", "_tokens", "_q"])

    return rows.mapInArrow(run, T.StructType([rows.schema["_doc"]]).add("_tokens", T.LongType()).add("_q", T.ArrayType(T.IntegerType())))


def _moved(q: Column, r: Column, moves: list[list[float]], least: Column) -> Column:
    """The rate r after moves, each a step's weighed misses by domain: never below least."""
    if not moves:
        return r
    slope = lambda m: sum((F.get(m, F.lit(d)) * F.get(q, F.lit(d)) / GRID for d in range(len(DOMAINS))), F.lit(0.0))
    return F.aggregate(F.array(*[F.array(*map(F.lit, m)) for m in moves]), r, lambda now, m: F.greatest(least, now - slope(m)))


def solve(cells: DataFrame, targets: dict[str, float] | None = None, budget: float | None = 1.0, steps: int = STEPS, least: Column | None = None) -> DataFrame:
    """(_q, rate) of cells (_q, tokens): projected steps from rates of one on, rounded to six decimals.

    Each step is one aggregation that returns one row: the domains' totals,
    and the second moments of the posteriors over the rates that are off their
    bound, by whose inverse the misses are weighed. A step after which the
    misses have grown halves those that follow. The cells' state is written
    every KEEP steps, so that a step works off the few moves since. No rate
    falls below least, if given, or zero. The targets are shares of budget
    times all tokens, or without a budget of what the rates make.
    """
    k, bound = len(DOMAINS), F.lit(0.0) if least is None else least
    shares = np.array([(targets or TARGETS)[d] for d in DOMAINS])
    # misses are read @ totals - want
    read, want = (np.eye(k) - np.outer(shares, np.ones(k)), 0 * shares) if budget is None else (np.eye(k), budget * shares)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells.select("_q", "tokens", F.lit(1.0).alias("r"))
    moves: list[list[float]] = []
    length, best, last = 1.0, np.inf, None
    for step in range(steps if total else 0):
        if len(moves) == KEEP:
            old, state, moves = state, stored(state.select("_q", "tokens", _moved(F.col("_q"), F.col("r"), moves, bound).alias("r")), "rates"), []
            if step > KEEP:
                discard(old)
        now = state.select("tokens", "_q", _moved(F.col("_q"), F.col("r"), moves, bound).alias("r"), bound.alias("least"))
        share = [F.get("_q", F.lit(d)).cast("double") for d in range(k)]
        free = F.when(F.col("r") > F.col("least"), F.col("tokens")).otherwise(0)
        sums = now.agg(*[F.sum(F.col("tokens") * F.col("r") * share[d]) for d in range(k)], *[F.sum(free * share[a] * share[b]) for a in range(k) for b in range(k)]).first()
        got, moments = np.array(sums[:k]) / GRID / total, np.array(sums[k:]).reshape(k, k) / GRID**2 / total
        miss = read @ got - want
        worst = float(np.abs(miss / np.maximum(shares * (got.sum() if budget is None else budget), 1e-9)).max())
        if worst < CLOSE or last is not None and np.abs(miss - last).max() < 1e-9:
            break
        length, best, last = length / 2 if worst > best else length, min(best, worst), miss
        moves.append((length * read.T @ np.linalg.pinv(read @ moments @ read.T, rcond=1e-9, hermitian=True) @ miss).tolist())
    return state.select("_q", F.round(_moved(F.col("_q"), F.col("r"), moves, bound), 6).alias("rate"))


def _rated(found: DataFrame, rates: DataFrame) -> DataFrame:
    """found (_q, _chance and more) with _rate and _copies."""
    known = small(rates.select(F.col("_q").alias("_rq"), F.col("rate").alias("_rate")), rates.count(), 96)
    met = found.join(known, F.col("_q") == F.col("_rq"))
    return met.withColumn("_copies", F.floor(F.col("_rate") + F.col("_chance")).cast("bigint")).drop("_rq")


def _chance(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on id and text alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 11) / F.lit(float(1 << 53))


def _cells(lean: DataFrame) -> DataFrame:
    return stored(lean.groupBy("_q").agg(F.sum("_tokens").alias("tokens")).coalesce(4), "cells")


def _clean(q: Column) -> Column:
    """Whether no other domain is likelier than the first one, the clean one."""
    return F.get(q, F.lit(0)) >= F.array_max(q)


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """documents with a rate above zero, with rate, copies (how often each is to be read) and the posteriors; a column that has such a name already gives way.

    Documents that are likeliest clean have rates of one or more, whatever the
    budget; without one, the targets are shares of what the rates make.
    copies is the rate rounded up or down by chance, so that it is right on
    average; it can be zero where the rate is below one. A null or empty text
    has no tokens and moves no total. Without labels all domains are alike;
    without tokens all rates are one.
    """
    classifier = fit(documents, labels)
    found = with_posteriors(documents, classifier).withColumn("_chance", _chance(of("doc_id"), of("text")))
    found = stored(found, "rows-with-posteriors")  # whole rows, so that each text is read once after the fit
    cells = _cells(found.select("_tokens", "_q"))
    least = F.when(_clean(F.col("_q")), F.lit(1.0)).otherwise(F.lit(0.0))
    rates = stored(solve(cells, targets, budget, least=least), "rates")
    new = [F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), *_named()]
    taken = {"rate", "copies", *(f"p_{d}" for d in DOMAINS)}
    return _rated(found, rates).where("_rate > 0").select(*[of(c).alias(c) for c in documents.columns if c.lower() not in taken], *new)


def _named() -> list[Column]:
    return [(F.get("_q", F.lit(d)) / GRID).alias(f"p_{name}") for d, name in enumerate(DOMAINS)]


def summary(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """Per row of documents: doc_id, n_tokens, rate, copies and the posteriors, as :func:`mix` has them. Texts are read once after the fit."""
    classifier = fit(documents, labels)
    found = with_posteriors(documents.select("doc_id", "text"), classifier)
    found = stored(found.select(of("doc_id").alias("doc_id"), _chance(of("doc_id"), of("text")).alias("_chance"), "_tokens", "_q"), "posteriors")
    rates = stored(solve(_cells(found.select("_tokens", "_q")), targets, budget), "rates")
    return _rated(found, rates).select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), *_named())
