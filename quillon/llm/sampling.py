"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words (ASCII case folded, between ASCII white
space) with their counts. For each of K samples every word has gamma, gamma
and uniform variates that depend on the word and the sample alone; with them
each word of weight w draws a level t and a value, and the word of the least
value is the sample, with its level. Two texts have equal samples with a
probability that is their generalised Jaccard similarity: the sum of smaller
weights over the sum of larger ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID

#: Samples of a fingerprint; each is published with 16 bits.
SAMPLES = 64
#: Texts that are worked on together, and how many characters they may have before the last one.
TOGETHER, CHARS = 256, 4 << 20
#: Words whose variates are held at once: a kilobyte each.
TERMS = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def variates(terms: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and ln c, with r and c from Gamma(2, 1), and beta from Uniform(0, 1), each [terms, samples].

    In single precision, and by blocks that stay in cache: these take most of the time.
    """
    seeds = _mix(np.arange(1, samples + 1, dtype=np.uint64) * _STEP)
    r, log_c, beta = (np.empty((len(terms), samples), dtype=np.float32) for _ in range(3))

    def uniforms(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers inside (0, 1) from each 64 bits."""
        u = (z.view(np.uint32) >> np.uint32(9)).astype(np.float32)
        u += np.float32(0.5)
        u *= np.float32(2.0**-23)
        return u[:, 0::2], u[:, 1::2]

    for at in range(0, len(terms), 128):
        block = slice(at, at + 128)
        z = _mix(terms[block, None] ^ seeds[None, :])
        a, b = uniforms(z)
        np.negative(np.log(a * b), out=r[block])
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        a, b = uniforms(z)
        np.log(-np.log(a * b), out=log_c[block])
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        beta[block] = uniforms(z)[0]
    return r, log_c, beta


def weights(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the text's words, by hash."""
    count = Counter(text.encode("utf-8").lower().split())
    terms = np.fromiter(map(xxhash.xxh64_intdigest, count), dtype=np.uint64, count=len(count))
    order = np.argsort(terms)
    return terms[order], np.fromiter(count.values(), dtype=np.float32, count=len(count))[order]


def _table(terms: np.ndarray, samples: int) -> tuple[np.ndarray, ...]:
    """The terms' variates, and the values of words of weight one: their level is zero."""
    r, log_c, beta = variates(terms, samples)
    return r, log_c, beta, log_c - r * (1 - beta)


def _least(terms: np.ndarray, w: np.ndarray, rows: np.ndarray, table: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """For each sample the least value over the terms, which are at these rows of the table, its term and its level."""
    r, log_c, beta, once = table
    values, column = once[rows], np.arange(once.shape[1])
    more = np.flatnonzero(w > 1)
    rm = r[rows[more]]
    level = np.floor(np.log(w[more])[:, None] / rm + beta[rows[more]])
    values[more] = log_c[rows[more]] - rm * (level - beta[rows[more]] + 1)
    at = values.argmin(axis=0)
    levels = np.zeros(len(column), dtype=np.int64)
    place = np.full(len(terms), -1)
    place[more] = np.arange(len(more))
    has = place[at] >= 0
    levels[has] = level[place[at][has], column[has]].astype(np.int64)
    return values[at, column], terms[at], levels


def _published(found: tuple[np.ndarray, ...]) -> np.ndarray:
    _, terms, levels = found
    drawn = (_mix(terms + _STEP * levels.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    drawn[0] |= 1  # so that no text with words has zeros only
    return drawn


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """[texts, samples] of 16-bit samples. A text without words has zeros throughout, which no other text has.

    Texts share a table of variates as long as they have TERMS words together;
    a text with more is read by blocks of its words.
    """
    sets = [weights(t) for t in texts]
    out = np.zeros((len(texts), samples), dtype=np.uint16)
    begin = 0
    while begin < len(sets):
        end, n = begin + 1, len(sets[begin][0])
        while end < len(sets) and n + len(sets[end][0]) <= TERMS:
            n += len(sets[end][0])
            end += 1
        if n > TERMS:
            terms, w = sets[begin]
            best: tuple[np.ndarray, ...] | None = None
            for lo in range(0, n, TERMS // 4):
                part = terms[lo : lo + TERMS // 4]
                found = _least(part, w[lo : lo + TERMS // 4], np.arange(len(part)), _table(part, samples))
                best = found if best is None else tuple(np.where(found[0] < best[0], x, y) for x, y in zip(found, best))
            out[begin] = _published(best)
        elif n:
            every, rows = np.unique(np.concatenate([t for t, _ in sets[begin:end]]), return_inverse=True)
            table, at = _table(every, samples), 0
            for i in range(begin, end):
                terms, w = sets[i]
                if len(terms):
                    out[i] = _published(_least(terms, w, rows[at : at + len(terms)], table))
                at += len(terms)
        begin = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples of each two rows."""
    return (a == b).mean(axis=-1)


def edited(text: str, after: str) -> str:
    """text with its last quarter of code points replaced by the first as many of after."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


_OUT = "doc_id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and id, each bucket's last being the first of the next one. Each row but that is paired with the one after it."""
    bucket, last, held, chars = None, None, [], 0

    def flush() -> pa.RecordBatch:
        texts = [t for _, t, _ in held]
        others = [edited(t, a) for _, t, a in held]
        both = signatures(texts + others + [held[-1][2]])
        n = len(held)
        own, changed = both[:n], both[n : 2 * n]
        follow = [a for _, _, a in held]
        # the next text's signature: mostly that of the row after it
        nexts = np.empty_like(own)
        for i in range(n):
            nexts[i] = both[-1] if i == n - 1 else own[i + 1] if follow[i] == texts[i + 1] else signatures([follow[i]])[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if i == NO_ID else i for i, _, _ in held], pa.int64()), pa.array(texts, pa.string()), pa.array(others, pa.string()),
                pa.array(map(_hex, own), pa.string()), pa.array(map(_hex, changed), pa.string()),
                pa.array(likeness(own, changed)), pa.array(likeness(own, nexts)),
            ],
            names=["doc_id", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for b in batches:
        for k, extra, i, text in zip(*(b.column(c) for c in range(4))):
            k, extra, i, text = k.as_py(), extra.as_py(), i.as_py(), text.as_py()
            if k != bucket:
                bucket, last = k, None
            if last is not None:
                held.append((*last, text))
                chars += len(last[1])
            last = None if extra else (i, text)
            if len(held) >= TOGETHER or chars >= CHARS:
                yield flush()
                held, chars = [], 0
    if held:
        yield flush()


def against_neighbours(documents: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows go by doc_id (null ids last, rows of one id by their texts' hash),
    the first follows the last, and a lone row follows itself. A null text
    is empty. Texts are dealt out once, by ranges of ids, and each task gets
    ranges that follow each other; the first row of each range is also sent to
    the range before. An id that fills several ranges by itself, as null may,
    is cut by its texts' hashes.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    docs = docs.withColumn("_x", F.col("id").cast("double"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    cuts = docs.approxQuantile("_x", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    bounds = sorted(set(cuts))
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_x", outputCol="_b")
    docs = (cut.transform(docs) if bounds else docs.withColumn("_b", F.lit(0.0))).withColumn("_b", F.col("_b").cast("int"))
    within = F.lit(0)
    for n, v in enumerate(bounds, 1):
        times, own = cuts.count(v), NO_ID if v >= 2.0**63 else int(v)
        if times > 1 and (abs(v) < 2**53 or own == NO_ID):  # ids that a double can tell apart
            share = F.least(F.floor((F.col("tag") / F.lit(2.0**64) + 0.5) * times), F.lit(times - 1)).cast("int")
            inside = F.when(F.col("id") < own, 0).when(F.col("id") == own, 1 + share).otherwise(times + 1)
            within = F.when(F.col("_b") == n, inside).otherwise(within)
    docs = docs.withColumn("bucket", F.col("_b") * (ranges + 2) + within)
    # one row for each range, whose number the session's setting bounds
    first = sorted((r["bucket"], r["f"]["id"], r["f"]["tag"]) for r in docs.groupBy("bucket").agg(F.min(F.struct("id", "tag")).alias("f")).collect())
    place = [n * parts // len(first) for n in range(len(first))]
    rows = [(b, i, t, place[n], first[n - 1][0], place[n - 1]) for n, (b, i, t) in enumerate(first)]
    firsts = spark.createDataFrame(rows, "fb int, fid long, ftag long, place int, before int, before_place int")
    docs = docs.join(F.broadcast(firsts), F.col("bucket") == F.col("fb"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"), F.col("place"))
    more = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"), F.col("before_place").alias("place"))
    is_first = (F.col("id") == F.col("fid")) & (F.col("tag") == F.col("ftag"))
    docs = docs.select("id", "tag", "text", F.explode(F.when(is_first, F.array(own, more)).otherwise(F.array(own))).alias("_p"))
    docs = docs.select("_p.bucket", "_p.extra", "_p.place", "id", "tag", "text")
    docs = docs.repartitionById(parts, F.col("place")).sortWithinPartitions("bucket", "extra", "id", "tag")
    return docs.select("bucket", "extra", "id", "text").mapInArrow(_pairs, _OUT)
