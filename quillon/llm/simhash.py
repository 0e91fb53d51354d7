"""Near-duplicate detection: SimHash fingerprints linked through Golay codes.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Of three
or fewer differing bits, some two segments have one at most each (two larger
counts would make four). The binary Golay code [23, 12, 7] is perfect: each
segment lies within three bits of exactly one codeword, its own; a neighbour
at one bit lies within four bits of that codeword. So

* a fingerprint asks with one key for each two segments: their own codewords;
* it answers to all pairs of codewords within four bits of its segments, one
  or six for each segment,

and two fingerprints that link always meet in a key. Candidates are verified
by counting bits. Equal fingerprints are one node, so copies are never paired.

Keys that many fingerprints ask with are left to :func:`ball_links`, which
connects the same fingerprints with a number of rows that grows with the
members only; their links are counted without being made (:func:`_counted`).

Keys have 24 bits and three pairs of segments, so N distinct fingerprints
that are spread evenly meet about 5 N**2 / 10**6 candidates: fewer than rows
up to some 10**7 fingerprints. Past 4 * 10**9 every key is crowded, and each
fingerprint becomes the 2,146 points of :func:`ball_links`, in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, dealt, one_of_each, small, stored
from .components import components

SEED = 42
MAX_BITS = 3
SHINGLE = 3
#: Widths of the segments, from the lowest bit up.
SEGMENTS = (22, 21, 21)
#: The Golay code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101
#: A key that more fingerprints ask with is dealt with by ball_links.
HOT = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's shingles, repeats included, as an unsigned number; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes, both go by ASCII alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are one where over half the hashes have a one."""
    ones, n = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: the error patterns of weight four at most (own codeword first; six columns) and their number."""
    patterns = [sum(1 << b for b in c) for k in range(5) for c in combinations(range(23), k)]
    errors, count = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for e, s in zip(patterns, syndromes(np.array(patterns, dtype=np.int64)).tolist()):
        errors[s, count[s]] = e
        count[s] += 1
    return errors, count


def syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of the 23-bit vectors v by the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within four bits of each v, its own first, in six columns; the number of columns that count."""
    errors, count = golay()
    s = syndromes(v)
    return (v[:, None] ^ errors[s]) >> 11, count[s]


def keys(prints: np.ndarray, ask: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys that each fingerprint asks with, or else answers to."""
    found, shift = [], 0
    for width in SEGMENTS:
        found.append(codewords((prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)))
        shift += width
    rows, out = [], []
    for pair, (a, b) in enumerate(combinations(range(3), 2)):
        (ca, na), (cb, nb) = found[a], found[b]
        for i in range(1 if ask else 6):
            for j in range(1 if ask else 6):
                at = np.flatnonzero((na > i) & (nb > j))
                rows.append(at)
                out.append(pair << 24 | ca[at, i] << 12 | cb[at, j])
    return np.concatenate(rows), np.concatenate(out)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], names=["doc_id", "tag", "fp"])

    return run


def _keys(ask: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(prints), 2048):
                part = prints[at : at + 2048]
                rows, key = keys(part, ask)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[rows].view(np.int64))], names=["key", "fp"])

    return run


def _ball(radii: tuple[int, ...]):
    masks = np.array([sum(1 << b for b in c) for r in radii for c in combinations(range(64), r)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(prints), 64):
                part = prints[at : at + 64]
                points = (part[:, None] ^ masks[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["point", "fp"])

    return run


def ball_links(prints: DataFrame) -> DataFrame:
    """(x, y): links that connect exactly what all links within three bits among prints (fp) would.

    Two fingerprints within three bits share a point within one bit of the
    one and two of the other. All that lie within two bits of a point link to
    the smallest that lies within one bit of it. No pairs are made.
    """
    near = prints.mapInArrow(_ball((0, 1)), "point long, fp long").groupBy(F.col("point").alias("p")).agg(F.min("fp").alias("x"))
    far = prints.mapInArrow(_ball((0, 1, 2)), "point long, fp long")
    return far.join(dealt(near), F.col("point") == F.col("p")).where("x <> fp").select("x", F.col("fp").alias("y")).distinct()


def _met(prints: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(x, y): all links among distinct fingerprints (fp) but those that only hot keys show; the hot keys' members (fp), if there are any."""
    ask = prints.mapInArrow(_keys(True), "key int, fp long")
    # each fingerprint becomes some 80 rows: Spark must not have merged them into a few tasks before
    answer = prints.repartition("fp").mapInArrow(_keys(False), "key int, fp long")
    many = stored(ask.groupBy(F.col("key").alias("hot")).count().where(F.col("count") > hot).select("hot"), "hot-keys")
    n = many.count()
    met = ask.select(F.col("key").alias("k"), F.col("fp").alias("x")).join(dealt(answer), F.col("k") == F.col("key"))
    met = met.where((F.col("x") < F.col("fp")) | (F.col("x") > F.col("fp"))).where(F.bit_count(F.col("x").bitwiseXOR(F.col("fp"))) <= MAX_BITS)
    if not n:
        return met.select("x", F.col("fp").alias("y")).distinct(), None
    rare = ask.join(small(many, n, 16), F.col("key") == F.col("hot"), "left_anti").select(F.col("key").alias("k"), F.col("fp").alias("x"))
    met = rare.join(dealt(answer), F.col("k") == F.col("key")).where("x <> fp").where(F.bit_count(F.col("x").bitwiseXOR(F.col("fp"))) <= MAX_BITS)
    members = stored(answer.join(small(many, n, 16), F.col("key") == F.col("hot"), "left_semi").select("fp").distinct(), "hot-members")
    return stored(met.select("x", F.col("fp").alias("y")).distinct(), "met"), members


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(x, y) among distinct fingerprints (fp): all links but those that only hot keys show, for which ball_links stands in."""
    met, members = _met(prints, hot)
    return met if members is None else met.union(ball_links(members)).distinct()


def _counted(members: DataFrame) -> DataFrame:
    """(dfp, n): the number of links of each of members (fp) to others of them, without making pairs.

    Within one bit of x and two of y lie 65 points if x and y are equal or
    differ in one bit, three if they differ in two or three, none beyond. The
    points at one bit of y that are x itself count those that differ in one.
    """
    near = members.mapInArrow(_ball((0, 1)), "point long, fp long")
    one = members.mapInArrow(_ball((1,)), "point long, fp long").groupBy(F.col("point").alias("p1")).agg(F.count("*").alias("one"))
    two = members.mapInArrow(_ball((0, 1, 2)), "point long, fp long").groupBy(F.col("point").alias("p2")).agg(F.count("*").alias("c"))
    points = near.join(dealt(two), F.col("point") == F.col("p2")).groupBy(F.col("fp").alias("dfp")).agg(F.sum("c").alias("s"))
    met = points.join(dealt(one), F.col("dfp") == F.col("p1"), "left").withColumn("one", F.coalesce("one", F.lit(0)))
    return met.select("dfp", (F.col("one") + ((F.col("s") - 65 - 65 * F.col("one")) / 3)).cast("bigint").alias("n"))


def degrees(met: DataFrame, members: DataFrame | None) -> DataFrame:
    """(dfp, n): the number of links of each fingerprint that has any, from what :func:`_met` gives."""
    both = met.union(met.select("y", "x")).distinct()
    if members is None:
        return both.groupBy(F.col("x").alias("dfp")).agg(F.count("*").alias("n"))
    ends = both.join(members.select(F.col("fp").alias("mx")), F.col("x") == F.col("mx"), "left").join(members.select(F.col("fp").alias("my")), F.col("y") == F.col("my"), "left")
    outer = ends.where("mx is null or my is null").groupBy(F.col("x").alias("dfp")).agg(F.count("*").alias("n"))
    return outer.union(_counted(members)).groupBy("dfp").agg(F.sum("n").alias("n"))


def classes(documents: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """Per row of documents: doc_id, tag (a hash of the text), fp (signed), root (the component's smallest fingerprint), component_id, n_links (of its fingerprint, to other ones).

    Documents without words have fingerprint zero and link like any other.
    Repeated ids and texts give one row each. A null id is larger than all
    others: component_id is null only if all ids of the component are.
    """
    docs = documents.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, tag long, fp long")
    docs = stored(docs, "fingerprints")
    nodes = docs.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"))
    met, members = _met(nodes.select("fp"), hot)
    linked = stored(met if members is None else met.union(ball_links(members)).distinct(), "near")
    degree = degrees(linked if members is None else met, members)
    roots = components(linked)
    rooted = nodes.join(roots, F.col("fp") == F.col("node"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    rooted = rooted.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("lfp"), "root", "least")
    named = nodes.join(rooted, F.col("fp") == F.col("lfp"), "left").join(degree, F.col("fp") == F.col("dfp"), "left")
    named = named.select(F.col("fp").alias("nfp"), F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component"), F.coalesce("n", F.lit(0)).alias("n_links"))
    # stored, so that the join's two sides are dealt out apart from what made them, and a hot fingerprint's rows can be split
    out = docs.join(stored(named, "named"), F.col("fp") == F.col("nfp"))
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    return out.select("doc_id", "tag", "fp", "root", component.alias("component_id"), "n_links")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """documents with one row left of each component: that of the smallest id, and of its texts the one of the smallest hash."""
    found = classes(documents, shingle).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "tag", "root")
    return one_of_each(documents, found)
