"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The SimHash operator's second half, for looser copies than its fingerprints
alone can tell. Texts with equal sets are one node. Candidates come in two
steps, and each is verified on the whole sets before it links anything:

* 64-bit SimHash fingerprints of the shingles that differ in three bits at
  most, found by their Golay keys (:func:`.simhash.links`). These are the
  closest copies; what they connect needs no more pairs.
* At a similarity of 0.8 about ten of 64 bits differ, and Golay keys that
  reach so far would be too many or too short. So nodes of different groups
  are also paired if they share a band: five of a hundred least hashes of the
  set. A pair of similarity s is missed with a probability of (1 - s**5)**20:
  0.0004 at 0.8, under 10**-7 from 0.9 on.

Nodes of a crowded band are not paired by it. They are joined by prefixes
instead, without loss: in any one order of all shingles, two sets of that
similarity have their first common shingle within the first fifth (and one
more) of both, and behind it in both there is room for what they must share.
The order puts shingles that a sample of these nodes shows to be common last,
so that sets with many shingles of their own meet nobody. Which shingles count
as common changes the cost, never the result. In each key the set with the
fewest shingles before it leads: all are held against it, and then only nodes
that are not in one group by now are paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import NO_ID, discard, one_of_each, small, stored
from .components import components
from .substrings import rolling, word_hashes

SHINGLE = 5
BANDS, ROWS = 20, 5
#: A band with more nodes is crowded.
HOT = 16
#: Common: in so many of the sampled nodes, one in SAMPLE; at most so many shingles.
SAMPLE, COMMON, MOST = 16, 3, 200_000
SEED = 42
#: Odd factors that make one hash a hundred, and five least hashes one key.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
#: Texts whose sets are kept at hand while pairs are verified.
AT_HAND = 64


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return z ^ (z >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_mixed(rolling(word_hashes(words), min(SHINGLE, len(words)))[0]))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its five least hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024, None] * FACTORS).min(axis=0), out=least)
    folded = (least.reshape(BANDS, ROWS) * FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64)
    return _mixed(folded + np.arange(BANDS, dtype=np.uint64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column(2)]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        prints = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
        keys = [bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
        names = ["id", "tag", "node", "n", "fp", "bands"]
        sizes = pa.array([len(s) for s in sets], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), sizes, pa.array(prints), pa.array(keys, pa.list_(pa.int64()))], names=names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column(1):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], names=["s"])


def _prefixes(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1)):
                s, late = shingles(text.as_py()), common.value
                n, known = len(s), late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), bool)
                first = np.concatenate((s[~known], s[known]))[: n - (4 * n + 4) // 5 + 1]
                columns = (first.view(np.int64), np.full(len(first), node, np.int64), np.arange(len(first), dtype=np.int32), np.full(len(first), n, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "pos", "n"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}

    def own(node: int, text: pa.Scalar) -> np.ndarray:
        if node not in held:
            if len(held) >= AT_HAND:
                held.clear()
            held[node] = shingles(text.as_py())
        return held[node]

    for b in batches:
        shared, total = [], []
        for x, y, tx, ty in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            sx, sy = own(x, tx), own(y, ty)
            shared.append(len(np.intersect1d(sx, sy, assume_unique=True)))
            total.append(len(sx) + len(sy))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int32()), pa.array(total, pa.int32())], names=["x", "y", "shared", "total"])


def _near(shared: Column, total: Column) -> Column:
    """shared / (total - shared) >= 0.8, in whole numbers."""
    return 9 * shared >= 4 * total


def _alike(n: Column, m: Column) -> Column:
    """Sizes that a similarity of 0.8 allows."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


class _Search:
    """Candidates over the nodes of a table, and their verification on its texts."""

    def __init__(self, documents: DataFrame):
        self.keyed = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"), "text")
        self.rows = stored(self.keyed.mapInArrow(_signed, "id long, tag long, node long, n int, fp long, bands array<long>"), "signed")
        first = self.rows.groupBy("node").agg(F.min(F.struct("id", "tag", "n", "fp", "bands")).alias("f"))
        self.nodes = stored(first.select("node", "f.*"), "nodes")
        self.repeated = bool(self.rows.groupBy("id", "tag").count().where("count > 1").limit(1).count())

    def judged(self, pairs: DataFrame) -> DataFrame:
        """pairs (x, y) of nodes with shared (shingles in both) and total (the sets' sizes, summed)."""
        pairs = stored(pairs.distinct(), "pairs")
        texts = self.texts(pairs.select(F.col("x").alias("e")).union(pairs.select("y")).distinct())
        met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), F.col("x") == F.col("a"))
        met = met.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), F.col("y") == F.col("b"))
        judged = stored(met.select("x", "y", "ta", "tb").mapInArrow(_compared, "x long, y long, shared int, total int"), "judged")
        discard(pairs, texts)
        return judged

    def texts(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of the wanted nodes (e)."""
        wanted = stored(wanted, "ends")
        n = wanted.count()
        own = stored(self.nodes.join(small(wanted, n, 16), F.col("node") == F.col("e"), "left_semi").select("node", F.col("id").alias("i"), F.col("tag").alias("t")), "wanted")
        texts = self.keyed.join(small(own, n, 40), (F.col("id") == F.col("i")) & (F.col("tag") == F.col("t"))).select("node", "text")
        texts = stored(texts.dropDuplicates(["node"]) if self.repeated else texts, "texts")
        discard(wanted, own)
        return texts

    def near(self, pairs: DataFrame) -> DataFrame:
        return self.judged(pairs).where(_near(F.col("shared"), F.col("total"))).select("x", "y")

    def closest(self) -> DataFrame:
        """(x, y): verified links of nodes whose fingerprints are equal or linked, between one node of each fingerprint and to it."""
        first = stored(self.nodes.where("n > 0").groupBy(F.col("fp").alias("p")).agg(F.min("node").alias("r")), "first-of-print")
        linked = simhash.links(first.select(F.col("p").alias("fp")))
        met = linked.join(first.select(F.col("p").alias("px"), F.col("r").alias("rx")), F.col("x") == F.col("px"))
        met = met.join(first.select(F.col("p").alias("py"), F.col("r").alias("ry")), F.col("y") == F.col("py"))
        equal = self.nodes.join(first, F.col("fp") == F.col("p")).where("node <> r").select(F.col("r").alias("x"), F.col("node").alias("y"))
        return self.near(met.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).union(equal))

    def members(self, roots: DataFrame) -> DataFrame:
        """(key, node, n, root) of the bands that hold nodes of several groups."""
        at = self.nodes.select("node", "n", F.explode("bands").alias("key"))
        at = at.join(roots.withColumnRenamed("node", "o"), F.col("node") == F.col("o"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        at = stored(at, "band-rows")
        apart = stored(at.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("k", "c"), "apart")
        members = stored(at.join(apart, F.col("key") == F.col("k")).select("key", "node", "n", "root", "c"), "members")
        discard(at, apart)
        return members


def _crossing(left: DataFrame, fits: Column) -> DataFrame:
    """(x, y), x < y: pairs of different groups that share a key, if they fit (their columns, and the same with _ before)."""
    right = left.select(*[F.col(c).alias(f"_{c}") for c in left.columns])
    met = left.join(right, (F.col("key") == F.col("_key")) & (F.col("node") < F.col("_node")) & (F.col("root") != F.col("_root")) & fits)
    return met.select(F.col("node").alias("x"), F.col("_node").alias("y"))


def _apart(rows: DataFrame) -> DataFrame:
    """rows (key, root and more) of the keys that hold several groups."""
    rows = stored(rows, "key-rows")
    apart = rows.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k")
    apart = stored(apart, "apart")
    left = stored(rows.join(apart, F.col("key") == F.col("k"), "left_semi"), "still-apart")
    discard(rows, apart)
    return left


def _crowded(search: _Search, crowd: DataFrame) -> DataFrame:
    """(x, y): links that connect what all pairs of crowd (node, root) of similarity 0.8 or more would, by prefixes."""
    texts = search.texts(crowd.select(F.col("node").alias("e")))
    sampled = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).mapInArrow(_sets, "s long")
    often = sampled.groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST).collect()
    common = crowd.sparkSession.sparkContext.broadcast(np.sort(np.array([r["s"] for r in often], np.int64).view(np.uint64)))
    rows = texts.mapInArrow(_prefixes(common), "key long, node long, pos int, n int")
    rows = _apart(rows.join(crowd.withColumnRenamed("node", "o"), F.col("node") == F.col("o")).drop("o"))
    # what follows the key in either set, itself included, must do for what the two must share
    room = 9 * F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos")) >= 4 * (F.col("n") + F.col("_n"))
    fits = room & _alike(F.col("n"), F.col("_n"))

    first = rows.groupBy("key").agg(F.min(F.struct("pos", F.xxhash64("node"), "node", "n", "root")).alias("f"))
    first = stored(first.select(F.col("key").alias("_key"), *[F.col(f"f.{c}").alias(f"_{c}") for c in ("pos", "node", "n", "root")]), "leaders")
    led = rows.join(first, F.col("key") == F.col("_key")).where((F.col("root") != F.col("_root")) & fits)
    found = search.near(led.select(F.least("node", "_node").alias("x"), F.greatest("node", "_node").alias("y")))
    # the groups that these links join
    ends = found.join(crowd.select(F.col("node").alias("a"), F.col("root").alias("ra")), F.col("x") == F.col("a"))
    ends = ends.join(crowd.select(F.col("node").alias("b"), F.col("root").alias("rb")), F.col("y") == F.col("b"))
    joined = stored(components(ends.select("ra", "rb")), "joined").select(F.col("node").alias("o"), F.col("root").alias("new"))
    rows = rows.join(joined, F.col("root") == F.col("o"), "left").select("key", "node", "pos", "n", F.coalesce("new", "root").alias("root"))
    return found.union(search.near(_crossing(_apart(rows), fits)))


def links(search: _Search, hot: int = HOT) -> DataFrame:
    """(x, y): links that connect what all candidate pairs of similarity 0.8 or more would."""
    found = stored(search.closest(), "closest")
    members = search.members(stored(components(found), "roots"))
    found = found.union(search.near(_crossing(members.where(F.col("c") <= hot), _alike(F.col("n"), F.col("_n")))))
    crowd = stored(members.where(F.col("c") > hot).select("node", "root").distinct(), "crowd")
    return found.union(_crowded(search, crowd)) if crowd.limit(1).count() else found


def groups(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of documents: id, tag (a hash of the text) and root, equal for near copies and what connects them.

    A null id is larger than all others. Texts without words, null ones too,
    are copies of each other. Rows that repeat id and text have one result
    row each. Sets are told apart by 64-bit hashes. An empty table gives no rows.
    """
    search = _Search(documents)
    roots = stored(components(links(search, hot)), "roots")
    met = search.rows.select("id", "tag", F.col("node").alias("own")).join(roots, F.col("own") == F.col("node"), "left")
    return met.select("id", "tag", F.coalesce("root", "own").alias("root"))


def dedup(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """documents with one row left of each group of near copies: that of the smallest id, and of its texts the one of the smallest hash."""
    return one_of_each(documents, groups(documents, hot))
