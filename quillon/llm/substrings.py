"""Substring dedup: Rabin-Karp hashes of every window of fifty words.

Words hash to 64 bits; a window's hash is their polynomial, modulo 2**64, in
an odd base, got for all windows of a text from one running sum. A window is
repeated if its hash also comes from a smaller document; repeated windows
merge into maximal intervals of words, which are removed.

Windows count as equal by 96 bits: that hash, and the upper half of a second
one that shares neither word hashes nor base. Of W windows some W**2 / 2**97
pairs are taken for equal by chance: one in 1,500 runs over 10**13 windows.

Few windows are repeated, and only such need to be counted in Spark. Each
window names its anchor, the least hash of the eight-word grams in it. Equal
windows have equal anchors, so a window whose anchor comes from one document
only is in no other. A first pass finds the anchors that several documents
share; the second sends the hashes of the windows with those anchors, and no
repeated window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, small, stored

WINDOW = 50
GRAM = 8
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Seed of the second hash's word hashes.
OTHER_SEED = 77
#: Rows that repeat an id are told apart by so many bits of their texts' hash.
TAG_BITS = 31


@cache
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(n, base, dtype=np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    if seed:
        return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), dtype=np.uint64, count=len(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def rolling(hashes: np.ndarray, *lengths: int, base: int = BASE) -> list[np.ndarray]:
    """For each length the hashes of all windows of so many words."""
    n = len(hashes)
    up, down = _powers(1 << max(10, int(n).bit_length()), base)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[:n])))
    return [(sums[k:] - sums[: n + 1 - k]) * down[: n + 1 - k] for k in lengths]


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """The least value, after mixing, of each run of span grams."""
    least = grams * np.uint64(0xFF51AFD7ED558CCD)
    least ^= least >> np.uint64(32)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    extra = span - width
    return np.minimum(least[: len(least) - extra], least[extra:]) if extra else least


def _windows(text: str, window: int, more: bool = False) -> tuple[np.ndarray, ...] | None:
    """Hashes and anchors of all windows; with more also the upper half of their second hash."""
    words = text.encode("utf-8").split()
    if len(words) < window:
        return None
    gram = min(GRAM, window)
    whole, grams = rolling(word_hashes(words), window, gram)
    found = whole, anchors(grams, window - gram + 1)
    return (*found, (rolling(word_hashes(words, OTHER_SEED), window, base=OTHER_BASE)[0] >> np.uint64(32)).astype(np.uint32)) if more else found


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, b.num_rows, 512):
                found, row = [], []
                for k in range(at, min(at + 512, b.num_rows)):
                    if w := _windows(b.column(2)[k].as_py(), window):
                        found.append(np.unique(w[1]))
                        row.append(np.full(len(found[-1]), k))
                if found:
                    row = np.concatenate(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids[row]), pa.array(tags[row])], names=["anchor", "id", "tag"])

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k in range(b.num_rows):
                whole, anchor, other = _windows(b.column(2)[k].as_py(), window, True)
                shared = b.column(3)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.flatnonzero(np.isin(anchor, shared))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole[at].view(np.int64)), pa.array(other[at].view(np.int32)), pa.array(np.full(len(at), ids[k])), pa.array(at | (tags[k] << 32))],
                    names=["hash", "other", "id", "at"],
                )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined to larger ones."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 50_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words_in, words_out, texts = [], [], []
        for text, begins, ends in zip(b.column(1), b.column(2), b.column(3)):
            words = text.as_py().encode("utf-8").split()
            kept, last = [], 0
            for x, y in zip(begins.as_py() or (), ends.as_py() or ()):
                kept += words[last:x]
                last = y
            kept += words[last:]
            words_in.append(len(words))
            words_out.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words_in, pa.int64()), pa.array(words_out, pa.int64()), pa.array(texts, pa.string()), b.column(2), b.column(3)], names=["doc_id", "n_words", "n_removed", "text", "begins", "ends"])


def intervals(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, tag, begins, ends): the maximal intervals of words to remove, of the rows that have any.

    Compared are ids: windows shared by rows of one id, or by null ids only, stay.
    """
    docs = _keyed(documents)
    marks = stored(docs.mapInArrow(_anchor_rows(window), "anchor long, id long, tag long"), "anchors")
    shared = marks.groupBy(F.col("anchor").alias("a")).agg(F.min("id").alias("f"), F.max("id").alias("l")).where("f < l").select("a")
    shared = stored(shared, "shared-anchors")  # so that the rows of a hot anchor can be split in the join
    wanted = marks.join(shared, F.col("anchor") == F.col("a")).groupBy(F.col("id").alias("i"), F.col("tag").alias("t")).agg(F.collect_set("anchor").alias("anchors"))
    named = docs.join(wanted, (F.col("id") == F.col("i")) & (F.col("tag") == F.col("t"))).select("id", "tag", "text", "anchors")
    run = _window_rows(window)
    rows = named.mapInArrow(lambda batches: _merged(run(batches)), "hash long, other int, id long, at long")
    first = rows.groupBy(F.col("hash").alias("h"), F.col("other").alias("o")).agg(F.min("id").alias("f"), F.max("id").alias("l")).where("f < l").select("h", "o", "f")
    first = stored(first, "repeated")  # so that the rows of a hot window can be split in the join
    again = rows.join(first, (F.col("hash") == F.col("h")) & (F.col("other") == F.col("o"))).where("id > f")
    again = again.select("id", F.shiftright("at", 32).alias("tag"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"))
    found = again.groupBy("id", "tag").agg(F.array_sort(F.collect_set("at")).alias("at"))  # at most the words of one text
    n = F.size("at")
    begins = F.filter("at", lambda x, i: (i == 0) | (x - F.get(F.col("at"), i - 1) > window))
    ends = F.transform(F.filter("at", lambda x, i: (i == n - 1) | (F.get(F.col("at"), i + 1) - x > window)), lambda x: x + window)
    return found.select("id", "tag", begins.alias("begins"), ends.alias("ends"))


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text).bitwiseAND((1 << TAG_BITS) - 1).alias("tag"), text.alias("text"))


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_removed, text (what stays, words joined by one space), begins, ends.

    A null or empty text has no words; a text shorter than the window loses
    none. All occurrences but those in the smallest document go, also when
    that document itself loses them to no one. Empty tables give no rows.
    """
    found = stored(intervals(documents, window), "intervals").select(F.col("id").alias("i"), F.col("tag").alias("t"), "begins", "ends")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("begins")), F.lit(0)).alias("k")).first()
    docs = _keyed(documents)
    met = docs.join(small(found, size["n"] * 160 + size["k"] * 8, 1), (F.col("id") == F.col("i")) & (F.col("tag") == F.col("t")), "left")
    met = met.select(F.expr(f"nullif(id, {NO_ID})").alias("doc_id"), "text", "begins", "ends")
    return met.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, text string, begins array<int>, ends array<int>")
