"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every window of eight words of the benchmark goes into a table of hashes. The
documents' windows are hashed in generated code and probe that table; a hit
counts only if the words themselves agree. One shuffle follows, of hits and of
one small row per document; texts are never shuffled.

A benchmark whose windows take more than a broadcast may have is probed by
shuffle: of each document window go its hash, its place and the document's key,
but neither words nor texts. Only documents with a candidate are read again to
compare the words.

Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, PLAIN_WORD, ascii_lower, fits, marked, of, packed, small, stored, unpacked

WINDOW = 8
#: Room for the length in a window's code: code = position * STRIDE + length.
STRIDE = 16


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


def _window_hash(hashes: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(length)])


def _starts(n: Column, length: int) -> Column:
    """Codes of all windows of that length."""
    last = (n - length) * STRIDE + length
    return F.when(n >= length, F.sequence(F.lit(length), F.greatest(last, F.lit(length)), F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(h, words, n, item_id): one row per item and distinct window. Items without words have none; those with a null id are one item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("_w")).where("size(_w) > 0")
    items = items.withColumn("_n", F.least(F.size("_w"), F.lit(WINDOW)))
    at = items.select("item_id", "_w", "_n", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("_n"))).alias("_i"))
    win = at.select("item_id", F.col("_n").alias("n"), F.slice("_w", F.col("_i") + 1, F.col("_n")).alias("_s"))
    hashes = F.transform("_s", lambda w: F.xxhash64(w))
    win = win.withColumn("_h", hashes)
    h = F.lit(None).cast("bigint")
    for length in range(1, WINDOW + 1):
        h = F.when(F.col("n") == length, _window_hash(F.col("_h"), F.lit(0), length)).otherwise(h)
    return win.select(h.alias("h"), F.array_join("_s", " ").alias("words"), "n", "item_id").distinct()


def _worded(documents: DataFrame) -> DataFrame:
    """(id, _key, _w, _n, _h): words, their number and their hashes."""
    docs = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("_key"), words_of(F.col("text")).alias("_w"))
    return docs.select("id", "_key", "_w", F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))


def _piece(pos: Column, n: Column) -> Column:
    return F.array_join(F.slice("_w", pos + 1, n), " ")


def _candidates(documents: DataFrame, lengths: list[int], first: list[int]) -> DataFrame:
    """(id, _key, _w, _n, _code, _pos, _len, _wh0): one row for each window of one of the lengths, and for each code in first."""
    docs = _worded(documents)
    codes = F.concat(F.array(*map(F.lit, first)).cast("array<int>"), *[_starts(F.col("_n"), k) for k in lengths])
    at = docs.select("id", "_key", "_w", "_n", "_h", F.explode(codes).alias("_code"))
    pos, length = F.greatest(F.shiftright("_code", 4), F.lit(0)), F.col("_code").bitwiseAND(STRIDE - 1)
    h = F.lit(None).cast("bigint")
    for k in lengths:
        h = F.when((F.col("_code") >= 0) & (length == k), _window_hash(F.col("_h"), pos, k)).otherwise(h)
    return at.select("id", "_key", "_w", "_n", "_code", pos.alias("_pos"), length.alias("_len"), h.alias("_wh0"))


def _probed(documents: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, _key, _n, _own, _pos, _len, _wh): a row for each document (_own) and hit, by a broadcast table (_wh, _ww)."""
    at = _candidates(documents, lengths, [-1])
    met = at.join(F.broadcast(table), (F.col("_wh0") == F.col("_wh")) & (_piece(F.col("_pos"), F.col("_len")) == F.col("_ww")), "left")
    met = met.where((F.col("_code") == -1) | F.col("_wh").isNotNull())
    return met.select("id", "_key", "_n", (F.col("_code") == -1).alias("_own"), "_pos", "_len", "_wh")


def _dealt(documents: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """The same by shuffle, of hashes first; the words of the documents that these hit are compared then."""
    light = _candidates(documents, lengths, []).select("id", "_key", "_pos", "_len", "_wh0")
    hashes = table.select(F.col("_wh").alias("_th")).distinct()
    maybe = light.join(hashes, F.col("_wh0") == F.col("_th")).groupBy("id", "_key").agg(F.collect_set(F.struct("_pos", "_len", "_wh0")).alias("_at"))
    maybe = stored(maybe.select(F.col("id").alias("_i"), F.col("_key").alias("_k"), "_at"), "candidates")
    size = maybe.agg(F.count("*"), F.coalesce(F.sum(F.size("_at")), F.lit(0))).first()
    docs = documents.select("doc_id", "text").join(
        small(maybe, size[0] * 64 + size[1] * 32, 1), (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_i")) & (F.xxhash64("text") == F.col("_k"))
    )
    docs = docs.select("_i", "_k", "_at", words_of(F.col("text")).alias("_w")).select("_i", "_k", "_w", F.explode("_at").alias("_x"))
    pieces = docs.select(F.col("_i").alias("id"), F.col("_k").alias("_key"), F.col("_x._pos").alias("_pos"), F.col("_x._len").alias("_len"), F.col("_x._wh0").alias("_wh0"), _piece(F.col("_x._pos"), F.col("_x._len")).alias("_words"))
    met = pieces.join(table, (F.col("_wh0") == F.col("_wh")) & (F.col("_words") == F.col("_ww")))
    own = _worded(documents).select("id", "_key", "_n", F.lit(True).alias("_own"), F.lit(None).cast("int").alias("_pos"), F.lit(None).cast("int").alias("_len"), F.lit(None).cast("bigint").alias("_wh"))
    return own.unionByName(met.select("id", "_key", F.lit(None).cast("int").alias("_n"), F.lit(False).alias("_own"), "_pos", "_len", "_wh"))


def find_hits(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per document: id (NO_ID for a null doc_id), _key, n_words, _copies, hits.

    windows: :func:`benchmark_windows`, stored. hits: array of (pos, n, h) of
    all occurrences of benchmark windows, by word position. Documents without
    hits have an empty array. Rows with equal id and text come as one row with
    _copies of them.
    """
    table = windows.select(F.col("h").alias("_wh"), F.col("words").alias("_ww"), F.col("n").alias("_wn")).distinct()
    sizes = table.groupBy("_wn").agg(F.count("*").alias("rows"), F.sum(F.octet_length("_ww")).alias("bytes")).collect()  # eight rows at most
    broadcast = fits(1, sum(64 * r["rows"] + r["bytes"] for r in sizes))
    met = (_probed if broadcast else _dealt)(documents, table.drop("_wn"), sorted(r["_wn"] for r in sizes))
    hit = F.when(~F.col("_own"), F.struct(F.col("_pos").alias("pos"), F.col("_len").alias("n"), F.col("_wh").alias("h")))
    return met.groupBy("id", "_key").agg(
        F.max(F.when(F.col("_own"), F.col("_n"))).cast("bigint").alias("n_words"),
        F.count(F.when(F.col("_own"), 1)).alias("_copies"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
    )


def covered(hits: Column) -> Column:
    """Number of words in the union of the hits' ranges; hits come by position."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["n"]
        new = F.greatest(end - F.greatest(x["pos"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(end, acc["end"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def _judged(documents: DataFrame, benchmark: DataFrame, min_items: int) -> DataFrame:
    """id, _key, _copies, n_words, n_hit, n_items, items, hits, contaminated: one row for rows with equal id and text."""
    windows = stored(benchmark_windows(benchmark), "windows")
    hits = stored(find_hits(documents, windows), "hits")
    named = windows.select(F.col("h").alias("_ih"), F.col("item_id").cast("string").alias("_item")).distinct()
    size = named.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_item")), F.lit(0))).first()
    pairs = hits.where(F.size("hits") > 0).select("id", "_key", F.explode(F.array_distinct(F.transform("hits", lambda x: x["h"]))).alias("_hh"))
    met = pairs.join(small(named, size[0] * 48 + size[1], 1), F.col("_hh") == F.col("_ih"))
    items = met.groupBy(F.col("id").alias("_i"), F.col("_key").alias("_k")).agg(F.array_sort(F.collect_set("_item")).alias("_items"), F.max(F.col("_item").isNull().cast("int")).alias("_null"))
    found = hits.join(items, (F.col("id") == F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    listed = F.coalesce("_items", F.array().cast("array<string>"))
    n_items = (F.size(listed) + F.coalesce("_null", F.lit(0))).cast("bigint")
    return found.select("id", "_key", "_copies", "n_words", covered(F.col("hits")).alias("n_hit"), n_items.alias("n_items"), listed.alias("items"), "hits", (n_items >= min_items).alias("contaminated"))


def contamination(documents: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted ids as strings), hits, contaminated, _key.

    An empty benchmark hits nothing. A document without words has no hits.
    Items with a null id count as one item, which items does not name. A null
    or repeated doc_id is treated as :mod:`.common` says.
    """
    found = _judged(documents, benchmark, min_items).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return found.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_hit", "n_items", "items", "hits", "contaminated", "_key")


def places(hits: Column) -> Column:
    """The places of the words that hits cover, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["n"] - 1)))))


def removed_text(text: Column, gone: Column) -> Column:
    """text without the words at the sorted places gone; what stands between words stays."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words, between = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.split(text, word, -1)
    kept = F.zip_with(words, marked(gone), lambda x, m: F.when(m == 1, F.lit("")).otherwise(x))
    return F.array_join(F.zip_with(between, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """documents without contaminated rows; elsewhere the hit words are cut out of the text.

    All columns stay, and n_chars follows the text where there is one. Order
    and repeated rows stay as they are.
    """
    verdict = _judged(documents.select("doc_id", "text"), benchmark, min_items).where("n_items > 0")
    gone = F.when(~F.col("contaminated"), places(F.col("hits")))
    verdict = stored(verdict.select(F.col("id").alias("_id"), "_key", gone.alias("_gone"), F.col("contaminated").alias("_bad")), "contaminated")
    size = verdict.agg(F.count("*"), F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()
    mine = (F.coalesce(of("doc_id"), F.lit(NO_ID)) == F.col("_id")) & (F.xxhash64(of("text")) == F.col("_key"))
    docs = packed(documents).join(small(verdict, size[0] * 64 + size[1] * 8, 1), mine, "left").where("not coalesce(_bad, false)")
    text = F.when(F.col("_gone").isNull(), of("text")).otherwise(removed_text(of("text"), F.col("_gone")))
    return unpacked(docs, documents, text=text)
