"""Line dedup: lines that spread over many sites are boilerplate and go.

Each distinct line gets a HyperLogLog sketch of the sites it is on; sketches
of all tasks merge by aggregation, so a line that is on every page costs one
sketch a task. Lines whose estimate is near the threshold get an exact count
of distinct sites before anything is removed. One occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, marked, of, packed, small, stored, unpacked

#: A line on so many distinct sites or more is boilerplate.
MIN_SITES = 10
#: Sketches have 2**LG_K registers; their relative standard error is 1.04 / sqrt(2**LG_K).
LG_K = 12
#: Estimates within so many standard errors of the threshold (and within one site) are counted exactly.
ERRORS = 5
BLANK = " \t\r"


def _lines(documents: DataFrame) -> DataFrame:
    """(id, tag, site, pos, line hash) of all lines that are not blank."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tag"), F.coalesce("source", F.lit("")).alias("site"), F.split(text, "\n", -1).alias("_l")
    )
    at = docs.select("id", "tag", "site", F.posexplode("_l").alias("pos", "_x"))
    return at.select("id", "tag", "site", "pos", F.btrim("_x", F.lit(BLANK)).alias("_x")).where("_x <> ''").select("id", "tag", "site", "pos", F.xxhash64("_x").alias("line"))


def boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, sites, exact, first): lines on min_sites sites or more, and their first occurrence (id, tag, pos).

    Blanks at a line's ends do not count, and blank lines are none. A null
    source is the site with the empty name.
    """
    lines = _lines(documents)
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("id", "tag", "pos")).alias("first"))
    sketched = sketched.select("line", F.hll_sketch_estimate("sketch").alias("sites"), "first")
    margin = max(1.0, ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    found = stored(sketched.where(F.col("sites") >= min_sites - margin), "lines")
    near = found.where(F.col("sites") <= min_sites + margin)
    rows = near.count()
    asked = small(near.select(F.col("line").alias("_n")), rows, 32)
    exact = lines.join(asked, F.col("line") == F.col("_n"), "left_semi").select("line", "site").distinct().groupBy(F.col("line").alias("_e")).agg(F.count("*").alias("_sites"))
    found = found.join(exact, F.col("line") == F.col("_e"), "left")
    found = found.select("line", F.coalesce("_sites", "sites").alias("sites"), F.col("_sites").isNotNull().alias("exact"), "first")
    return found.where(F.col("sites") >= min_sites)


def _removals(documents: DataFrame, min_sites: int) -> DataFrame:
    """(_i, _t, _gone): positions of the lines to remove, of each document that has any."""
    found = stored(boilerplate(documents, min_sites), "boilerplate")
    table = small(found.select(F.col("line").alias("_b"), F.col("first").alias("_f")), found.count(), 64)
    lines = _lines(documents)
    gone = lines.join(table, F.col("line") == F.col("_b")).where(F.struct("id", "tag", "pos") != F.col("_f"))
    return gone.groupBy(F.col("id").alias("_i"), F.col("tag").alias("_t")).agg(F.sort_array(F.collect_set("pos")).alias("_gone"))


def remove_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per row of documents: _doc (all its columns), _text (without boilerplate lines), _n_lines and _n_removed.

    Of each such line the first occurrence stays, by smallest doc_id, then by
    position; rows that repeat id and text keep it alike. A document that is
    left without lines stays, with an empty text. A null text stays null and
    has no lines; a text without a line break is one line.
    """
    gone = stored(_removals(documents, min_sites), "gone")
    size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_gone")), F.lit(0)).alias("k")).first()
    mine = (F.coalesce(of("doc_id"), F.lit(NO_ID)) == F.col("_i")) & (F.xxhash64(F.coalesce(of("text"), F.lit(""))) == F.col("_t"))
    docs = packed(documents).join(small(gone, size["n"] * 64 + size["k"] * 8, 1), mine, "left")
    each = F.zip_with(F.split(of("text"), "\n", -1), marked(F.col("_gone")), lambda x, gone: F.struct(x.alias("x"), gone.alias("gone")))
    kept = F.transform(F.filter(each, lambda s: F.coalesce(s["gone"], F.lit(0)) == 0), lambda s: s["x"])
    return docs.select(
        "_doc",
        F.when(F.col("_gone").isNull(), of("text")).otherwise(F.array_join(kept, "\n")).alias("_text"),
        F.when(of("text").isNull(), 0).otherwise(F.size(F.split(of("text"), "\n", -1))).cast("bigint").alias("_n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("_n_removed"),
    )


def without_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """documents, their texts without boilerplate lines, n_chars following."""
    return unpacked(remove_boilerplate(documents, min_sites), documents, text=F.col("_text"))
