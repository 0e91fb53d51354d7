"""A corpus from documents to a mix, in five stages that each read what the one before kept.

language ID: documents without a known language go. Line dedup: lines on many
sites go, but for their first occurrence. Near-dedup: one document of each
group of near copies (five-word shingles, Jaccard 0.8 or more) stays. Decontamination: documents with windows of
two or more benchmark items go, and the words of a single item's windows are
cut. Mixing: documents get rates that meet the target weights, one or more for
clean ones; those with a rate of zero go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, langid, lines, mixing, nearcopies
from quillon.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is known with a score of 0.3 at least.

    A null or empty text, and one without a letter, has no language and goes.
    Repeated rows are judged alike. Without labelled rows nothing is known and
    all go; an empty table stays empty. Texts of any length are read whole.
    """
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that stand on ten sites or more, but for the first occurrence of each.

    The first is that of the smallest doc_id (a null id is the largest), then
    of the smallest hash of the text; rows that repeat both keep it alike. No
    row goes: a text left without lines is empty, a null one stays null. A null
    source counts as the source ''.
    """
    return lines.without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id (null ids last), of its texts the one of the smallest hash.

    Groups are what pairs of a Jaccard similarity of 0.8 or more, over five-word
    shingles, connect. Null, empty and blank texts are one group. Rows that
    repeat id and text are copies.
    """
    return nearcopies.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold windows of two or more benchmark items; the words of a single item's windows are cut out.

    Null and empty texts have no windows and stay, as all rows do if the
    benchmark is empty. Repeated rows are treated alike.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with a rate above zero, with rate, copies and the posteriors p_good, p_poor and p_toxic, which replace columns of such names.

    Documents that are likeliest clean have rates of one or more. A null or
    empty text has no tokens, moves no total, and is rated by its posteriors
    like any other; equal texts have equal rates. Without labels all domains
    are alike.
    """
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]

#: Classifiers are trained on the way: SQL has no form for that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
