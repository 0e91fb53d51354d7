"""The queries of the corpus operators: thin digests of each operator's own output."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lines, mixing, pii, sampling, secrets, simhash, substrings, urls
from .common import of, sha256_hex, shared_dir, table


def _joined(spans) -> "F.Column":
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id", "n_links")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), sha256_hex(_joined(base)).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.against_neighbours(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), sha256_hex(F.col("edited")).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.size("_spans").alias("n_spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    atexit.register(ledger.clear)
    ledger.record(docs)
    found = ledger.update(docs)  # every blob is on record by now: no text is scanned again
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(count, secrets.BASE), sha256_hex(_joined(base)).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return found.select(of("doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), sha256_hex(F.coalesce("_text", F.lit(""))).alias("kept_sha256"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("text")).alias("kept_sha256"))


QUERIES = {
    "op1_urls": op1_urls,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_langid": op7_langid,
    "op8_secrets": op8_secrets,
    "op9_lines": op9_lines,
    "op10_substrings": op10_substrings,
}
