"""Secret scans with an incremental ledger of content-addressed texts.

Every version of every path is addressed by the SHA-256 of its text. The
ledger says which rule versions have read which blob; a scan reads only blobs
that some rule version has not seen, each once however many paths share it,
and findings are joined back to all paths.

Built from DataFrame functions only. Positions come from the pieces between
matches: a match starts after all pieces and matches before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _remove, fits, sha256_hex, stored


@dataclass(frozen=True)
class Rule:
    """pattern finds matches, leftmost and non-overlapping; of those, keep is a pattern that must match from the start.

    gate is a cheap literal that every match holds; rules without one are gated by their pattern.
    """

    kind: str
    version: int
    pattern: str
    keep: str = ""
    gate: str = ""

    @property
    def label(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"

#: The three base kinds, then well-known public token formats.
#: For access and hex the least length is in the pattern: their matches are whole runs, so that a dropped run has no match inside.
RULES = (
    Rule("assign", 1, _ASSIGN + r"[A-Za-z0-9+/_.=-]+", keep="^" + _ASSIGN + r"[A-Za-z0-9+/_.=-]{6,}$"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", gate="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", gate="gh"),
    Rule("google", 1, r"AIza[0-9A-Za-z_-]{35}", gate="AIza"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", gate="eyJ"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", gate="xox"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", gate="PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def addressed(documents: DataFrame) -> DataFrame:
    """documents with _text (null: empty) and its address blob_id."""
    return documents.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("blob_id", sha256_hex(F.col("_text")))


def _pieces(rule: Rule, text: Column, unseen: Column) -> Column:
    """Array of (before, n, ok): the lengths of each match and of the piece before it; empty if there is nothing to scan."""
    gate = text.contains(rule.gate) if rule.gate else text.rlike(rule.pattern)
    ok = (lambda m: m.rlike(rule.keep)) if rule.keep else (lambda m: F.lit(True))
    found = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda p, m: F.struct(F.length(p).alias("before"), F.length(m).alias("n"), ok(m).alias("ok")),
    )
    return F.when(unseen & gate, found)


def scan_unseen(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scans each blob with the rule versions that the ledger lacks for it.

    ledger: rows (blob_id, rule, version), or none. Returns findings (blob_id,
    kind, version, start, end; code points, end exclusive) and the pairs
    scanned now, to be appended to the ledger. Repeated texts are scanned
    once. Null and empty texts are one blob, which has no findings. An empty
    table gives no rows.
    """
    blobs = addressed(documents).select("blob_id", "_text")
    labels = [r.label for r in rules]
    none_seen = F.array().cast("array<string>")
    if ledger is None:
        blobs = blobs.groupBy("blob_id").agg(F.first("_text").alias("_text")).withColumn("_seen", none_seen)
    else:
        seen = ledger.select(F.col("blob_id").alias("_b"), F.concat_ws("@", "rule", "version").alias("_l"))
        seen = seen.where(F.col("_l").isin(labels)).groupBy("_b").agg(F.collect_set("_l").alias("_seen"))
        # addresses alone tell what is unseen: texts are moved only for that
        ids = blobs.select("blob_id").distinct().join(seen, F.col("blob_id") == F.col("_b"), "left")
        ids = ids.select(F.col("blob_id").alias("_id"), F.coalesce("_seen", none_seen).alias("_seen")).where(F.size("_seen") < len(labels))
        unseen = stored(ids, "unseen")
        if fits(unseen.count(), 128 + 24 * len(labels)):
            blobs = blobs.join(F.broadcast(unseen.select(F.col("_id").alias("_of"))), F.col("blob_id") == F.col("_of"), "left_semi")
        blobs = blobs.groupBy("blob_id").agg(F.first("_text").alias("_text")).join(unseen, F.col("blob_id") == F.col("_id")).drop("_id")
    scanned = blobs.select("blob_id", F.explode(F.array_except(F.array(*map(F.lit, labels)), "_seen")).alias("_l"))
    scanned = scanned.select("blob_id", F.split("_l", "@")[0].alias("rule"), F.split("_l", "@")[1].cast("int").alias("version"))

    tried = F.array(*[F.struct(F.lit(k).alias("k"), _pieces(r, F.col("_text"), ~F.array_contains("_seen", r.label)).alias("at")) for k, r in enumerate(rules)])
    hits = blobs.select("blob_id", F.explode(F.filter(tried, lambda x: F.size(x["at"]) > 1)).alias("_x"))
    hits = hits.select("blob_id", F.col("_x.k").alias("_k"), F.posexplode("_x.at").alias("_i", "_at"))
    upto = W.partitionBy("blob_id", "_k").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    hits = hits.withColumn("_end", F.sum(F.col("_at.before") + F.coalesce("_at.n", F.lit(0))).over(upto))
    kind, version = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    hits = hits.where("_at.n is not null and _at.ok")
    findings = hits.select(
        "blob_id", F.get(kind, F.col("_k")).alias("kind"), F.get(version, F.col("_k")).alias("version"),
        (F.col("_end") - F.col("_at.n")).cast("bigint").alias("start"), F.col("_end").cast("bigint").alias("end"),
    )
    return findings, scanned


def spans_by_path(documents: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of documents: doc_id, blob_id and spans, an array of (start, rank, kind, end) by start, then by the rules' order."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    by_blob = findings.groupBy(F.col("blob_id").alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("start", F.element_at(order, F.col("kind")).alias("rank"), "kind", "end"))).alias("spans")
    )
    by_blob = stored(by_blob, "spans")  # so that the rows of a hot blob can be split in the join
    paths = addressed(documents).select("doc_id", "blob_id")
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return paths.join(by_blob, F.col("blob_id") == F.col("_b"), "left").select("doc_id", "blob_id", F.coalesce("spans", nothing).alias("spans"))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One scan without a ledger: :func:`spans_by_path` of all findings."""
    return spans_by_path(documents, scan_unseen(documents, None, rules)[0], rules)


class Ledger:
    """The ledger and its findings as Parquet tables under a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(str(where)) if there else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._read("seen", "blob_id string, rule string, version int").distinct()

    def findings(self) -> DataFrame:
        return self._read("findings", "blob_id string, kind string, version int, start bigint, end bigint").distinct()

    def record(self, documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scans what is new and records it.

        Findings are written before the ledger: a run that breaks off between
        the two is scanned again, and equal findings count once.
        """
        new, scanned = scan_unseen(documents, self.seen(), rules)
        new.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/seen")

    def update(self, documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Records what is new, and returns the spans of all paths under the present rule versions."""
        self.record(documents, rules)
        now = F.concat_ws("@", "kind", "version").isin([r.label for r in rules])
        return spans_by_path(documents, self.findings().where(now), rules)

    def clear(self) -> None:
        _remove(self.spark, self.folder)
