"""URL filter: the ratio of two character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs,
give each character the probability that follows its longest known context,
smoothed by the next shorter one. A URL's score is the difference of its log
likelihoods a character; it is rejected if the score is over a threshold that
a held-out part of the labelled URLs calibrates.

The models are one table: for each gram (a context and the character after
it), by how much that gram moves the log ratio given by its own suffix. All
suffixes of a known gram are known, so the sum of the table's entries over a
URL's grams is the sum over its characters of the longest match. Entries are
whole millionths: sums do not depend on the order of rows.

Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fits, stored

#: Longest gram: four characters of context and the one after them.
ORDER = 5
#: Weight of the shorter context in the smoothing.
SMOOTH = 4.0
#: Number of characters a URL may be made of, for the order-0 floor.
ALPHABET = 128
UNIT = 1_000_000
#: Labelled URLs whose MD5 begins with one of these digits (three in sixteen) set the threshold and train nothing.
HELD_OUT = "012"
#: Scores are binned by this much (in nats a character) to find the threshold, up to the limit either way.
BIN, LIMIT = 0.01, 10.0

#: Fixed values: (host, path, verdict); a rule fits its host and all subdomains of it.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict); null if none fits. Of two equally long ones the first listed wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character and gram length: keep, _g (the gram), _n its length."""
    marked = F.concat(F.lit("\x02"), F.col("_u"), F.lit("\x03"))
    at = urls.select(*keep, marked.alias("_marked"), F.explode(F.sequence(F.lit(2), F.length("_u") + 2)).alias("_i"))
    at = at.select(*keep, "_marked", "_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDER), F.col("_i")))).alias("_n"))
    return at.select(*keep, F.substring(F.col("_marked"), F.col("_i") - F.col("_n") + 1, F.col("_n")).alias("_g"), "_n")


def model(labelled: DataFrame) -> DataFrame:
    """The gram table (gram, n, delta) of labelled URLs (_u, _bad).

    delta: millionths of a nat by which the gram moves log P(rejected) - log
    P(accepted). The table is bounded by the alphabet to the power of ORDER.
    """
    bad = F.col("_bad")
    counts = _grams(labelled, "_bad").groupBy("_g", "_n").agg(F.sum(F.when(bad, 1).otherwise(0)).alias("b"), F.sum(F.when(bad, 0).otherwise(1)).alias("a"))
    ctx = counts.groupBy(F.expr("substring(_g, 1, _n - 1)").alias("_c"), F.col("_n").alias("_cn")).agg(F.sum("b").alias("cb"), F.sum("a").alias("ca"))
    base = counts.join(ctx, (F.expr("substring(_g, 1, _n - 1)") == F.col("_c")) & (F.col("_n") == F.col("_cn")))
    base = stored(base.select("_g", "_n", "a", "b", "ca", "cb"), "url-grams")
    prob = lambda n, total, below: (F.col(n) + SMOOTH * below) / (F.col(total) + SMOOTH)
    level = base.where("_n = 1").select("_g", "_n", *[((F.col(n) + 1.0) / (F.col(t) + float(ALPHABET))).alias(f"p{n}") for n, t in (("a", "ca"), ("b", "cb"))])
    level = level.withColumn("_d", F.log(F.col("pb") / F.col("pa")))
    out = level
    for n in range(2, ORDER + 1):
        below = level.select(F.col("_g").alias("_s"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        level = base.where(F.col("_n") == n).join(below, F.expr("substring(_g, 2)") == F.col("_s"))
        level = level.select("_g", "_n", "qa", "qb", prob("a", "ca", F.col("qa")).alias("pa"), prob("b", "cb", F.col("qb")).alias("pb"))
        level = level.withColumn("_d", F.log(F.col("pb") / F.col("pa")) - F.log(F.col("qb") / F.col("qa")))
        level = stored(level, "url-level")  # each level is read by the next one and by the result
        out = out.select("_g", "_n", "_d").unionByName(level.select("_g", "_n", "_d"))
    return out.select(F.col("_g").alias("gram"), F.col("_n").alias("n"), F.floor(F.col("_d") * UNIT + 0.5).cast("bigint").alias("delta"))


def score(urls: DataFrame, table: DataFrame, table_bytes: int, *keep: str) -> DataFrame:
    """keep and score, the log-likelihood ratio a character, of distinct rows (keep, _u).

    A table that may not be broadcast is joined by shuffle, of the grams with
    a 128-bit name of their URL: the URL itself is not sent with each gram.
    """
    if fits(1, table_bytes):
        hit = _grams(urls, *keep, "_u").join(F.broadcast(table), F.col("_g") == F.col("gram"), "left")
        total = hit.groupBy(*keep, "_u").agg(F.sum(F.coalesce("delta", F.lit(0))).alias("_t"))
    else:
        name = [F.xxhash64("_u").alias("_a"), F.xxhash64(F.lit(1), F.col("_u")).alias("_b")]
        hit = named_grams(urls, name).join(table, F.col("_g") == F.col("gram"))
        sums = hit.groupBy("_a", "_b").agg(F.sum("delta").alias("_s")).select(F.col("_a").alias("_sa"), F.col("_b").alias("_sb"), "_s")
        total = urls.select(*keep, "_u", *name).join(sums, (F.col("_a") == F.col("_sa")) & (F.col("_b") == F.col("_sb")), "left")
        total = total.select(*keep, "_u", F.coalesce("_s", F.lit(0)).alias("_t"))
    return total.withColumn("score", F.col("_t") / F.lit(float(UNIT)) / (F.length("_u") + 1)).drop("_t")


def named_grams(urls: DataFrame, name: list[Column]) -> DataFrame:
    """(_a, _b, _g) of distinct URLs (_u)."""
    return _grams(urls.select("_u", *name), "_a", "_b").select("_a", "_b", "_g")


def threshold(scored: DataFrame) -> float:
    """The score that tells rejected from accepted URLs best, from rows (score, _bad, _m), _m being a number of URLs.

    It has the largest sum of both classes' shares of right verdicts; ties
    take the lowest. Only counts by bin reach the driver, one row for each of
    a fixed number of bins. Zero if a class is missing.
    """
    b = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score")))
    bins = scored.groupBy(F.floor(b / BIN).cast("int").alias("bin")).agg(F.sum(F.when(F.col("_bad"), F.col("_m")).otherwise(0)).alias("b"), F.sum("_m").alias("n"))
    rows = sorted((r["bin"], r["b"], r["n"] - r["b"]) for r in bins.collect())
    bad, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not bad or not good:
        return 0.0
    best, cut, below_bad, below_good = -1.0, 0.0, 0, 0
    for k, x, y in rows:
        share = (bad - below_bad) / bad + below_good / good
        if share > best:
            best, cut = share, k * BIN
        below_bad, below_good = below_bad + x, below_good + y
    return cut


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of pages: page_id, url, host, path, rule, verdict, score.

    URLs that a rule decides are the labelled ones: the models learn from
    thirteen in sixteen of them and the rest sets the threshold; all counts cover all
    rows. Other URLs are blocked if their score is at least the threshold.
    Null and empty urls have score 0 and are allowed, as is every url if no URL is labelled.
    Equal urls have equal scores, and repeated rows one result each.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    found = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_r", found).select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("_v"))
    rows = rows.withColumn("_u", F.concat("host", F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*(.*)$", 1)))
    labelled = rows.where("_v is not null").select("_u", (F.col("_v") == "block").alias("_bad"))
    held = F.substring(F.md5(F.encode("_u", "UTF-8")), 1, 1).isin(*HELD_OUT)
    table = stored(model(labelled.where(~held)), "url-model")
    grams, text = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()
    size = 64 * grams + text
    held_scores = score(labelled.where(held).groupBy("_u", "_bad").agg(F.count("*").alias("_m")), table, size, "_bad", "_m")
    cut = threshold(held_scores)
    # each distinct url is scored once, which also takes the heat out of a url that many rows share
    scores = score(rows.where("_u <> ''").select("_u").distinct(), table, size).select(F.col("_u").alias("_su"), "score")
    out = rows.join(scores, F.col("_u") == F.col("_su"), "left")
    by_model = F.when(F.col("score") >= cut, "block").otherwise("allow") if grams else F.lit("allow")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("_v", by_model).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))
