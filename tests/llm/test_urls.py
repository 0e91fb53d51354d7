import math
import re
from collections import Counter

from quillon.llm import common, urls

DATA = "/root/testdata/sf0.001"


def brute_rule(host, path):
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, None)


def split(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host):]).group(), low + rest[len(host):]


def brute(rows):
    import hashlib

    parsed = {p: split(u) for p, u in rows}
    rules = {p: brute_rule(*parsed[p][:2]) for p, _ in rows}
    train, held = [], []
    for p, _ in rows:
        if rules[p][1]:
            u = parsed[p][2]
            (held if hashlib.md5(u.encode()).hexdigest()[0] in urls.HELD_OUT else train).append((u, rules[p][1] == "block"))

    def grams(u):
        s = "\x02" + u + "\x03"
        return [s[i - n + 1 : i + 1] for i in range(1, len(s)) for n in range(1, min(urls.ORDER, i + 1) + 1)]

    count = {True: Counter(), False: Counter()}
    for u, bad in train:
        count[bad].update(grams(u))
    known = set(count[True]) | set(count[False])
    context = {k: Counter() for k in (True, False)}
    for k, c in count.items():
        for g, n in c.items():
            context[k][len(g), g[:-1]] += n
    prob = {}

    def p(k, g):
        if (k, g) not in prob:
            n, total = count[k][g], context[k][len(g), g[:-1]]
            prob[k, g] = (n + 1) / (total + urls.ALPHABET) if len(g) == 1 else (n + urls.SMOOTH * p(k, g[1:])) / (total + urls.SMOOTH)
        return prob[k, g]

    def delta(g):
        own = math.log(p(True, g) / p(False, g)) - (math.log(p(True, g[1:]) / p(False, g[1:])) if len(g) > 1 else 0)
        return math.floor(own * urls.UNIT + 0.5)

    deltas = {g: delta(g) for g in known}
    score = lambda u: sum(deltas.get(g, 0) for g in grams(u)) / urls.UNIT / (len(u) + 1)
    bins = sorted({math.floor(score(u) / urls.BIN) for u, _ in held})
    bad, good = sum(b for _, b in held), sum(not b for _, b in held)
    cut, best = 0.0, -1.0
    for k in bins if bad and good else ():
        share = sum(b for u, b in held if math.floor(score(u) / urls.BIN) >= k) / bad + sum(not b for u, b in held if math.floor(score(u) / urls.BIN) < k) / good
        if share > best + 1e-12:
            best, cut = share, k * urls.BIN
    out = {}
    for page, _ in rows:
        h, path, u = parsed[page]
        out[page] = (h, path, rules[page][0], rules[page][1] or ("block" if u and known and score(u) >= cut else "allow"))
    return out


def test_whole_table_against_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    want = brute(rows)
    assert got == want


def test_odd_urls(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/x?y#z"), (4, "http://a.example.net/en/x?y#z"), (4, "http://a.example.net/en/x?y#z"), (5, "http://b.net?x"), (6, "http://b.net/"),
        (7, "ftp://x://y/z"), (8, "http://example.com/de/"), (None, "http://notexample.com/de/"), (9, "http://" + "a" * 20_000 + ".org/fr/"), (10, "http://x.com/\n/y"),
    ]
    pages = spark.createDataFrame([(p, u, "clash", 1) for p, u in rows], "page_id long, url string, gram string, _g int")
    got = sorted(((r.page_id or 0, r.host[:20], r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()))
    by = {g[0]: g for g in got}
    assert len(got) == len(rows)
    assert by[1][1:3] == ("", "") and by[1][4] == "allow" and by[2][1:3] == ("", "")
    assert by[3][1:] == ("a.example.net", "/en/x", "example.net/en/", "allow") and by[4][3] == "example.net/en/"
    assert by[5][3] is None and by[6][3:] == ("net/", "block") and by[7][1:3] == ("x:", "//y/z")
    assert by[8][3:] == ("example.com/de/", "block") and by[0][3] is None and by[9][3:] == ("org/fr/", "allow") and by[10][2] == "/\n/y"


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_without_any_broadcast(spark, monkeypatch):
    """A model beyond the broadcast's bound: the same rows, and no URL in what is shuffled by gram."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    before = sorted(map(repr, urls.judge(pages).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, urls.judge(pages).collect())) == before
    from pyspark.sql import functions as F

    named = urls.named_grams(pages.select(F.col("url").alias("_u")).distinct(), [F.xxhash64("_u").alias("_a"), F.xxhash64(F.lit(1), F.col("_u")).alias("_b")])
    sent = named.repartition("_g")._jdf.queryExecution().optimizedPlan().output().mkString(",")
    assert [x.partition("#")[0] for x in sent.split(",")] == ["_a", "_b", "_g"]
