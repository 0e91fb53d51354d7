"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM (SELECT *, least(len(w), 8) AS n FROM b WHERE len(w) > 0))
), lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (s)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Rank, kind, pattern, least length of what is kept (of the second group for assign).
_ASSIGN = r'(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?'
_SECRETS = (
    (0, "assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+"),
    (1, "access", r"AKIA[A-Z0-9]+"),
    (2, "hex", r"[0-9a-f]+"),
    (3, "github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    (4, "google", r"AIza[0-9A-Za-z_-]{35}"),
    (5, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    (6, "slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    (7, "pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
_KEPT = {0: rf"regexp_matches(m, '^{_ASSIGN}[A-Za-z0-9+/_.=-]{{6,}}$')", 1: "length(m) >= 20", 2: "length(m) >= 24"}
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(string_split_regex(t, '{p}')) AS p, unnest(regexp_extract_all(t, '{p}') || [NULL]) AS m, "
    f"unnest(range(0, len(string_split_regex(t, '{p}')))) AS i FROM d"
    for k, kind, p in _SECRETS
)

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
e AS (SELECT *, sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, k ORDER BY i) AS z FROM f),
s AS (
  SELECT doc_id, k, kind, CAST(z - length(m) AS BIGINT) AS a, kind || ':' || CAST(CAST(z - length(m) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(z AS BIGINT) AS VARCHAR) AS x
  FROM e WHERE m IS NOT NULL AND CASE k WHEN 0 THEN {_KEPT[0]} WHEN 1 THEN {_KEPT[1]} WHEN 2 THEN {_KEPT[2]} ELSE true END
), g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(x, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 50], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE doc_id > first),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM t ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP9 = r"""
WITH l AS (
  SELECT doc_id, source, x, trim(x, ' ' || chr(9) || chr(13)) AS k, i
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
), b AS (
  SELECT k, min({'d': doc_id, 'i': i}) AS first FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(source, '')) >= 10
), j AS (SELECT l.*, b.first IS NOT NULL AND b.first <> {'d': doc_id, 'i': i} AS gone FROM l LEFT JOIN b USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

def _url_levels() -> str:
    """The smoothed probabilities of grams of each length, from those of their suffixes."""
    out = ["l1 AS (SELECT g, n, (a + 1.0) / (ca + 128.0) AS pa, (b + 1.0) / (cb + 128.0) AS pb, ln(((b + 1.0) / (cb + 128.0)) / ((a + 1.0) / (ca + 128.0))) AS d FROM base WHERE n = 1)"]
    for n in range(2, 6):
        out.append(
            f"q{n} AS (SELECT base.g, base.n, s.pa AS qa, s.pb AS qb, (a + 4.0 * s.pa) / (ca + 4.0) AS pa, (b + 4.0 * s.pb) / (cb + 4.0) AS pb "
            f"FROM base JOIN l{n - 1} s ON substr(base.g, 2) = s.g WHERE base.n = {n}), "
            f"l{n} AS (SELECT g, n, pa, pb, ln(pb / pa) - ln(qb / qa) AS d FROM q{n})"
        )
    return ", ".join(out)


def _url_grams(source: str, keep: str) -> str:
    """Rows (keep, g, n) of the grams of column u."""
    inner = f"SELECT {keep}, chr(2) || u || chr(3) AS m, unnest(range(2, length(u) + 3)) AS i FROM {source}"
    return f"SELECT {keep}, substr(m, i - n + 1, n) AS g, n FROM (SELECT *, unnest(range(1, least(5, i) + 1)) AS n FROM ({inner}))"


OP1 = rf"""
WITH r AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT page_id, {LOWER.format('raw')} AS host, path, {LOWER.format('raw')} || substr(rest, length(raw) + 1) AS u FROM h),
j AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled, md5(u)[1] IN ('0', '1', '2') AS held FROM j),
train AS (SELECT u, CAST(ruled = 'block' AS INT) AS bad FROM v WHERE ruled IS NOT NULL AND NOT held),
counts AS (SELECT g, n, sum(bad) AS b, sum(1 - bad) AS a FROM ({_url_grams('train', 'bad')}) GROUP BY g, n),
ctx AS (SELECT substr(g, 1, n - 1) AS c, n, sum(b) AS cb, sum(a) AS ca FROM counts GROUP BY ALL),
base AS (SELECT g, counts.n, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(ca AS DOUBLE) AS ca, CAST(cb AS DOUBLE) AS cb FROM counts JOIN ctx ON substr(g, 1, counts.n - 1) = c AND counts.n = ctx.n),
{_url_levels()},
model AS (SELECT g, CAST(floor(d * 1000000 + 0.5) AS BIGINT) AS delta FROM ({' UNION ALL '.join(f'SELECT g, d FROM l{n}' for n in range(1, 6))})),
urls AS (SELECT DISTINCT u FROM v WHERE u <> ''),
scores AS (SELECT u, CAST(sum(coalesce(delta, 0)) AS DOUBLE) / 1000000.0 / (length(u) + 1) AS score FROM ({_url_grams('urls', 'u')}) LEFT JOIN model USING (g) GROUP BY u),
held AS (SELECT floor(greatest(-10.0, least(10.0, score)) / 0.01) AS bin, CAST(ruled = 'block' AS INT) AS bad FROM v JOIN scores USING (u) WHERE ruled IS NOT NULL AND held),
bins AS (SELECT bin, sum(bad) AS b, sum(1 - bad) AS a FROM held GROUP BY bin),
cuts AS (SELECT bin, (SELECT sum(b) FROM bins) AS nb, (SELECT sum(a) FROM bins) AS na, coalesce(sum(b) OVER w, 0) AS below_b, coalesce(sum(a) OVER w, 0) AS below_a
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT bin * 0.01 FROM cuts WHERE nb > 0 AND na > 0 ORDER BY (nb - below_b) / nb + below_a / na DESC, bin LIMIT 1), 0.0) AS least)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= (SELECT least FROM cut) THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN scores USING (u)
"""

ORACLES = {
    "op1_urls": OP1,
    "op2_decontaminate": OP2,
    "op8_secrets": OP8,
    "op9_lines": OP9,
    "op10_substrings": OP10,
}
