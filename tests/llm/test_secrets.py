import re

from quillon.llm import secrets

ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def brute(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


TEXTS = [
    None, "", "nothing", "Token: 'abcdef'", "token=ab token = abcdefgh", "token=token:abcdefgh", "password=abcde", "\u00e9\U0001f600 api_key=\"ABC/def+1\" x", "AKIA" + "Z" * 15, "AKIA" + "Z9" * 8 + " AKIA1", "AKIAAKIA" + "B" * 20,
    "f" * 23, "f" * 24 + "g" + "0" * 40, "secret==" + "0123456789abcdef" * 3, "SECRET : x" * 50 + "passwd=longenough1", "ghp_" + "a1" * 20, "xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "token='abcdef' " * 3000,
]


def test_base_against_brute_force(frame):
    docs = frame([(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    got = {r.doc_id: [(s.start, s.rank, s.kind, s.end) for s in r.spans if s.kind in secrets.BASE] for r in secrets.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_added_kinds(frame):
    docs = frame([(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    kinds = {r.doc_id: {s.kind for s in r.spans} for r in secrets.scan(docs).collect()}
    assert "github" in kinds[15] and "slack" in kinds[16] and "pem" in kinds[17]


def test_ledger_scans_only_what_is_new(spark, frame, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    first = frame([(1, "token=abcdefgh", "en", "s"), (2, "token=abcdefgh", "en", "s"), (3, "clean", "en", "s")])
    spans = lambda df: {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in df.collect()}
    assert spans(ledger.update(first)) == {1: [("assign", 0, 14)], 2: [("assign", 0, 14)], 3: []}
    seen = ledger.seen().count()
    assert seen == 2 * len(secrets.RULES)
    second = first.unionByName(frame([(4, "clean", "en", "s"), (5, "new token=abcdefgh", "en", "s")]))
    assert secrets.scan_unseen(second, ledger.seen())[1].select("blob_id").distinct().count() == 1
    assert spans(ledger.update(second))[5] == [("assign", 4, 18)]
    newer = tuple(secrets.Rule(r.kind, 2, r"clean") if r.kind == "hex" else r for r in secrets.RULES)
    findings, scanned = secrets.scan_unseen(second, ledger.seen(), newer)
    assert {(r.rule, r.version) for r in scanned.collect()} == {("hex", 2)} and findings.count() == 1
    assert spans(ledger.update(second, newer))[4] == [("hex", 0, 5)]
    ledger.clear()


def test_odd_rows(odd):
    assert secrets.scan(odd).count() == odd.count()
    assert secrets.scan(odd.limit(0)).count() == 0
