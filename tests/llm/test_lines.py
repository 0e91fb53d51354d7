from collections import defaultdict

from quillon.llm import lines


def brute(rows, least):
    sites, first = defaultdict(set), {}
    order = sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0]))
    for _, (d, t, _, s) in order:
        for i, x in enumerate((t or "").split("\n")):
            if k := x.strip(" \t\r"):
                sites[k].add(s or "")
                first.setdefault(k, (d, i))
    out = []
    for d, t, _, _ in rows:
        if t is None:
            out.append((d, None))
            continue
        kept = [x for i, x in enumerate(t.split("\n")) if not ((k := x.strip(" \t\r")) and len(sites[k]) >= least and first[k] != (d, i))]
        out.append((d, "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(frame):
    rows = [(i, f"own line {i}\n common \nshared by few {i // 3}\nlicense\r\n\nlast{i % 2}", "en", f"site{i % 14}") for i in range(40)] + [(90, None, "en", "x"), (91, "common", "en", None), (92, "", "en", "x")]
    docs = frame(rows)
    for least in (1, 2, 7, 10, 14, 15, 16):
        got = lines.without_boilerplate(docs, least)
        assert got.columns == docs.columns
        assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == brute(rows, least), least


def test_only_near_estimates_are_counted_exactly(frame):
    rows = [(i, "everywhere\nnear" if i < 10 else "everywhere", "en", f"s{i}") for i in range(60)]
    found = {r.sites: r.exact for r in lines.boilerplate(frame(rows), 10).collect()}
    assert found[10] is True and [e for s, e in found.items() if s > 50] == [False]


def test_odd_rows(odd):
    got = lines.without_boilerplate(odd, 2)
    assert got.count() == odd.count()
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert (3, "alpha beta\n" + "gamma alpha beta\n" + "gamma ") in {(d, t) for d, t in texts} and (1, None) in texts and (2, "") in texts
    assert lines.without_boilerplate(odd.limit(0)).count() == 0
