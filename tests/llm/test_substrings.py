import random

from quillon.llm import substrings


def brute(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            key = (d is None, d)
            first[k] = min(first.get(k, key), key)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (d is None, d) for p in range(i, i + window)}
        out.append((d, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=repr)


def run(frame, rows, window):
    got = substrings.remove_repeats(frame([(d, t, "en", "s") for d, t in rows]), window)
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()], key=repr)


def test_against_brute_force(frame):
    rnd = random.Random(3)
    passage = " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(120))
    rows = []
    for i in range(60):
        own = [f"u{rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 80))]
        lo = rnd.randint(0, 60)
        at = rnd.randint(0, len(own))
        rows.append((i, " \n".join(own[:at] + passage.split()[lo : lo + rnd.randint(0, 70)] + own[at:])))
    rows += [(70, passage), (71, passage), (72, None), (73, ""), (None, passage), (70, passage + " tail")]
    for window in (3, 12, 50):
        assert run(frame, rows, window) == brute(rows, window), window


def test_odd_rows(frame, odd):
    text = "alpha beta gamma " * 40
    rows = [(3, text), (3, text), (4, text), (None, text), (None, None), (5, "short")]
    assert run(frame, rows, 50) == brute(rows, 50)
    assert substrings.remove_repeats(odd).count() == odd.count()
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


def test_rolling_hash_is_the_polynomial():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    got = substrings.rolling(h, 7)[0]
    for i in (0, 1, 100, 193):
        assert int(got[i]) == sum(int(h[i + k]) * pow(substrings.BASE, k, 1 << 64) for k in range(7)) % (1 << 64)
