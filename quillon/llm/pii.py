"""Personal data: base patterns, and a trained character tagger that adds to them.

The tagger learns from labelled spans: windows of the corpus around the base
matches and around other digits, the same windows with their matches rewritten
the way people hide them (``a [at] b [dot] c``, ``1[.]2[.]3[.]4``, phones
without a plus), and windows without a match that get such a span.

What it adds must have the form of its kind (:data:`FORMS`), and every such
form holds a digit, an at sign or a written-out ``at`` (:data:`_MARK`). So only
overlapping windows around those marks are decoded: a span that holds none of
them could not be added. Where windows overlap, a character's emissions are
their mean, weighed by how central it is in each, and one Viterbi search runs
over the whole stretch of windows that touch. A span that is found is set to
the bounds of the form that it lies on.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tagger import KINDS, TAGS, WIDTH, Tagger, encode

#: Windows that train the tagger: so many with base matches, so many without (the bound of the labelled sample).
TRAIN_WINDOWS = 1500
#: Steps between windows, and characters on either side of a mark that are looked at.
STRIDE, MARGIN = 32, 24

# The base patterns.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[\[({ ](?:at|AT)[\])} ]")
_DIGIT = re.compile(r"[0-9@]")

_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?"
_AT = r"(?:\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s@\s?|@\s)"
_DOT = r"(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\.)"
#: By kind, what a span that the tagger adds looks like: an e-mail hidden by brackets or by spaces, an address by brackets or spaces, a card as in base, a phone of three groups or more.
FORMS = (
    re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{_NAME}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+|{_NAME}\s(?:at|AT)\s[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s[A-Za-z0-9-]+)+|{_NAME}@[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)"),
    re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\s?[\[({]\.[\])}]\s?|\s\.\s?|\.\s?)[0-9]{1,3}){3}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,18}(?![0-9])"),
    re.compile(r"(?<![0-9])(?:tel:|\()?[0-9]{3,5}(?:[ .-][0-9]{2,9}){2,3}(?![0-9])"),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign takes all local characters before it, from the last match on; a text is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not _DIGIT.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for run in _DOTTED.finditer(text) if "." in text else ():
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                    out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


# Training


def _window_of(text: str, centre: int) -> tuple[int, int]:
    start = max(0, min(centre - WIDTH // 2, len(text) - WIDTH))
    return start, min(len(text), start + WIDTH)


def free_mark(text: str, base: list[tuple[int, int, int]]) -> int | None:
    """The first mark outside all base spans."""
    spans, upto, k = sorted(base, key=lambda x: x[1]), 0, 0
    for m in _MARK.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            upto, k = max(upto, spans[k][2]), k + 1
        if m.start() >= upto:
            return m.start()
    return None


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text one window around a base match and one around another digit, if it has such; texts are told apart by what they hold, so any order gives the same."""
    for b in batches:
        texts, spans, found = [], [], []
        for value in b.column(0):
            text = value.as_py() or ""
            base = base_spans(text)
            rnd = random.Random(len(text))
            if base:
                k, s, e = rnd.choice(base)
                lo, hi = _window_of(text, (s + e) // 2)
                texts.append(text[lo:hi])
                spans.append([x for k, s, e in base if lo <= s and e <= hi for x in (k, s - lo, e - lo)])
                found.append(True)
            at = free_mark(text, base)
            if at is not None:
                lo, hi = _window_of(text, at)
                texts.append(text[lo:hi])
                spans.append([x for k, s, e in base if s < hi and e > lo for x in (k, max(s, lo) - lo, min(e, hi) - lo)])
                found.append(False)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.bool_())], names=["w", "s", "found"])


def hidden(kind: int, s: str, rnd: random.Random) -> str:
    """The match s as people write it to hide it; cards stay."""
    if kind == 0:
        left, right = rnd.choice([("[", "]"), ("(", ")"), (" ", " "), (" [", "] "), (" (", ") ")])
        user, _, domain = s.partition("@")
        dot = f"{left}dot{right}" if left == " " or rnd.random() < 0.7 else "."
        return f"{user}{left}at{right}{domain.replace('.', dot)}"
    if kind == 1:
        return s.replace(".", rnd.choice(["[.]", "(.)", " . "]))
    if kind == 3:
        d = _digits(s)
        mark = rnd.choice("- .")
        return rnd.choice(["00", "(", "tel:", ""]) + mark.join([d[:3], d[3:6], d[6:]])
    return s


#: Windows that any corpus trains on besides its own: matches of each kind, and digits that are none.
SEEDS = (
    ("write to jane.doe@example.org for more", ((0, 9, 29),)),
    ("server 192.0.2.17 did not answer", ((1, 7, 17),)),
    ("paid with 4111 1111 1111 1111 today", ((2, 10, 29),)),
    ("call +1 (555) 010-4477 before noon", ((3, 5, 22),)),
    ("version 10.4.2 came out on 2021-03-04 at 12:30", ()),
    ("order 123456789 costs 1,299.00 for 3 items", ()),
    ("commit 9f86d081884c7d659a2feaa0c55ad015 (see #42)", ()),
    ("we met at noon (at home) and look at that dot", ()),
)


def invented(kind: int, rnd: random.Random) -> str:
    """A match of the kind that nobody owns."""
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("aaabcdeeefghiiijklmnooopqrstuuvwxyz") for _ in range(rnd.randint(2, 9)))
    if kind == 0:
        return f"{word()}{rnd.choice(['.' + word(), '', num(2), '_' + word()])}@{word()}.{rnd.choice(['com', 'org', 'net', 'example', 'co.uk'])}"
    if kind == 1:
        return ".".join(str(rnd.randint(0, 255)) for _ in range(4))
    if kind == 3:
        return f"+{rnd.randint(1, 99)}{rnd.choice([' ', '-', ' ('])}{num(3)}{rnd.choice([' ', '-', ') '])}{num(3)}{rnd.choice([' ', '-'])}{num(4)}"
    mark = rnd.choice([" ", "-", ""])
    return mark.join([num(4), num(4), num(4), num(4)])


def with_invented(windows: list[tuple[str, list[tuple[int, int, int]]]], rnd: random.Random) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Of each window without a span, the same with an invented one at some white space."""
    out = []
    for text, spans in windows:
        gaps = [m.start() for m in re.finditer(r"\s", text)]
        if not spans and gaps:
            at, kind = rnd.choice(gaps), rnd.choice((0, 1, 3))
            new = invented(kind, rnd)
            out.append((f"{text[:at]} {new}{text[at:]}", [(kind, at + 1, at + 1 + len(new))]))
    return out


def training_set(windows: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of windows with their spans, once as they are and, if they have any, twice with them hidden; and of :func:`with_invented`."""
    rnd = random.Random(seed)
    xs, ys = [], []
    windows = windows + with_invented(windows, rnd)
    for text, spans in windows:
        for copy in range(3 if spans else 1):
            out, marks, last = "", [], 0
            for k, s, e in sorted(spans, key=lambda x: x[1]):
                if s < last:
                    continue
                new = hidden(k, text[s:e], rnd) if copy else text[s:e]
                out += text[last:s]
                marks.append((k, len(out), len(out) + len(new)))
                out, last = out + new, e
            out += text[last:]
            shift = rnd.randint(0, max(0, len(out) - WIDTH))
            x, y = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
            c = encode(out)[shift : shift + WIDTH]
            x[: len(c)] = c
            for k, s, e in marks:
                s, e, cut = s - shift, e - shift, s < shift
                if e > 0 and s < WIDTH:
                    y[max(0, s) : min(WIDTH, e)] = 2 + 2 * k
                    if not cut:
                        y[s] = 1 + 2 * k
            xs.append(x)
            ys.append(y)
    return np.array(xs), np.array(ys)


def labelled_windows(documents: DataFrame, limit: int = TRAIN_WINDOWS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Up to limit windows with base matches, and as many without: those of the smallest hashes. Bounded, whatever the corpus."""
    rows = stored(documents.select("text").mapInArrow(_sample, "w string, s array<int>, found boolean").distinct(), "windows")
    order = [F.xxhash64("w"), "w", "s"]
    got = rows.where("found").orderBy(*order).limit(limit).collect() + rows.where("not found").orderBy(*order).limit(limit).collect()
    return [(r["w"], [tuple(r["s"][i : i + 3]) for i in range(0, len(r["s"]), 3)]) for r in got]


def train(documents: DataFrame, limit: int = TRAIN_WINDOWS) -> Tagger:
    seeds = [(t, list(s)) for t, s in SEEDS] * 8
    tagger = Tagger()
    tagger.fit(*training_set(seeds + labelled_windows(documents, limit)))
    return tagger


# Decoding


def starts(text: str) -> list[int]:
    """Where the text's windows begin: each mark, with its margin, lies in windows half a width apart."""
    out, upto = [], -1
    for m in _MARK.finditer(text):
        lo, hi = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        at = max(lo // STRIDE * STRIDE - STRIDE, upto + 1, 0)
        at = -(-at // STRIDE) * STRIDE
        while at < hi:
            out.append(at)
            upto = at
            at += STRIDE
    return out


def plausible(kind: int, s: str) -> bool:
    """Whether a whole form of the kind is one: octets, check digits, numbers of digits."""
    d = _digits(s)
    if not _MARK.search(s):
        return False
    if kind == 1:
        return all(int(p) <= 255 for p in re.findall(r"[0-9]+", s))
    if kind == 2:
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == 0 or 8 <= len(d) <= 15


def stretches(text: str) -> list[tuple[int, int, list[int]]]:
    """(start, end, window starts) of the windows that touch."""
    out: list[tuple[int, int, list[int]]] = []
    for at in starts(text):
        end = min(len(text), at + WIDTH)
        if out and at <= out[-1][1]:
            start, _, windows = out.pop()
            windows.append(at)
            out.append((start, end, windows))
        else:
            out.append((at, end, [at]))
    return out


def _tags(texts: list[str], tagger: Tagger) -> list[list[tuple[int, np.ndarray]]]:
    """Of each text, (start, tags) of its stretches."""
    found = [(i, s, e, at) for i, t in enumerate(texts) for s, e, at in stretches(t)]
    codes = {i: encode(texts[i]) for i in {x[0] for x in found}}
    sums = [np.zeros((e - s, TAGS), np.float32) for _, s, e, _ in found]
    weight = [np.zeros(e - s, np.float32) for _, s, e, _ in found]
    flat = [(k, at) for k, x in enumerate(found) for at in x[3]]
    centre = 1 + np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1]).astype(np.float32)
    for lo in range(0, len(flat), 512):
        part = flat[lo : lo + 512]
        x = np.zeros((len(part), WIDTH), np.int64)
        for row, (k, at) in enumerate(part):
            c = codes[found[k][0]][at : at + WIDTH]
            x[row, : len(c)] = c
        for (k, at), e in zip(part, tagger.emissions(x)):
            i, s, _, _ = found[k]
            n = min(WIDTH, len(codes[i]) - at)
            w = centre[:n].copy()
            # at a text's ends there is nothing more to see
            if at == 0:
                w[: WIDTH // 2] = WIDTH
            if at + n == len(codes[i]):
                w[n // 2 :] = WIDTH
            sums[k][at - s : at - s + n] += w[:, None] * e[:n]
            weight[k][at - s : at - s + n] += w
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    order = sorted(range(len(found)), key=lambda k: len(weight[k]))
    while order:
        # stretches of like length together, a bounded number of cells at once
        many = max(1, min(512, (1 << 18) // len(weight[order[-1]])))
        group, order = order[-many:], order[:-many]
        longest = len(weight[group[-1]])
        e = np.full((len(group), longest, TAGS), -1e4, np.float32)
        e[:, :, 0] = 0
        for row, k in enumerate(group):
            e[row, : len(weight[k])] = sums[k] / weight[k][:, None]
        for k, t in zip(group, tagger.best(e, True)):
            out[found[k][0]].append((found[k][1], t[: len(weight[k])]))
    return out


def added_spans(texts: list[str], tagger: Tagger, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Of each text, the forms that the tagger finds and that overlap no base span, nor each other."""
    out = []
    for text, tags, known in zip(texts, _tags(texts, tagger), base):
        hits: list[tuple[int, int, int]] = []
        for start, t in tags:
            kind = np.where(t > 0, (t + 1) // 2, 0)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], kind, [0]))))
            hits += [(int(kind[a]) - 1, start + int(a), start + int(b)) for a, b in zip(edge[:-1], edge[1:]) if kind[a]]
        found: list[tuple[int, int, int]] = []
        for k in sorted({h[0] for h in hits}):
            own = sorted((s, e) for x, s, e in hits if x == k)
            at = 0
            for m in FORMS[k].finditer(text):
                while at < len(own) and own[at][1] <= m.start():
                    at += 1
                # the tagger must have at least half of the form
                covered, j = 0, at
                while j < len(own) and own[j][0] < m.end():
                    covered += min(own[j][1], m.end()) - max(own[j][0], m.start())
                    j += 1
                if 2 * covered >= m.end() - m.start() and plausible(k, m.group()):
                    found.append((k, m.start(), m.end()))
        taken = sorted(((s, e) for _, s, e in known))
        kept: list[tuple[int, int, int]] = []
        for k, s, e in sorted(found, key=lambda x: (x[1], x[0])):
            j = bisect_left(taken, (s, e))
            clash = any(s < y and x < e for x, y in taken[max(0, j - 4) : j + 4]) or (kept and kept[-1][2] > s)
            if not clash:
                kept.append((k, s, e))
        out.append(kept)
    return out


def find(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Per row of documents: doc_id and spans, an array of (kind, start, end, base) by kind as listed, then start.

    start and end count code points. A null or empty text has no spans.
    Repeated rows have equal results. Trains a tagger if none is given.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tagger or train(documents))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t.as_py() or "" for t in part.column(1)]
                base = [base_spans(t) for t in texts]
                added = added_spans(texts, shared.value, base)
                rows = [
                    [{"kind": KINDS[k], "start": s, "end": e, "base": own} for k, s, e, own in sorted([(*x, True) for x in p] + [(*x, False) for x in q])]
                    for p, q in zip(base, added)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= last:
            out += [text[last:s], f"<{kind}>"]
            last = e
    return "".join([*out, text[last:]])
