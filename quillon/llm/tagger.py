"""A character tagger in numpy: a bidirectional LSTM under a CRF layer.

Training and decoding work on windows of WIDTH characters in batches. Tags
are O, then B and I of each kind.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
WIDTH = 64
TAGS = 1 + 2 * len(KINDS)
_EMBED, _HIDDEN = 12, 16
#: Character classes: digits are one, letters fold to lower case, other ASCII has its own, the rest is one; 0 pads.
CLASSES = 67


def _class_of() -> np.ndarray:
    out = np.full(256, 1, dtype=np.int64)
    for c in range(128):
        if chr(c).isdigit():
            out[c] = 2
        elif chr(c).isalpha():
            out[c] = 3 + ord(chr(c).lower()) - ord("a")
        elif c == 10:
            out[c] = 29
        elif c < 32 or c == 127:
            out[c] = 30
    signs = [c for c in range(32, 127) if not chr(c).isalnum()]
    out[signs] = 31 + np.arange(len(signs))
    return out


_CLASS = _class_of()


def encode(text: str) -> np.ndarray:
    """Classes of the text's code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _CLASS[np.minimum(points, 255)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _allowed() -> np.ndarray:
    """Penalties that forbid I after anything but B or I of its kind."""
    out = np.zeros((TAGS, TAGS), dtype=np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


class Tagger:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"embed": draw(CLASSES, _EMBED) * 4, "out": draw(2 * _HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(_EMBED, 4 * _HIDDEN), f"u{d}": draw(_HIDDEN, 4 * _HIDDEN), f"c{d}": np.zeros(4 * _HIDDEN, np.float32)}
            self.p[f"c{d}"][_HIDDEN : 2 * _HIDDEN] = 1
        self.p["move"] = np.zeros((TAGS, TAGS), np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states [batch, width, hidden] of one direction, and what its gradient needs."""
        n, width = x.shape[:2]
        z = x.reshape(n * width, -1) @ self.p[f"w{d}"] + self.p[f"c{d}"]
        z = z.reshape(n, width, -1)
        h, c = np.zeros((n, _HIDDEN), np.float32), np.zeros((n, _HIDDEN), np.float32)
        out, tape = np.empty((n, width, _HIDDEN), np.float32), []
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            a = z[:, t] + h @ self.p[f"u{d}"]
            g = _sigmoid(a[:, : 3 * _HIDDEN])
            i, f, o = g[:, :_HIDDEN], g[:, _HIDDEN : 2 * _HIDDEN], g[:, 2 * _HIDDEN :]
            s = np.tanh(a[:, 3 * _HIDDEN :])
            before, last = c, h
            c = f * before + i * s
            y = np.tanh(c)
            h = o * y
            out[:, t] = h
            if keep:
                tape.append((t, i, f, o, s, before, y, last))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]
        both = np.concatenate((self._run(e, "f", False)[0], self._run(e, "b", False)[0]), axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags [batch, width] of classes x."""
        return self.best(self.emissions(x))

    def best(self, e: np.ndarray, whole: bool = False) -> np.ndarray:
        """Viterbi tags [batch, width] of emissions; whole: no span began before them."""
        move = self.p["move"] + _allowed()
        v, back = e[:, 0].copy(), np.empty(e.shape, dtype=np.int8)
        if whole:
            v[:, 2::2] -= 1e4
        for t in range(1, e.shape[1]):
            m = v[:, :, None] + move
            back[:, t] = m.argmax(axis=1)
            v = m.max(axis=1) + e[:, t]
        tags = np.empty(e.shape[:2], dtype=np.int8)
        tags[:, -1] = v.argmax(axis=1)
        rows = np.arange(len(e))
        for t in range(e.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        return tags

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y, and its gradient."""
        p, (n, width) = self.p, x.shape
        embedded = p["embed"][x]
        runs = {d: self._run(embedded, d, True) for d in "fb"}
        both = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        e = both @ p["out"] + p["bias"]
        # the CRF's forward and backward sums
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        top = lambda m, axis: m.max(axis=axis, keepdims=True)
        for t in range(1, width):
            m = a[:, t - 1, :, None] + p["move"]
            k = top(m, 1)
            a[:, t] = np.log(np.exp(m - k).sum(axis=1)) + k[:, 0] + e[:, t]
        for t in range(width - 2, -1, -1):
            m = p["move"] + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            k = top(m, 2)
            b[:, t] = np.log(np.exp(m - k).sum(axis=2)) + k[:, :, 0]
        k = top(a[:, -1], 1)
        total = np.log(np.exp(a[:, -1] - k).sum(axis=1)) + k[:, 0]
        rows, cols = np.arange(n)[:, None], np.arange(width)[None, :]
        gold = e[rows, cols, y].sum(axis=1) + p["move"][y[:, :-1], y[:, 1:]].sum(axis=1)
        de = np.exp(a + b - total[:, None, None])
        de[rows, cols, y] -= 1
        de /= n
        pair = np.exp(a[:, :-1, :, None] + p["move"] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None])
        dmove = pair.sum(axis=(0, 1))
        np.subtract.at(dmove, (y[:, :-1], y[:, 1:]), 1)
        g = {"move": dmove / n, "out": both.reshape(-1, 2 * _HIDDEN).T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1))}
        dboth = de @ p["out"].T
        dembedded = np.zeros_like(embedded)
        for part, d in enumerate("fb"):
            dh_all = dboth[:, :, part * _HIDDEN : (part + 1) * _HIDDEN]
            dz = np.empty((n, width, 4 * _HIDDEN), np.float32)
            dh, dc, du = np.zeros((n, _HIDDEN), np.float32), np.zeros((n, _HIDDEN), np.float32), np.zeros_like(p[f"u{d}"])
            for t, i, f, o, s, before, tanh_c, last in reversed(runs[d][1]):
                dh = dh + dh_all[:, t]
                dc = dc + dh * o * (1 - tanh_c**2)
                z = dz[:, t]
                z[:, :_HIDDEN] = dc * s * i * (1 - i)
                z[:, _HIDDEN : 2 * _HIDDEN] = dc * before * f * (1 - f)
                z[:, 2 * _HIDDEN : 3 * _HIDDEN] = dh * tanh_c * o * (1 - o)
                z[:, 3 * _HIDDEN :] = dc * i * (1 - s**2)
                du += last.T @ z
                dh, dc = z @ p[f"u{d}"].T, dc * f
            flat = dz.reshape(n * width, -1)
            g |= {f"w{d}": embedded.reshape(n * width, -1).T @ flat, f"u{d}": du, f"c{d}": flat.sum(axis=0)}
            dembedded += dz @ p[f"w{d}"].T
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x.reshape(-1), dembedded.reshape(n * width, -1))
        return float((total - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 1000, batch: int = 48, rate: float = 0.01, seed: int = 11) -> float:
        """Adam over random batches; returns the mean loss of the last twenty steps."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, g = self._gradient(x[pick], y[pick])
            losses.append(loss)
            size = np.sqrt(sum(float((q**2).sum()) for q in g.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, q in g.items():
                q = q * min(1.0, 5 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))
