r"""Personal data: base patterns, and spans added by a character BiLSTM with a CRF, trained here in numpy.

Base kinds are email, ip, card and phone by their patterns and rules; matches that fail their rule are
dropped and not tried again. The network tags characters (B and I for each kind, O) and adds spans that the
patterns miss: phone numbers without a plus sign, addresses with spaces around the `@` or with bracketed dots,
cards divided by dots or slashes. It learns from labelled spans: windows of the table around base spans and
around other digits (at most MAX_WINDOWS of each, first by a hash of the row: the bound of the training sample),
and made-up contexts of a fixed seed.

Every kind's span holds a digit or `@`, so only windows with one of these are tagged, and for each `@` outside
the base spans all that an address around it could span, in one window (longer where it must be) with the `@`'s
text in its middle; what this window says holds there. So it doesn't matter where windows begin. Windows of WINDOW characters every STRIDE characters cover the whole text. Each gives posterior tag
probabilities by forward-backward; where windows overlap these are averaged, weighted towards a window's
middle, and the tags are read off once for the whole text. A span is added if all its characters are in a span
with a probability of at least CONFIDENCE, it meets the rule of its likeliest kind, and it overlaps no base span.

Defined cases: null text counts as empty: zero counts, empty spans. Offsets are code points, the end
exclusive. Repeated rows each get their row. An empty table gives an empty result (the network then learns
from the made-up contexts only); only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WINDOW, STRIDE, HIDDEN = 64, 48, 20
CONTEXT = 16
MAX_WINDOWS, MADE_UP, EPOCHS, SEED = 1000, 7000, 18, 5
CONFIDENCE, LEAST_SHARE = 0.6, 0.05
TAGS = 1 + 2 * len(KINDS)
# Characters that are a class of their own.
OWN_CLASS = "@.+-()_%:/,;'\"=#&*|<>[]$\n "
CLASSES = 5 + len(OWN_CLASS)
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def holds(kind: str, s: str) -> bool:
    """The rule of a kind, on a match."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits_of(s)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(digits_of(s)) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        out += [(k, m.start(), m.end()) for k, p in (("ip", IP), ("card", CARD), *((("phone", PHONE),) if "+" in text else ())) for m in p.finditer(text) if holds(k, m[0])]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Character class by code point; 0 pads."""
    table = np.full(0x110000, 4, dtype=np.int8)
    table[[i for i in range(0x3000) if chr(i).isalpha() and chr(i).islower()]] = 1
    table[[i for i in range(0x3000) if chr(i).isalpha() and not chr(i).islower()]] = 2
    table[[ord(c) for c in "0123456789"]] = 3
    table[[ord(c) for c in OWN_CLASS]] = 5 + np.arange(len(OWN_CLASS))
    return table


def classes_of(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, dtype=np.int8)
    for kind, s, e in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[s:e] = k + 1
        out[s] = k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """BiLSTM over character classes with CRF transitions. Parameters are a flat dict of small arrays."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = SEED):
        rng = np.random.default_rng(seed)
        h = HIDDEN

        def init(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.2, shape).astype(np.float32)

        self.p = params or {"xf": init(CLASSES, 4 * h), "xb": init(CLASSES, 4 * h), "hf": init(h, 4 * h), "hb": init(h, 4 * h), "out": init(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}

    def _run(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states in the order of the text; what the backward pass needs, in the order of the steps."""
        h, (n, length) = HIDDEN, x.shape
        steps = range(length) if way == "f" else range(length - 1, -1, -1)
        into, wh = self.p["x" + way], self.p["h" + way]
        state, cell = np.zeros((n, h), wh.dtype), np.zeros((n, h), wh.dtype)
        out, kept = np.empty((n, length, h), wh.dtype), []
        for t in steps:
            z = into[x[:, t]] + state @ wh
            s = _sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            new = f * cell + i * g
            tc = np.tanh(new)
            kept.append((t, state, cell, i, f, o, g, tc))
            cell, state = new, o * tc
            out[:, t] = state
        return out, kept

    def _back(self, x: np.ndarray, way: str, kept: list, grad: np.ndarray, into: dict[str, np.ndarray]) -> None:
        n = len(x)
        wh = self.p["h" + way]
        dh, dc = np.zeros((n, HIDDEN), wh.dtype), np.zeros((n, HIDDEN), wh.dtype)
        gx, gh = np.zeros_like(self.p["x" + way]), np.zeros_like(wh)
        one_hot = np.eye(CLASSES, dtype=wh.dtype)[x]
        for t, state, cell, i, f, o, g, tc in reversed(kept):
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            gx += one_hot[:, t].T @ dz
            gh += state.T @ dz
            dh, dc = dz @ wh.T, dc * f
        into["x" + way], into["h" + way] = gx, gh

    def _posteriors(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities and expected transition counts by scaled forward-backward."""
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        m = np.exp(self.p["trans"])
        n, length, k = e.shape
        alpha, beta = np.empty_like(e), np.ones_like(e)
        a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        alpha[:, 0] = a
        for t in range(1, length):
            a = (a @ m) * e[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, t] = a
        pairs = np.zeros((k, k), e.dtype)
        for t in range(length - 2, -1, -1):
            eb = e[:, t + 1] * beta[:, t + 1]
            b = eb @ m.T
            total = (alpha[:, t] * b).sum(axis=1, keepdims=True)
            pairs += (alpha[:, t] / total).T @ eb * m
            beta[:, t] = b / b.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        return gamma / gamma.sum(axis=2, keepdims=True), pairs

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        hidden = np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], axis=2)
        return self._posteriors(hidden @ self.p["out"] + self.p["bias"])[0]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.04, seed: int = SEED) -> Tagger:
        """Minimize the CRF's negative log-likelihood with Adam, the rate falling to zero."""
        rng = np.random.default_rng(seed)
        total = epochs * -(-len(x) // batch)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                step += 1
                self._step(x[order[lo : lo + batch]], y[order[lo : lo + batch]], m1, m2, step, rate * (1 - (step - 1) / total))
        return self

    def _step(self, x: np.ndarray, y: np.ndarray, m1: dict, m2: dict, step: int, rate: float) -> None:
        n, grads = len(x), {}
        (hf, kf), (hb, kb) = self._run(x, "f"), self._run(x, "b")
        hidden = np.concatenate([hf, hb], axis=2)
        gamma, pairs = self._posteriors(hidden @ self.p["out"] + self.p["bias"])
        d = gamma - np.eye(TAGS, dtype=gamma.dtype)[y]
        seen = np.zeros((TAGS, TAGS), gamma.dtype)
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        flat = d.reshape(-1, TAGS)
        grads |= {"out": hidden.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(axis=0), "trans": pairs - seen}
        back = d @ self.p["out"].T
        self._back(x, "f", kf, back[:, :, :HIDDEN], grads)
        self._back(x, "b", kb, back[:, :, HIDDEN:], grads)
        for k, g in grads.items():
            g = g / n
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g**2
            self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)


def windows_of(classes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or `@`."""
    starts = np.arange(0, max(1, len(classes)), STRIDE)
    hit = np.concatenate([[0], np.cumsum((classes == 3) | (classes == 5))])
    ends = np.minimum(starts + WINDOW, len(classes))
    return starts[hit[ends] > hit[starts]]


def _cut(values: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    padded = np.concatenate([values, np.zeros(width, dtype=values.dtype)])
    return padded[starts[:, None] + np.arange(width)]


def around_at(text: str, taken: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of what an email around each `@` outside the base spans could be."""
    out, p = [], text.find("@")
    while p >= 0:
        if not taken[p]:
            s, e = p, p + 1
            s -= s > 0 and text[s - 1].isspace()
            e += e < len(text) and text[e].isspace()
            while s > 0 and text[s - 1] != "@" and not text[s - 1].isspace():
                s -= 1
            while e < len(text) and text[e] != "@" and not text[e].isspace():
                e += 1
            out.append((s, e))
        p = text.find("@", p + 1)
    return out


def _at_posteriors(classes: np.ndarray, spans: list[tuple[int, int]], tagger: Tagger, chunk: int) -> list[np.ndarray]:
    """Tag probabilities of each span, from a window that has it in its middle."""
    out: list[np.ndarray] = [np.empty(0)] * len(spans)
    width = [max(WINDOW, -(-(e - s + CONTEXT) // CONTEXT) * CONTEXT) for s, e in spans]
    for w in sorted(set(width)):
        same = [i for i, x in enumerate(width) if x == w]
        step = max(1, chunk * WINDOW // w)
        for at in range(0, len(same), step):
            part = same[at : at + step]
            starts = np.array([max(0, (sum(spans[i]) - w) // 2) for i in part])
            post = tagger.posteriors(_cut(classes, starts, w).astype(np.int64))
            for i, lo, prob in zip(part, starts, post, strict=True):
                out[i] = prob[spans[i][0] - lo : spans[i][1] - lo]
    return out


def added_spans(text: str, tagger: Tagger, base: list[Span], chunk: int = 1024) -> list[Span]:
    """Spans that the network finds and the patterns do not."""
    classes = classes_of(text)
    starts = windows_of(classes)
    if not len(starts):
        return []
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)
    out: list[Span] = []
    taken = np.zeros(len(text) + 1, dtype=bool)
    for _, s, e in base:
        taken[s:e] = True
    ats = around_at(text, taken)
    at_posts = _at_posteriors(classes, ats, tagger, chunk)
    # what touches is reconciled together: windows, and the texts around `@`; a run's windows are tagged chunk by chunk
    pieces = sorted([(int(s), min(int(s) + WINDOW, len(text))) for s in starts] + ats)
    runs: list[list[int]] = []
    for s, e in pieces:
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(e, runs[-1][1])
        else:
            runs.append([s, e])
    done = 0
    for lo, hi in runs:
        run = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)]
        total, mass = np.zeros((hi - lo + WINDOW, TAGS)), np.zeros(hi - lo + WINDOW)
        for at in range(0, len(run), chunk):
            part = run[at : at + chunk]
            post = tagger.posteriors(_cut(classes, part).astype(np.int64))
            where = (part - lo)[:, None] + np.arange(WINDOW)
            np.add.at(total, where.ravel(), (post * weight[None, :, None]).reshape(-1, TAGS))
            np.add.at(mass, where.ravel(), np.tile(weight, len(part)))
        prob = total[: hi - lo] / np.maximum(mass[: hi - lo, None], 1e-9)
        first = done
        while done < len(ats) and ats[done][0] < hi:
            done += 1
        if done > first:  # where such texts overlap, their mean holds
            total, mass = np.zeros((hi - lo, TAGS)), np.zeros(hi - lo)
            for (s, e), post in zip(ats[first:done], at_posts[first:done], strict=True):
                total[s - lo : e - lo] += post
                mass[s - lo : e - lo] += 1
            prob[mass > 0] = total[mass > 0] / mass[mass > 0, None]
            for e in (e for _, e in ats[first:done] if e < hi and mass[e - lo] == 0):  # no address goes on behind it
                prob[e - lo] = np.eye(TAGS)[0]
        out += [x for x in _read(prob, lo, text) if not taken[x[1] : x[2]].any()]
    return out


def _read(prob: np.ndarray, lo: int, text: str) -> list[Span]:
    """Spans of the tags of text[lo:]: runs that begin at a B tag; a run's kind is the likeliest whose rule it meets."""
    out: list[Span] = []
    tag, inside = prob.argmax(axis=1), 1 - prob[:, 0]
    for b in np.flatnonzero(tag % 2 == 1):
        e = b + 1
        while e < len(tag) and tag[e] and tag[e] % 2 == 0:
            e += 1
        if inside[b:e].min() >= CONFIDENCE:
            s, t = lo + int(b), lo + int(e)
            share = prob[b:e, 1:].reshape(e - b, len(KINDS), 2).sum(axis=2).mean(axis=0)
            kind = next((KINDS[k] for k in np.argsort(-share, kind="stable") if share[k] >= LEAST_SHARE and plausible(KINDS[k], text[s:t])), None)
            if kind:
                out.append((kind, s, t))
    return out


def plausible(kind: str, s: str) -> bool:
    """The rule of an added span: dots of an address may be spaced or in brackets, cards be divided by other signs."""
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+\s?@\s?[^\s@]+\.[^\s@]+", s))
    if kind == "ip":
        plain = re.sub(r"\x20?[\[(]?\.[\])]?\x20?", ".", s)
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", plain)) and holds(kind, plain)
    if kind == "phone":
        return bool(re.fullmatch(r"[(+]?[0-9][\x20().0-9/-]+[0-9]", s)) and bool(re.search(r"[\x20()./-]", s)) and holds(kind, s)
    return bool(re.fullmatch(r"[0-9][\x20.0-9/-]+[0-9]", s)) and holds(kind, s)


def _luhn_valid(digits: str) -> str:
    """digits with its last one set so that the Luhn sum holds."""
    return next(d for k in "0123456789" if luhn(d := digits[:-1] + k))


def shapes(rng: np.random.Generator) -> dict[str, list]:
    """Makers of one value each: of every kind, of shapes that the base patterns see and that they miss; under "" what is none."""
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    w = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    n = lambda: str(rng.integers(2, 10)) + d(2)
    end = lambda: str(rng.choice(["com", "org", "net", "de", "co.uk", "io"]))

    def card(sep: str, sizes: tuple[int, ...] = (4, 4, 4, 4)) -> str:
        digits = _luhn_valid(str(rng.integers(3, 7)) + d(sum(sizes) - 1))
        return sep.join(digits[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))

    quad = lambda: [str(x) for x in rng.integers(0, 256, 4)]
    return {
        "email": [lambda: f"{w()}.{d(2)}@{w()}.{end()}", lambda: f"{w()}_{w()}@{w()}-{w()}.{end()}", lambda: f"{w()}@{w()}{d(1)}.{w()}.{end()}", lambda: f"{w()} @ {w()}.{end()}", lambda: f"{w()}.{w()} @ {w()}.{end()}", lambda: f"{w()}@ {w()}.{end()}", lambda: f"{w()}{d(2)} @{w()}.{end()}"],
        "ip": [lambda: ".".join(quad()), lambda: ".".join(quad()), lambda: "[.]".join(quad()), lambda: " . ".join(quad()), lambda: "(.)".join(quad())],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("-"), lambda: card("."), lambda: card("."), lambda: card("/"), lambda: card(".", (4, 6, 5)), lambda: card("  ")],
        "phone": [
            lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"({n()}) {d(3)}-{d(4)}", lambda: f"{n()}-{d(3)}-{d(4)}", lambda: f"{n()}-{d(3)}-{d(4)}", lambda: f"+{d(11)}", lambda: f"{n()}/{d(3)}-{d(4)}",
            lambda: f"{n()} {d(3)} {d(4)}", lambda: f"{n()}.{d(3)}.{d(4)}", lambda: f"1-{n()}-{d(3)}-{d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"0{d(4)} {d(6)}", lambda: f"({d(3)}) {d(4)} {d(4)}", lambda: f"0{d(2)}-{d(4)}-{d(4)}", lambda: f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(3)}",
        ],
        "": [
            lambda: d(rng.integers(1, 9)), lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(3)}{w()}{d(2)}", lambda: f"{w()}{d(3)}{w()}{d(4)}", lambda: f"@{w()}", lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"{d(2)} x {d(2)}",
            lambda: d(rng.integers(20, 41)), lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"{d(1)}.{d(4)}, -{d(2)}.{d(4)}", lambda: f"{w()} @ {w()}", lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)}", lambda: f"20{d(2)}-20{d(2)}", lambda: f"v{d(1)}.{d(1)}.{d(1)}", lambda: d(10), lambda: f"{d(5)}-{d(4)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}",
        ],
    }


def made_up(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Texts of made-up words around one to three values: labelled spans, or digit strings that are none."""
    rng = np.random.default_rng(seed)
    kinds = shapes(rng)
    plain = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))

    def word() -> str:
        w, style = plain(), rng.integers(0, 12)
        return w.upper() + "!!" * int(rng.integers(0, 2)) if style == 0 else w.capitalize() if style < 3 else w + str(rng.choice([*".,!;"])) if style < 5 else w

    out = []
    for i in range(n):
        room = int(rng.integers(0, 40))  # of the words before; none now and then
        text, spans = "".join(f"{word()} " for _ in range(6))[-room:] if room else "", []
        for j in range(1 + (i % 3 == 0) * int(rng.integers(1, 3))):
            kind = [*KINDS, "phone", "email", "", ""][(i + j * int(rng.integers(1, 8))) % 8]
            value = kinds[kind][rng.integers(0, len(kinds[kind]))]()
            if text and rng.integers(0, 3) == 0:
                text = text[:-1] + str(rng.choice([*" :,=(\n\"'|"]))
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + str(rng.choice([" ", ". ", ", ", "\n", ") ", " ", '" ', "; "])) + "".join(f"{word()} " for _ in range(rng.integers(1, 4)))
        out.append((text + "".join(f"{word()} " for _ in range(6)), spans))
    return out


def _made_up(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    texts = made_up(n, seed)
    zero = np.array([0])
    return np.array([_cut(classes_of(t), zero)[0] for t, _ in texts]), np.array([_cut(tags_of(len(t), s), zero)[0] for t, s in texts])


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for order, text in zip(batch["order"], batch["text"], strict=True):
            classes, tags = classes_of(text), tags_of(len(text), base_spans(text))
            starts = windows_of(classes)
            for s, x, y in zip(starts, _cut(classes, starts), _cut(tags, starts), strict=True):
                if y[0] == 0 or y[0] % 2 == 1:  # begins outside a span
                    rows.append((order, int(s), bool(y.any()), x.tobytes(), y.tobytes()))
        yield pd.DataFrame(rows, columns=["order", "at", "positive", "x", "y"])


def train_tagger(docs: DataFrame, most: int = MAX_WINDOWS, made: int = MADE_UP, epochs: int = EPOCHS) -> Tagger:
    rows = docs.filter(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("order"), "text")
    found = rows.mapInPandas(_sample, "order long, at long, positive boolean, x binary, y binary").distinct()
    xs, ys = _made_up(made, SEED)
    for sign in (True, False):
        part = found.filter(F.col("positive") == sign).orderBy("order", "at", "x", "y").limit(most).collect()
        if part:
            xs = np.concatenate([xs, [np.frombuffer(r["x"], dtype=np.int8) for r in part]])
            ys = np.concatenate([ys, [np.frombuffer(r["y"], dtype=np.int8) for r in part]])
    return Tagger().fit(xs.astype(np.int64), ys.astype(np.int64), epochs)


def _find(params: dict[str, np.ndarray]):
    def work(texts: list[str]) -> dict[str, pa.Array]:
        tagger, rows = Tagger(params), []
        for text in texts:
            base = base_spans(text)
            more = added_spans(text, tagger, base) if "@" in text or DIGIT.search(text) else []
            rows.append(([sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
        counts = {f"n_{k}": pa.array([r[0][i] for r in rows], pa.int64()) for i, k in enumerate(KINDS)}
        return counts | {"base_sha256": pa.array([r[1] for r in rows], pa.string()), "spans": pa.array([r[2] for r in rows], pa.string())}

    return work


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tagger = tagger or train_tagger(rows)
    return beside(rows, ["doc_id"], _find(tagger.p), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
