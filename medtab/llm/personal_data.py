"""Personal data in texts: exact patterns, and a character tagger that adds what patterns miss.

The tagger is a bidirectional LSTM over characters with a CRF over its tags, trained in numpy from labelled spans. It reads
overlapping windows of a text; each window is decoded by itself, spans that an edge cuts are joined with their other part, and
the spans of all windows of a text are reconciled at once: of spans that overlap, the set of the largest total weight stays.
An added span must pass the check of its kind and leaves what the patterns found untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medtab.llm.common import give_back

#: The kinds, in order.
KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, by how much windows overlap, and how far around an anchor windows reach.
WINDOW, OVERLAP, CONTEXT = 64, 32, 32
#: What may belong to personal data of these kinds holds one of these: a digit, an at sign, or such a sign spelled out.
ANCHOR = r"[0-9@]|[(\[{]at[)\]}]|\bdot\b"
#: Bounds of the training sample: documents looked at, snippets taken of each and of all, and windows made of them.
SAMPLE, SNIPPETS, MOST_SNIPPETS, TRAIN = 6000, 8, 1500, 1600
#: Width of each direction, passes over the training windows, windows of a step, and the least confidence of an added span.
WIDTH, EPOCHS, STEP, CONFIDENCE = 16, 10, 32, 0.7

_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its first digit only: later starts fail where the first does
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(ANCHOR)


def luhn(text: str) -> bool:
    """Whether the digits of a text pass the check of card numbers."""
    digits = [int(c) for c in text if "0" <= c <= "9"][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(digits)) % 10 == 0


def _digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def _parts_fit(text: str) -> bool:
    parts = re.findall(r"[0-9]+", text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def fits(kind: str, text: str) -> bool:
    """The check that a span of a kind must pass, however it is written."""
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text) and re.search(r"\.|\bdot\b", text))
    if kind == "ip":
        return _parts_fit(text)
    return 12 <= _digits(text) <= 19 and luhn(text) if kind == "card" else 9 <= _digits(text) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the patterns find, by start and kind; leftmost and non-overlapping in each kind, failing
    matches dropped. Time grows with the text's length only."""
    out, done = [], 0
    for at in (m.start() for m in re.finditer("@", text)):
        if host := _EMAIL_HOST.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = host.end()
                out.append((start, 0, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _parts_fit(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= _digits(m[0]) <= 19 and luhn(m[0])]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= _digits(m[0]) <= 15]
    return sorted(out)


# characters as classes: letters a to z, a digit, the marks below each by itself, white space, other letters, all else
_MARKS = ".@+-()[]{}_%:/\"'="
PAD, OTHER, FOREIGN, BREAK, SPACE, DIGIT = range(6)
CLASSES = 6 + len(_MARKS) + 26
_CLASS = np.full(128, OTHER, np.int64)
_CLASS[[9, 10, 11, 12, 13]] = BREAK
_CLASS[32] = SPACE
_CLASS[48:58] = DIGIT
for _k, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 6 + _k
_CLASS[65:91] = _CLASS[97:123] = 6 + len(_MARKS) + np.arange(26)


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], FOREIGN)


#: Tags: outside, then first and further character of each kind.
TAGS = 1 + 2 * len(KINDS)
_BAR = -1e4
#: Which tag may follow which: a further character only behind a character of its kind.
ALLOWED = np.array([[j == 0 or j % 2 == 1 or i in (j, j - 1) for j in range(TAGS)] for i in range(TAGS)])
OPENING = np.array([j == 0 or j % 2 == 1 for j in range(TAGS)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


@dataclass
class Tagger:
    """Parameters by name: gate inputs of each class (``x``), recurrent weights (``h``) of both directions, output, transitions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 11, width: int = WIDTH) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {}
        for side in ("f", "b"):
            p[f"x{side}"] = rng.normal(0, 0.3, (CLASSES, 4 * width))
            p[f"x{side}"][:, width : 2 * width] += 1.0  # remember at first
            p[f"h{side}"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * width))
        p |= {"o": rng.normal(0, 0.3, (2 * width, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
        return Tagger(p)

    def transitions(self) -> np.ndarray:
        return np.where(ALLOWED, self.p["t"], _BAR)

    def run(self, x: np.ndarray, side: str, tape: list | None = None) -> np.ndarray:
        """States of one direction over ``x`` (windows, characters), in order of the text; padding holds no state."""
        wx, wh = self.p[f"x{side}"], self.p[f"h{side}"]
        n, width = len(x), wh.shape[0]
        h, c = np.zeros((n, width), wh.dtype), np.zeros((n, width), wh.dtype)
        out = np.empty((x.shape[1], n, width), wh.dtype)
        for k in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
            z = wx[x[:, k]] + h @ wh
            s = _sigmoid(z[:, : 3 * width])
            i, f, o, g = s[:, :width], s[:, width : 2 * width], s[:, 2 * width :], np.tanh(z[:, 3 * width :])
            live = (x[:, k] != PAD)[:, None]
            before, held = h, c
            c = (f * c + i * g) * live
            t = np.tanh(c)
            h = o * t * live
            out[k] = h
            if tape is not None:
                tape.append((k, i, f, o, g, t, held, before, live))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of (character, window, tag)."""
        return np.concatenate([self.run(x, "f"), self.run(x, "b")], axis=2) @ self.p["o"] + self.p["c"]

    def single(self) -> Tagger:
        """The same in single precision, for tagging."""
        return Tagger({k: v.astype(np.float32) for k, v in self.p.items()})

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of (window, character) under emissions and transitions."""
        t = self.transitions().astype(e.dtype)
        best, back = e[0] + np.where(OPENING, 0, _BAR).astype(e.dtype), []
        for k in range(1, len(e)):
            over = best[:, :, None] + t
            back.append(over.argmax(axis=1))
            best = over.max(axis=1) + e[k]
        tags = [best.argmax(axis=1)]
        for b in reversed(back):
            tags.append(b[np.arange(len(b)), tags[-1]])
        return np.array(tags[::-1]).T

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """Probabilities of (character, window, tag) under emissions and transitions."""
        t = self.transitions().astype(e.dtype)
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0] + np.where(OPENING, 0, _BAR)
        for k in range(1, len(e)):
            a[k] = _logsum(a[k - 1][:, :, None] + t, 1) + e[k]
        for k in range(len(e) - 2, -1, -1):
            b[k] = _logsum(t + (e[k + 1] + b[k + 1])[:, None, :], 2)
        return _softmax(a + b)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags ``y`` of windows ``x``, and its gradient; padding counts for nothing."""
        tapes: dict[str, list] = {"f": [], "b": []}
        state = np.concatenate([self.run(x, "f", tapes["f"]), self.run(x, "b", tapes["b"])], axis=2)
        e, t, n = state @ self.p["o"] + self.p["c"], self.transitions(), len(x)
        steps, mask = x.shape[1], (x != PAD).T
        # windows are padded at their end only
        a = np.empty_like(e)
        a[0] = e[0] + np.where(OPENING, 0, _BAR)
        for k in range(1, steps):
            a[k] = np.where(mask[k][:, None], _logsum(a[k - 1][:, :, None] + t, 1) + e[k], a[k - 1])
        b = np.zeros_like(e)
        for k in range(steps - 2, -1, -1):
            b[k] = np.where(mask[k + 1][:, None], _logsum(t + (e[k + 1] + b[k + 1])[:, None, :], 2), b[k + 1])
        z = _logsum(a[-1], 1)
        tags, live = y.T, mask[1:]
        held = np.eye(TAGS)[tags] * mask[:, :, None]
        de = (np.exp(a + b - z[None, :, None]) * mask[:, :, None] - held) / n
        both = np.exp(a[:-1][:, :, :, None] + t + (e[1:] + b[1:])[:, :, None, :] - z[None, :, None, None]) * live[:, :, None, None]
        dt = both.sum(axis=(0, 1)) - np.einsum("kni,knj->ij", held[:-1], held[1:])
        gold = (e * held).sum(axis=(0, 2)) + (t[tags[:-1], tags[1:]] * live).sum(axis=0)
        grads = {"o": np.einsum("knh,knt->ht", state, de), "c": de.sum(axis=(0, 1)), "t": np.where(ALLOWED, dt / n, 0)}
        ds, width = de @ self.p["o"].T, self.p["hf"].shape[0]
        for side, part in (("f", ds[:, :, :width]), ("b", ds[:, :, width:])):
            wh = self.p[f"h{side}"]
            gh, inputs, places = np.zeros_like(wh), [], []
            dh, dc = np.zeros((n, width)), np.zeros((n, width))
            for k, i, f, o, g, tc, held, before, live in reversed(tapes[side]):
                dh = (dh + part[k]) * live
                dc = (dc + dh * o * (1 - tc * tc)) * live
                dz = np.concatenate([dc * g * i * (1 - i), dc * held * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                inputs.append(dz)
                places.append(x[:, k])
                gh += before.T @ dz
                dh, dc = dz @ wh.T, dc * f
            grads[f"x{side}"], grads[f"h{side}"] = np.eye(CLASSES)[np.concatenate(places)].T @ np.concatenate(inputs), gh
        return float((z - gold).mean()), grads


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, seed: int = 11, width: int = WIDTH) -> Tagger:
    """A tagger from labelled windows ``(text, spans)``, spans as ``(start, kind, end)``; Adam with a falling rate."""
    model = Tagger.fresh(seed, width)
    x = np.full((len(windows), WINDOW), PAD)
    y = np.zeros((len(windows), WINDOW), np.int64)
    for r, (text, spans) in enumerate(windows):
        c = classes(text[:WINDOW])
        x[r, : len(c)] = c
        for start, kind, end in spans:
            y[r, start:end] = 2 + 2 * kind
            y[r, start] = 1 + 2 * kind
    rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
    total = max(1, epochs * -(-len(x) // STEP))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), STEP):
            own = order[at : at + STEP]
            _, grads = model.loss(x[own], y[own])
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-12))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                model.p[k] -= 0.03 * (1 - step / (total + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _redrawn(kind: int, span: str, rng: np.random.Generator) -> str:
    """A span with other digits, written as it is or as people also write its kind."""
    span = re.sub("[0-9]", lambda _: str(rng.integers(10)), span)
    way = rng.integers(6)
    if kind == 0:
        at, dot = [("@", "."), (" @ ", "."), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " dot "), ("@", ".")][way]
        return span.replace("@", at).replace(".", dot) if way in (3, 4) else span.replace("@", at)
    if kind == 1:
        return span.replace(".", " . ") if way == 0 else span
    if kind == 2:
        digits = re.sub("[^0-9]", "", span)
        glue = ["", "", " ", "-", ".", "  "][way]
        return glue.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if glue else span
    return [span, re.sub(r"^\+[0-9]+ ", "", span), span.lstrip("+"), re.sub(r"[()]", "", span), re.sub(r"[^0-9+]+", "-", span), re.sub(r"[^0-9+]+", " ", span)][way]


def _decoy(rng: np.random.Generator) -> str:
    """Text with digits that is none of the kinds."""
    n = lambda a, b: str(rng.integers(a, b))
    return [lambda: n(0, 10 ** int(rng.integers(1, 9))), lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", lambda: f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)} {n(10, 24)}:{n(10, 60)}:{n(10, 60)}", lambda: f"{n(0, 9)}.{n(0, 99)}", lambda: "".join(rng.choice(list("0123456789abcdef"), 40)),
            lambda: f"{n(1, 99)},{n(100, 999)}.{n(10, 99)}", lambda: f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", lambda: f"@{''.join(rng.choice(list('abcdefgh'), 6))}", lambda: f"{n(1, 99)} %", lambda: f"({n(1, 99)})"][rng.integers(10)]()


def windows_of(snippets: list[tuple[str, list[tuple[int, int, int]]]], size: int = TRAIN, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``size`` training windows from labelled snippets: as they stand, with spans written in other ways, with one span right
    behind another, and with decoys in their place."""
    rng, out = np.random.default_rng(seed), []
    pool = [(kind, text[start:end]) for text, spans in snippets for start, kind, end in spans]
    if not snippets:
        return out
    # kinds count alike, however often each occurs
    by = [[p for p in pool if p[0] == k] for k in range(len(KINDS))]
    present = [k for k, p in enumerate(by) if p]
    for r in range(size):
        text, spans = snippets[r % len(snippets)]
        if r % 3 and present:
            # another text around a span: what stood before and behind it here
            a, _, b = spans[0] if spans else (len(text) // 2, 0, len(text) // 2)
            left, right = text[max(0, a - 40) : a], text[b : b + 40]
            middle, own = "", []
            for _ in range(1 + (rng.random() < 0.5)):
                if rng.random() < 0.25:
                    middle += ("" if not middle else " ") + _decoy(rng)
                    continue
                kind, span = by[k := present[rng.integers(len(present))]][rng.integers(len(by[k]))]
                span = _redrawn(kind, span, rng)
                middle += "" if not middle else " "
                own.append((len(middle), kind, len(middle) + len(span)))
                middle += span
            cut = int(rng.integers(0, len(left) + 1))
            text, spans = left[cut:] + middle + right, [(s + len(left) - cut, k, e + len(left) - cut) for s, k, e in own]
            if rng.random() < 0.2:
                text = text.upper() if len(text.upper()) == len(text) else text
        shift = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        kept = sorted((max(s - shift, 0), k, min(e - shift, WINDOW)) for s, k, e in spans if e > shift and s < shift + WINDOW)
        one = [s for i, s in enumerate(kept) if not i or s[0] >= kept[i - 1][2]]
        out.append((text[shift : shift + WINDOW], one))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of overlapping windows that cover every anchor of a whole text with its context."""
    out, segment = [], None
    ends = [(max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)) for m in _ANCHOR.finditer(text)]
    for a, b in [*ends, (len(text) + 1, 0)]:
        if segment and a <= segment[1]:
            segment = (segment[0], max(b, segment[1]))
            continue
        if segment:
            at = segment[0]
            while True:
                out.append((at, min(at + WINDOW, len(text))))
                if at + WINDOW >= segment[1]:
                    break
                at += WINDOW - OVERLAP
        segment = (a, b)
    return out


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of spans ``(start, end, kind, weight)`` those of the largest total weight of which none overlap; of equal sets the one
    whose spans end first."""
    spans = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    best: list[float] = [0.0]
    for i, (start, _, _, weight) in enumerate(spans):
        best.append(max(best[-1], weight + best[bisect_right(ends, start, 0, i)]))
    out, i = [], len(spans)
    while i:
        start, _, _, weight = spans[i - 1]
        before = bisect_right(ends, start, 0, i - 1)
        if best[i] == best[i - 1]:
            i -= 1
            continue
        out.append(spans[i - 1])
        i = before
    return out[::-1]


def _decoded(model: Tagger, texts: list[str], at: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int, float, bool, bool]]]:
    """Spans of windows ``(text, start, end)`` by text: start, end, kind, confidence, and whether an edge cuts them left, right."""
    found: dict[int, list] = {}
    for k in range(0, len(at), 1024):
        own = at[k : k + 1024]
        x = np.full((len(own), WINDOW), PAD)
        for r, (t, a, b) in enumerate(own):
            x[r, : b - a] = classes(texts[t][a:b])
        e = model.emissions(x)
        tags = model.decode(e)
        hold = np.flatnonzero((tags > 0).any(axis=1))
        sure = model.marginals(e[:, hold])
        for place, r in enumerate(hold):
            t, a, b = own[r]
            i = 0
            while i < b - a:
                if tags[r, i] == 0:
                    i += 1
                    continue
                kind, j = (tags[r, i] - 1) // 2, i + 1
                while j < b - a and tags[r, j] == 2 + 2 * kind:
                    j += 1
                confidence = float(np.mean(sure[i:j, place, 1 + 2 * kind] + sure[i:j, place, 2 + 2 * kind]))
                found.setdefault(t, []).append((a + i, a + j, int(kind), confidence, i == 0 and a > 0, j == b - a and b < len(texts[t])))
                i = j
    return found


def _whole(spans: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int, float]]:
    """Spans of all windows of a text, parts that an edge cuts joined where they meet; the weight is confidence by length."""
    out = [(a, b, k, c) for a, b, k, c, left, right in spans if not left and not right]
    parts = sorted(s for s in spans if s[4] or s[5])
    joined: list[list] = []
    for a, b, k, c, left, right in parts:
        if joined and joined[-1][5] and left and joined[-1][2] == k and a <= joined[-1][1]:
            last = joined[-1]
            last[1], last[3], last[5] = max(b, last[1]), min(c, last[3]), right
        else:
            joined.append([a, b, k, c, left, right])
    out += [(a, b, k, c) for a, b, k, c, _, _ in joined]
    most: dict[tuple[int, int, int], float] = {}
    for a, b, k, c in out:
        most[a, b, k] = max(c, most.get((a, b, k), 0.0))
    return [(a, b, k, c * (b - a)) for (a, b, k), c in most.items()]


def tag(texts: list[str | None], model: Tagger | None) -> list[list[tuple[int, int, int, bool, float]]]:
    """``(start, kind, end, added, confidence)`` of each whole text, by start and kind."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    out = [[(s, k, e, False, 1.0) for s, k, e in b] for b in base]
    if model is None:
        return out
    at = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    for i, spans in _decoded(model, texts, at).items():
        taken = sorted((s, e) for s, _, e in base[i])
        starts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
        for a, b, k, weight in reconcile(_whole(spans)):
            raw = texts[i][a:b]
            a, b = a + len(raw) - len(raw.lstrip()), b - len(raw) + len(raw.rstrip())
            before = bisect_right(starts, b - 1)
            if a < b and weight >= CONFIDENCE * len(raw) and fits(KINDS[k], texts[i][a:b]) and not (before and reach[before - 1] > a):
                out[i].append((a, k, b, True, weight / len(raw)))
        out[i].sort()
    return out


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands around the pattern spans of sampled documents, with the spans that it holds whole."""
    for b in batches:
        texts, starts, spans = [], [], []
        for text in b.column(0).to_pylist():
            found = base_spans(text)
            for s, _, e in found[:SNIPPETS]:
                a, z = max(0, s - 48), min(len(text), e + 48)
                inside = [(x - a, k, y - a) for x, k, y in found if a <= x and y <= z]
                texts.append(text[a:z])
                starts.append([v for one in inside for v in one])
                spans.append(len(inside))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(starts, pa.list_(pa.int32()))], ["snippet", "spans"])


def labelled_snippets(docs: DataFrame, sample: int = SAMPLE, most: int = MOST_SNIPPETS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Snippets around pattern spans of about ``sample`` documents, chosen by a hash of the id; at most ``most``."""
    share = min(1.0, sample / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) < int(share * (1 << 30))).where(F.col("text").rlike("[0-9@]"))
    cut = picked.select("text").mapInArrow(_snippets, "snippet string, spans array<int>")
    rows = cut.orderBy(F.xxhash64("snippet"), "snippet").limit(most).collect()
    out = []
    for r in rows:
        flat = list(r.spans)
        # of overlapping spans of two kinds the longer one teaches
        spans = sorted(zip(flat[::3], flat[1::3], flat[2::3], strict=True), key=lambda s: (s[0] - s[2], s[0]))
        kept: list[tuple[int, int, int]] = []
        for s in spans:
            if all(s[0] >= o[2] or s[2] <= o[0] for o in kept):
                kept.append(s)
        out.append((r.snippet, sorted(kept)))
    return out


def trained(docs: DataFrame) -> Tagger | None:
    """A tagger from the pattern spans of a bounded sample of documents; none where there is no span to learn from."""
    windows = windows_of(labelled_snippets(docs))
    return train(windows).single() if windows else None


_SPAN = "array<struct<kind: string, start: int, end: int, added: boolean, confidence: double>>"


def _find(model: Tagger | None):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = part.column(part.schema.get_field_index("__text")).to_pylist()
                found = [[{"kind": KINDS[x], "start": s, "end": e, "added": new, "confidence": c} for s, x, e, new, c in spans] for spans in tag(texts, model)]
                keep = [i for i, f in enumerate(part.schema) if f.name != "__text"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(found, kind)], [*(part.schema.field(i).name for i in keep), "spans"])
        give_back()

    return run


def find(docs: DataFrame, keep: list[str], model: Tagger | None = None) -> DataFrame:
    """Columns ``keep`` with ``spans``: all personal data of every whole text, by start and kind; offsets are code points.

    Spans of the patterns have confidence 1 and are all there; ``added`` ones are the tagger's. Without ``model`` it is trained
    on the patterns' spans of a sample of the documents; where these have none, nothing is added. Null and empty texts have no
    spans; texts without an anchor are not sent to Python. Repeated rows are tagged alike, further columns are ignored.
    """
    model = model or trained(docs)
    rows = docs.select(*keep, F.when(F.col("text").rlike(ANCHOR), F.col("text")).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(_find(model), f"{kinds}, spans {_SPAN}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every document: numbers and hash of the patterns'
    spans, and all spans as ``kind:start:end``, by start and kind."""
    base = F.filter("spans", lambda s: ~s["added"])
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return find(docs, ["doc_id"], model).select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
