"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medtab.llm.common import fold
from medtab.llm.sampling import SAMPLE_BYTES, labelled_sample, within_bytes

#: Letters of other scripts that look like Latin ones, and the Latin ones.
LOOKALIKES = str.maketrans("асеорхуіјѕԁһԛԝαεορτυνικ", "aceopxyijsdhqwaeoptuvik")
#: Digits and signs written for letters; folded in words that also hold a letter, but for one letter and one
#: digit ("x3").
SUBSTITUTES = str.maketrans("013457@$", "oieastas")
#: A word, with the signs in it, from its start where it holds a substitute; what stays as it is.
_SPELT = re.compile(r"(?:(?<![\w@$])|(?<=_))[^\W_013457]*+[013457@$](?:[^\W_]++|[@$]++)*+")
_PLAIN = re.compile(r"[\W\d]+|[^\W\d_]\d")
_WORD = re.compile(r"[^\W_]+")
#: Bound of the training sample; shortest and longest word beginnings tried as lexicon entries.
SAMPLE, SHORTEST, LONGEST = 6000, 3, 9
#: Evidence (log likelihood ratio) an entry needs above the log of the number of candidates; least and most weight.
EVIDENCE, LEAST, MOST = 3.5, 1.5, 6.0


def folded(text: str | None) -> str:
    """Whole text with look-alike letters and substituted digits undone: lower-cased words between single spaces."""
    t = unicodedata.normalize("NFKC", text or "").casefold()
    if not t.isascii():
        t = t.translate(LOOKALIKES)
    t = _SPELT.sub(lambda m: m[0] if _PLAIN.fullmatch(m[0]) else m[0].translate(SUBSTITUTES), t)
    return f" {' '.join(_WORD.findall(t))} "


def entries_of(text: str) -> set[str]:
    """What of a folded text may enter the lexicon: whole words, and word beginnings, each with the space before it."""
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


@dataclass
class Lexicon:
    """Weighted entries, exception phrases in which they don't count, and the calibration of the score."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), 0.0))
        if len(a):
            a.make_automaton()
        return a

    def measures(self, text: str, automaton) -> tuple[float, float, float]:
        """Weight of the matches, its rate per 100 words, and the largest weight, over a folded text."""
        if not len(automaton):
            return 0.0, 0.0, 0.0
        hits, excused = [], []
        for end, (n, w) in automaton.iter(text):
            (hits if w else excused).append((end - n + 1, end, w))
        if excused:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in excused)]
        best: dict[int, float] = {}
        for start, _, w in hits:  # entries that begin at one word count once, by the heaviest
            best[start] = max(best.get(start, 0.0), w)
        total = sum(best.values())
        return math.log1p(total), math.log1p(100 * total / max(1, text.count(" ") - 1)), max(best.values(), default=0.0)

    def score(self, m: tuple[float, float, float]) -> float:
        z = self.coef[0] + sum(c * x for c, x in zip(self.coef[1:], m, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 0.01 * np.eye(len(b))
        b -= np.linalg.solve(h, x.T @ (p - y) + 0.01 * b)
    return tuple(float(v) for v in b)


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """Lexicon from one half of the rows; exceptions from it and a quarter, calibration from the last quarter."""
    texts = [(folded(t), int(y > 0)) for t, y in rows]
    mine, seen, tune = texts[::2], texts[::2] + texts[1::4], texts[3::4]
    toxic = sum(y for _, y in mine)
    if not toxic or toxic == len(mine) or not tune:
        return Lexicon({}, [], (-9.0, 0.0, 0.0, 0.0))
    yes: Counter[str] = Counter()
    for t, y in mine:
        if y:
            yes.update(entries_of(t))
    yes = Counter({k: v for k, v in yes.items() if v >= 4})
    no: Counter[str] = Counter()
    for t, y in mine:
        if not y:
            no.update(e for e in entries_of(t) if e in yes)
    share = toxic / len(mine)
    weights = {}
    for term, k in yes.items():
        n = k + no[term]
        odds = math.log((k + 0.5) / (toxic + 1)) - math.log((no[term] + 0.5) / (len(mine) - toxic + 1))
        ratio = k * math.log(k / (n * share)) + (no[term] * math.log(no[term] / (n * (1 - share))) if no[term] else 0)
        if odds >= LEAST and ratio >= EVIDENCE + math.log(len(yes)):
            weights[term] = min(MOST, odds)
    lexicon = Lexicon(weights)
    a = lexicon.automaton()
    good: Counter[str] = Counter()
    bad: set[str] = set()
    for t, y in seen:
        found = set()
        for end, (n, _) in (a.iter(t) if len(a) else ()):
            at = end - n + 1
            left, stop = t.rfind(" ", 0, at), t.find(" ", at + 1)
            right = t.find(" ", stop + 1)
            if left >= 0:
                found.add(t[left : stop + 1])
            if right >= 0:
                found.add(t[at : right + 1])
        if y:
            bad |= found
        else:
            good.update(found)
    lexicon.exceptions = sorted(p for p, k in good.items() if k >= 3 and p not in bad)
    a = lexicon.automaton()
    x = np.array([lexicon.measures(t, a) for t, _ in tune])
    lexicon.coef = _logistic(x, np.array([y for _, y in tune], float))
    return lexicon


def _score(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            scores = [lexicon.score(lexicon.measures(folded(t.as_py()), a)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; labels are learned outside the held-out fold.

    They are learned from about ``sample`` texts with ``sample_bytes`` at most; a text that alone has more than a 64th of that
    teaches nothing.

    Null and empty texts have no match and get the score of that; without toxic or other labels every score is near 0. The
    lexicon matches whole words and word beginnings; where several begin at one word the heaviest counts. Repeated rows are
    scored alike; further columns are ignored.
    """
    picked = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", fold("doc_id", 3) != 1, sample)
    rows = sorted((r.doc_id, r.text or "", r.label) for r in within_bytes(picked.select("doc_id", "text", "label"), sample_bytes).collect())
    lexicon = learn([(t, y) for _, t, y in rows])
    scored = docs.select("doc_id", "text").mapInArrow(_score(lexicon), "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
