"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, run as Spark column expressions.

Shallow trees are grown on residuals of a bounded labelled sample, every path of a tree is a rule, a lasso logistic
regression keeps few of the rules, and what it keeps is compiled into one column expression. The statistics are column
expressions as well, so scoring the corpus is one projection over the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medtab.llm.common import fold
from medtab.llm.sampling import labelled_sample

#: Bound of the training sample; trees, their depth and the share of rows each sees; lasso strength and steps.
SAMPLE, TREES, DEPTH, SHARE = 8000, 24, 3, 0.6
LASSO, STEPS = 0.002, 800


def statistics() -> dict[str, Column]:
    """Statistics of a text by name, over columns ``t`` (text), ``w`` (its words) and ``l`` (its lines)."""
    n, words, lines = F.greatest(F.length("t"), F.lit(1)), F.greatest(F.size("w"), F.lit(1)), F.greatest(F.size("l"), F.lit(1))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    return {
        "chars": F.log1p(F.length("t").cast("double")),
        "words": F.log1p(F.size("w").cast("double")),
        "word_length": n / words,
        "distinct_words": F.size(F.array_distinct("w")) / words,
        "lines": F.log1p(F.size("l").cast("double")),
        "line_words": words / lines,
        "distinct_lines": F.size(F.array_distinct("l")) / lines,
        "upper": count("[A-Z]") / n,
        "digits": count("[0-9]") / n,
        "marks": count("[#$%&*+<=>@^_`{}~|\\\\]") / n,
        "marks_at_end": count("[#$%&*!|]{2,}(?= |\\n|$)") / words,
        "stops": count("[.,;:?!]") / words,
        "capitals": count("[A-Z]{2,}") / words,
        "pipes": count(" \\| ") / words,
    }


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with one double column ``s_<name>`` for each statistic of the whole text (null: as empty)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, text.alias("t")).select(*keep, "t", F.filter(F.split("t", "\\s+"), lambda x: x != "").alias("w"), F.filter(F.split("t", "\\n"), lambda x: x != "").alias("l"))
    return base.select(*keep, *(c.cast("double").alias(f"s_{k}") for k, c in statistics().items()))


@dataclass
class Rule:
    """A conjunction of ``(statistic, above, threshold)`` terms, with its weight."""

    terms: list[tuple[str, bool, float]]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.terms:
            c = F.col(f"s_{name}")
            out = out & ((c > t) if above else (c <= t))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, t in self.terms:
            v = x[:, names.index(name)]
            out &= v > t if above else v <= t
        return out


def _paths(x: np.ndarray, r: np.ndarray, names: list[str], terms: list, depth: int) -> list[list]:
    """Paths of a least-squares tree on residuals: every node but the root gives one."""
    if depth == 0 or len(r) < 20:
        return []
    best, where = 1e-9, None
    base = r.sum() ** 2 / len(r)
    for j in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25))):
            low = x[:, j] <= t
            k = int(low.sum())
            if 5 <= k <= len(r) - 5:
                s = r[low].sum()
                gain = s * s / k + (r.sum() - s) ** 2 / (len(r) - k) - base
                if gain > best:
                    best, where = gain, (j, float(t), low)
    if where is None:
        return []
    j, t, low = where
    out = []
    for above, part in ((False, low), (True, ~low)):
        own = [*terms, (names[j], above, t)]
        out.append(own)
        out += _paths(x[part], r[part], names, own, depth - 1)
    return out


def _lasso(a: np.ndarray, y: np.ndarray, strength: float) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient; the intercept is free."""
    n, k = a.shape
    a1 = np.c_[a, np.ones(n)]
    step = 4 * n / max(1e-9, np.linalg.norm(a1, 2) ** 2)
    w, v, m = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(STEPS):
        g = a1.T @ (1 / (1 + np.exp(-np.clip(a1 @ v, -30, 30))) - y) / n
        new = v - step * g
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * strength, 0)
        nm = (1 + np.sqrt(1 + 4 * m * m)) / 2
        v, w, m = new + (m - 1) / nm * (new - w), new, nm
    return w[:k], float(w[k])


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    intercept: float

    def score(self) -> Column:
        """The ensemble as one column expression over the statistics."""
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def learn(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 11) -> RuleEnsemble:
    """Rules from boosted trees, weighted by the lasso."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        return RuleEnsemble([], float(np.log((rate + 0.01) / (1.01 - rate))))
    rng = np.random.default_rng(seed)
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: list[list] = []
    for _ in range(TREES):
        p1 = 1 / (1 + np.exp(-z))
        r, curve = y - p1, p1 * (1 - p1)
        rows = rng.permutation(len(y))[: max(20, int(SHARE * len(y)))]
        columns = np.sort(rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)])
        tree = _paths(x[rows][:, columns], r[rows], [names[j] for j in columns], [], DEPTH)
        if not tree:
            continue
        paths += tree
        inner = {tuple(p[:-1]) for p in tree}
        for p in tree:
            if tuple(p) not in inner:
                held = Rule(p).holds(x, names)
                if held.any():
                    z[held] += 0.5 * r[held].sum() / max(1.0, curve[held].sum())
        z = np.clip(z, -8, 8)
    rules = [Rule(list(p)) for p in dict.fromkeys(map(tuple, paths))]
    a = np.stack([r.holds(x, names) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    w, b = _lasso(a, y, LASSO)
    for r, v in zip(rules, w, strict=True):
        r.weight = float(v)
    return RuleEnsemble([r for r in rules if r.weight], b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    names = list(statistics())
    picked = labelled_sample(docs.select("doc_id", "text"), labels, "quality", fold("doc_id", 5) != 0, sample)
    rows = sorted(tuple(r) for r in measured(picked, ["doc_id", "label"]).collect())
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(names))
    return learn(x, np.array([float(r[1] > 0) for r in rows]), names)


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; labels are learned outside the held-out fold.

    Null and empty texts have the statistics of a text of length 0 and a score like any other. Without labels, or with one
    kind only, the score is one constant. Repeated rows are scored alike; further columns are ignored.
    """
    model = train(docs, labels, sample)
    scored = measured(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
