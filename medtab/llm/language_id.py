"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medtab.llm.common import fold, give_back
from medtab.llm.sampling import SAMPLE_BYTES, within_bytes

#: Slots of the hashed table, embedding width, and the character n-gram lengths.
SLOTS, WIDTH, GRAMS = 1 << 15, 16, (1, 2, 3)
#: Bound of the training sample (documents), the part of it held back for calibration, and passes over it.
SAMPLE, HELD_BACK, EPOCHS = 4000, 0.2, 4
#: Share of held-back documents of the learned languages that rejection may cost.
REJECT_SHARE = 0.002


def _slots(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash slots of all character n-grams of a code-point array."""
    h = np.full(len(codes) - n + 1, n, np.uint32)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
    return h & np.uint32(SLOTS - 1)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each behind and before a space, and where each text starts."""
    parts = [f" {t.casefold()} " if t else "  " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.r_[0, ends[:-1]]


def features(text: str) -> np.ndarray:
    """Slot counts of a whole text as (slot, share) rows."""
    codes, _ = _codes([text])
    slots = np.concatenate([_slots(codes, n) for n in GRAMS if len(codes) >= n])
    found, count = np.unique(slots, return_counts=True)
    return np.stack([found, count / len(slots)])


@dataclass
class LanguageModel:
    """``table[slot, class]`` is the embedding of a slot under the classifier; ``cut`` is the least accepted score."""

    classes: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    cut: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated class probabilities of whole texts."""
        codes, start = _codes(texts)
        lengths = np.diff(np.r_[start, len(codes)])
        total, seen = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        for n in GRAMS:
            slots = _slots(codes, n)
            # grams that reach over the end of a text count for none: their places hold slot -1, a row of zeros
            slots = np.append(slots, np.full(n - 1, SLOTS, np.uint32)).astype(np.int64)
            for i in range(1, n):
                slots[start[1:] - i] = SLOTS
            for c in range(len(self.classes)):
                total[:, c] += np.add.reduceat(self.columns[c][slots], start)
            seen += lengths - (n - 1)
        return softmax((total / np.maximum(seen, 1)[:, None] + self.bias) / self.temperature)

    def __post_init__(self) -> None:
        padded = np.vstack([self.table, np.zeros((1, len(self.classes)))]).astype(np.float32)
        self.columns = [np.ascontiguousarray(padded[:, c]) for c in range(len(self.classes))]

    def __getstate__(self) -> dict:
        """What tasks need: the single-precision columns, not the table they come from."""
        return self.__dict__ | {"table": None}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent over embeddings and classifier; temperature and rejection from held-back rows."""
    classes = sorted({lang for _, lang in rows})
    if not classes:  # nothing is known, so nothing is accepted: no score reaches the cut
        return LanguageModel(["und"], np.zeros((SLOTS, 1)), np.zeros(1), 1.0, 2.0)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = int(len(rows) * HELD_BACK)
    vectors = [features(t) for t, _ in rows]
    label = np.array([classes.index(lang) for _, lang in rows])
    emb = rng.normal(0, 0.1, (SLOTS, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, len(classes))), np.zeros(len(classes))
    learn = range(held, len(rows))
    steps, done = EPOCHS * max(1, len(learn)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(np.array(learn, int)):
            rate = 0.5 * (1 - done / steps)
            done += 1
            slot, share = vectors[i][0].astype(np.int64), vectors[i][1]
            mean = share @ emb[slot]
            p = softmax((mean @ out + bias)[None])[0]
            p[label[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            emb[slot] -= rate * 20 * share[:, None] * back
    table = emb @ out
    model = LanguageModel(classes, table, bias, 1.0, 0.0)
    check = range(held) if held else learn
    logits = np.array([vectors[i][1] @ table[vectors[i][0].astype(np.int64)] + bias for i in check])
    best = min((2.0**k for k in range(-6, 3)), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), label[list(check)]] + 1e-12).sum())
    model.temperature = best
    model.cut = float(min(0.5, np.quantile(softmax(logits / best).max(axis=1), REJECT_SHARE)))
    return model


def training_rows(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """About ``sample`` labelled documents outside the held-out fold, by a hash of the id, with ``sample_bytes``
    of text at most; a text that alone has more than a 64th of that teaches nothing."""
    rows = docs.where("lang is not null").where(fold("doc_id", 5) != 0)
    share = min(1.0, sample / max(1, rows.count()))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).where("length(text) > 0")
    return sorted((r.text, r.lang) for r in within_bytes(picked.select("doc_id", "text", "lang"), sample_bytes).collect())


def _score(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                texts = part.column(part.schema.get_field_index("__text")).to_pylist()
                p = model.scores(texts)
                best = p.argmax(axis=1)
                lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
                lang = [model.classes[c] if ok else "und" for c, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, p[np.arange(len(texts)), best], 0.0)
                cols = [part.column(i) for i, f in enumerate(part.schema) if f.name != "__text"]
                names = [f.name for f in part.schema if f.name != "__text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(~lettered | (score < model.cut))], [*names, "lang_pred", "score", "rejected"])
        give_back()

    return run


def identify(docs: DataFrame, keep: list[str], model: LanguageModel | None = None, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Columns ``keep`` with ``lang_pred``, ``score`` (of the winner, 0 to 1) and ``rejected``, one row per document.

    Null, empty and letterless texts are ``und`` with score 0 and rejected; without any training row all lettered texts
    are ``und`` and rejected too. Others get a learned language and are rejected where the score is under the calibrated cut. Ties go to
    the language first in order. Further columns are ignored; repeated rows are scored alike.
    """
    model = model or train(training_rows(docs, sample_bytes=sample_bytes))
    held = docs.select(*keep, F.col("text").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "__text")
    return held.mapInArrow(_score(model), f"{kinds}, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of every document."""
    out = identify(docs, ["doc_id"], sample_bytes=sample_bytes)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
