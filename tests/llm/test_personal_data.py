"""Personal data: patterns, tagger and reconciliation against plain code."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from medtab.llm import personal_data as pd

SF = "/root/testdata/sf0.001"
FIXED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checksum(text):
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", text))):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_base(text):
    """The contract's expressions as they stand."""
    out = []
    for k, (kind, rx) in enumerate(FIXED.items()):
        for m in re.finditer(rx, text):
            digits = len(re.sub("[^0-9]", "", m[0]))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= digits <= 19 and checksum(m[0]) or kind == "phone" and 9 <= digits <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_expressions():
    rng = random.Random(1)
    parts = ["a", "é", "@", ".", "-", " ", "+", "1", "9", "12", "255", "(", ")", "x.y", "com", "4539578763621486", "+1 (017) 555-7713", "10.0.0.1", "m@x.org", "%", "\n", "00", "0255", "３"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert pd.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "a." * 100_000 + "@b"])
def test_long_runs_take_linear_time(text):
    assert all(e <= len(text) for _, _, e in pd.base_spans(text))


def tagged(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, pd.CLASSES, (4, 6))
    x[2, 4:] = pd.PAD
    y = np.zeros((4, 6), int)
    y[0, 1:3], y[1, 0:2], y[3, 5] = [1, 2], [3, 4], 7
    return pd.Tagger.fresh(seed, 3), x, y


def test_gradient():
    model, x, y = tagged()
    _, grads = model.loss(x, y)
    rng = np.random.default_rng(1)
    for name, g in grads.items():
        for _ in range(8):
            at = tuple(rng.integers(n) for n in g.shape)
            if name == "t" and not pd.ALLOWED[at]:
                continue
            was, both = model.p[name][at], []
            for d in (1e-5, -1e-5):
                model.p[name][at] = was + d
                both.append(model.loss(x, y)[0])
            model.p[name][at] = was
            assert abs((both[0] - both[1]) / 2e-5 - g[at]) < 1e-6


def test_decoding_and_marginals_equal_all_paths():
    model = tagged(3)[0]
    rng = np.random.default_rng(2)
    model.p["t"] = rng.normal(size=model.p["t"].shape)
    e, t = rng.normal(size=(4, 1, pd.TAGS)) * 2, model.transitions()
    paths = [p for p in itertools.product(range(pd.TAGS), repeat=4) if pd.OPENING[p[0]] and all(pd.ALLOWED[i, j] for i, j in zip(p, p[1:]))]
    score = np.array([sum(e[k, 0, j] for k, j in enumerate(p)) + sum(t[i, j] for i, j in zip(p, p[1:])) for p in paths])
    assert tuple(model.decode(e)[0]) == paths[score.argmax()]
    weight = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
    for k in range(4):
        for j in range(pd.TAGS):
            assert abs(model.marginals(e)[k, 0, j] - sum(w for p, w in zip(paths, weight) if p[k] == j)) < 1e-9


def test_reconciling_equals_all_subsets():
    rng = random.Random(4)
    for _ in range(300):
        spans = list({(a := rng.randrange(20), a + rng.randrange(1, 8), rng.randrange(4)): None for _ in range(rng.randrange(9))})
        spans = [(*s, rng.randrange(1, 9) + rng.random()) for s in spans]
        best = max((sum(s[3] for s in c) for n in range(len(spans) + 1) for c in itertools.combinations(spans, n) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(c, 2))), default=0)
        got = pd.reconcile(spans)
        assert abs(sum(s[3] for s in got) - best) < 1e-9 and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_windows_cover_every_anchor():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "7", "@", "é" * 50, "[at]", " dot "]) for _ in range(rng.randrange(60)))
        got = pd.stretches(text)
        assert all(0 <= a < b <= len(text) and b - a <= pd.WINDOW for a, b in got)
        for m in re.finditer(pd.ANCHOR, text):
            assert any(a <= m.start() and m.end() <= b for a, b in got)


def test_parts_cut_by_an_edge_are_joined():
    assert pd._whole([(10, 32, 0, 0.9, False, True), (16, 50, 0, 0.8, True, False), (60, 70, 1, 1.0, False, False)]) == [(60, 70, 1, 10.0), (10, 50, 0, 32.0)]


def sentence(rng):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(8))


def made(rng, kind):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    if kind == 0:
        return f"{sentence(rng).split()[0]}.{n(2)}@mail{n(1)}.example.com"
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 3:
        return f"+{rng.randrange(1, 9)} ({n(3)}) {n(3)}-{n(4)}"
    head = n(15)
    return next(head + c for c in "0123456789" if checksum(head + c))


def labelled(rng, size):
    out = []
    for _ in range(size):
        left, right, kind = sentence(rng)[-40:] + " ", " " + sentence(rng)[:40], rng.randrange(4)
        span = made(rng, kind)
        out.append((left + span + right, [(len(left), kind, len(left) + len(span))]))
    return out


@pytest.fixture(scope="module")
def model():
    rng = random.Random(7)
    return pd.train(pd.windows_of(labelled(rng, 400))).single()


def test_tagger_on_held_out_texts(model):
    rng = random.Random(8)
    cases = labelled(rng, 200)
    got = pd._decoded(model, [t for t, _ in cases], [(i, a, b) for i, (t, _) in enumerate(cases) for a, b in pd.stretches(t)])
    hit = made_ = 0
    for i, (_, spans) in enumerate(cases):
        found = {(a, k, b) for a, b, k, _ in pd.reconcile(pd._whole(got.get(i, [])))}
        hit, made_ = hit + len(found & set(spans)), made_ + len(found)
    assert hit / 200 >= 0.95 and hit / made_ >= 0.95


def test_adds_what_patterns_drop_and_leaves_clean_texts_alone(model):
    rng = random.Random(9)
    texts, want = [], []
    for _ in range(60):
        left, phone, ip = sentence(rng) + " ", made(rng, 3), made(rng, 1)
        texts.append(f"{left}{phone} {ip} {sentence(rng)}")
        want.append((len(left), 3, len(left) + len(phone)))
    got = pd.tag(texts, model)
    assert not any(s == w[0] and k == 3 for t, w in zip(texts, want) for s, k, _ in pd.base_spans(t))
    assert sum((s, k, e) == w and new for f, w in zip(got, want) for s, k, e, new, _ in f) >= 50
    assert all([x[:3] for x in f if not x[3]] == pd.base_spans(t) for f, t in zip(got, texts))
    clean = [f"{sentence(rng)} {rng.randrange(10**6)} {sentence(rng)} version {rng.randrange(9)}.{rng.randrange(9)}" for _ in range(200)]
    assert not any(pd.tag(clean, model))


def plain(text):
    spans = pd.base_spans(text or "")
    listed = ",".join(f"{pd.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    return (*(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest())


def check(rows, got):
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == plain(texts[r.doc_id])
        listed = [x.split(":") for x in r.spans.split(",") if x]
        assert {(int(s), pd.KINDS.index(k), int(e)) for k, s, e in listed} >= set(plain_base(texts[r.doc_id] or ""))
        assert [(int(s), pd.KINDS.index(k)) for k, s, _ in listed] == sorted((int(s), pd.KINDS.index(k)) for k, s, _ in listed)


def test_query_equals_plain_code(spark):
    from medtab.llm.queries import op12_personal_data

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op12_personal_data(spark, SF).collect())


def test_edges(spark, clashing, no_docs, model):
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    check(rows, pd.digest(clashing, model).collect())
    assert pd.digest(no_docs).collect() == []
    long = "word " * 200_000 + "jo@mail7.example.com" + " word" * 100_000 + " 10.1.2.3"
    df = spark.createDataFrame([(1, long), (None, "x@y.zz"), (None, "x@y.zz"), (3, None), (4, "𝟙😀 +1 (017) 555-7713 ü")], "doc_id long, text string")
    got = {(r.doc_id, r.spans) for r in pd.digest(df, model).collect()}
    assert got == {(1, f"email:1000000:1000020,ip:{len(long) - 8}:{len(long)}"), (None, "email:0:6"), (3, ""), (4, "phone:3:20")}
    found = pd.find(df, ["doc_id"], model).where("doc_id = 4").first().spans[0]
    assert (found.kind, found.start, found.end, found.added) == ("phone", 3, 20, False)
