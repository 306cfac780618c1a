from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from medtab.llm import jaccard_join, token_store
from medtab.llm.components import components
from medtab.llm.jaccard_join import FlatTrie, jaccard_components

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, n=5, percent=75):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 120)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_equals_brute_force(spark, docs, clashing, no_docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for df in (docs, clashing):
        assert sorted(map(tuple, jaccard_components(df).collect())) == want
    assert jaccard_components(no_docs).count() == 0


def test_join_of_drifting_groups(spark):
    """Chains, rings of copies with more and more edits, shared passages, repeated rows: links through others only."""
    rng = np.random.default_rng(5)
    rows, d = [], 0
    for _ in range(3):
        words = [f"x{v}" for v in rng.integers(0, 10**6, 80)]
        for _ in range(25):
            edits = rng.integers(0, 7)
            own = list(words)
            for k in rng.integers(0, 80, edits):
                own[k] = f"y{rng.integers(0, 10**6)}"
            rows.append((d := d + 1, " ".join(own)))
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(20):
        rows.append((d := d + 1, passage + " " + " ".join(f"u{v}" for v in rng.integers(0, 10**6, int(rng.integers(0, 40))))))
    rows += [rows[0], (d + 1, None)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_grams_that_every_class_holds_travel_apart(spark, monkeypatch):
    """With one passage in every text, its grams are hot; the result is the same and their postings stand in no bucket."""
    rng = np.random.default_rng(11)
    passage = " ".join(f"common{i}" for i in range(30))
    rows = []
    for d in range(160):
        own = [f"z{v}" for v in rng.integers(0, 10**6, int(rng.integers(2, 30)))] if d % 4 else [f"k{d % 12}{i}" for i in range(9)]
        rows.append((d, f"{passage} {' '.join(own)}"))
    rows += rows[:3] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 8)
    monkeypatch.setattr(jaccard_join, "HOT_POSTINGS", 50)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    classes = jaccard_join.document_classes(docs)
    hot = jaccard_join._classes(5)  # the tasks count with the default bound, so count here
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    last = list(hot(iter([batch])))[-1]
    grams = np.sort(np.array([x["gram"] for x in last.column(3)[0].as_py() if x["count"] >= 50], np.uint64))
    assert len(grams) == 26
    packed = list(jaccard_join._postings(5, 6, grams)(iter([batch.select(["text"])])))
    buckets = [x for b in packed for x in b.column(0).to_pylist()]
    assert min(buckets) < 0 <= max(buckets)
    total = classes.where("n >= 0").agg({"n": "sum"}).first()[0]
    for chosen in (grams, None):
        links = {r.node: r.comp for r in jaccard_join.link_components(docs, total, hot=chosen).collect()}
        root: dict = {}
        for r in classes.where("n > 0").collect():
            root.setdefault(links.get(r.digest, r.digest), set()).add(r.doc_id)
        want: dict = {}
        for d, n, c in brute(rows):
            if n:
                want.setdefault(c, set()).add(d)
        assert sorted(map(sorted, root.values())) == sorted(map(sorted, want.values()))


@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=2, max_size=12), st.sets(st.integers(0, 30), min_size=1))
@settings(max_examples=60, deadline=None)
def test_trie_walk_finds_all_links(sets, probe):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    trie = FlatTrie(arrays, np.array([len(s) for s in sets]))
    mask = trie.mask(np.array(sorted(probe), np.uint64))
    got = sorted(int(trie.order[i]) for i in trie.walk(mask, len(probe), np.arange(len(sets)), 75))
    assert got == [i for i, s in enumerate(sets) if 100 * len(s & probe) >= 75 * len(s | probe)]


@given(st.lists(st.lists(st.integers(0, 50256), max_size=300), max_size=6))
@settings(max_examples=25, deadline=None)
def test_segment_round_trip(docs):
    docs = [np.array(d, np.uint32) for d in docs]
    back = token_store.unpack_segment(token_store.pack_segment(docs, 50257))
    assert len(back) == len(docs) and all((a == b).all() for a, b in zip(docs, back, strict=True))


def test_long_and_repetitive_blocks_and_damage():
    docs = [np.tile(np.arange(7, dtype=np.uint32), 3000), np.full(9000, 50256, np.uint32), np.arange(50257, dtype=np.uint32)]
    raw = token_store.pack_segment(docs, 50257)
    assert all((a == b).all() for a, b in zip(docs, token_store.unpack_segment(raw), strict=True)) and len(raw) < 2 * sum(map(len, docs))
    for bad in (raw[:-2], raw[:-40] + bytes([raw[-40] ^ 1]) + raw[-39:], b"XXXX" + raw[4:]):
        with pytest.raises(ValueError):
            token_store.unpack_segment(bad)


def test_ids_equal_the_librarys():
    ref, t = Tokenizer.from_file(PATH), token_store.Tokens(PATH)
    texts = ["", "a", " a", "a ", "a  b", "x\n y\n\nz", "don't  can't\t x", "a<|endoftext|> b <|endoftext|>c", "\x1c a", "漢字 é ñ  x", "word " * 50 + "end", "  x y z"]
    assert [x.tolist() for x in t.encode(texts)] == [ref.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files(spark, docs, clashing, no_docs):
    ref = Tokenizer.from_file(PATH)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    want, at = [], 0
    for d, text in rows:
        ids = np.array([*ref.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    for df in (docs, clashing, docs.repartition(7)):
        assert sorted(map(tuple, token_store.token_digest(df, PATH).collect())) == want
    odd = docs.unionByName(docs.limit(2)).selectExpr("nullif(doc_id, 3) as doc_id", "text")
    got = token_store.token_digest(odd, PATH).orderBy("start").collect()
    assert len(got) == 14 and [r.doc_id for r in got][0] is None and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))
    by_text = {r.text: n for r, (_, _, n, _) in zip(sorted(docs.collect(), key=lambda r: r.doc_id), want, strict=True)}
    assert sorted(r.n_tokens for r in got) == sorted(by_text[r.text] for r in odd.collect())
    assert token_store.token_digest(no_docs, PATH).count() == 0
