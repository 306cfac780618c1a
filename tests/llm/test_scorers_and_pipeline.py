from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from medtab.llm import queries
from medtab.llm.language_id import identify, language_id, train
from medtab.llm.quality_rules import Rule, RuleEnsemble, learn, measured, quality, statistics
from medtab.llm.toxicity import Lexicon, folded, toxicity
from medtab.llm.toxicity import learn as learn_lexicon

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality_rules", "quality", 0.93), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    r = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r.predicted == r[label]).mean() >= least and r.score.between(0, 1).all()


def test_language_accuracy(spark):
    r = queries.QUERIES["op8_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(r) == 1000 and (r.lang_pred == r.lang)[r.held_out].mean() >= 0.97 and not r.rejected.mean() > 0.02


def test_scorers_on_edges(spark, docs, clashing, no_docs):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(1, 13)] + [(1, 0, 1), (None, 1, 1), (3, None, None)], LABELS)
    none = labels.limit(0)
    for f in (quality, toxicity):
        for d in (docs, clashing):
            got = f(d, labels).collect()
            assert sorted(r.doc_id for r in got) == list(range(1, 13)) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert f(docs, none).count() == 12 and f(no_docs, labels).count() == 0 and f(docs.unionByName(docs), labels).count() == 24
    for d in (docs, clashing):
        got = {r.doc_id: r for r in language_id(d).collect()}
        assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (4, 5, 6)) and got[10].lang_pred in ("en", "fr", "de")
    assert language_id(no_docs).count() == 0
    assert identify(docs.withColumn("lang", F.lit(None).cast("string")), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_rules_as_columns_equal_rules_as_arrays(spark, docs):
    names = list(statistics())
    rows = measured(docs, ["doc_id"]).toPandas()
    x = rows[[f"s_{n}" for n in names]].to_numpy(float)
    model = RuleEnsemble([Rule([("words", True, 1.0), ("upper", False, 0.2)], 1.5), Rule([("lines", False, 0.8)], -2.0)], 0.25)
    got = [r.s for r in measured(docs, ["doc_id"]).select("doc_id", model.score().alias("s")).orderBy("doc_id").collect()]
    want = 1 / (1 + np.exp(-(0.25 + sum(r.weight * r.holds(x, names) for r in model.rules))))
    assert np.allclose(got, want[np.argsort(rows.doc_id)])
    y = (x[:, 1] > 2).astype(float)
    assert learn(np.tile(x, (20, 1)), np.tile(y, 20), names).rules


def test_folding_exceptions_and_length():
    assert folded("1D10T! ѕсum $tupid 4 $$$ x3") == " idiot scum stupid 4 x3 "
    assert folded(None) == "  " and folded("") == "  "
    lex = Lexicon({" bad ": 2.0, " ba": 1.5}, [" not bad "], (-3.0, 1.0, 0.0, 1.0))
    a = lex.automaton()
    assert lex.measures(folded("so bad"), a)[2] == 2.0 and lex.measures(folded("not bad"), a)[2] == 0.0 and lex.measures(folded("fine"), a) == (0.0, 0.0, 0.0)
    assert lex.measures(folded("bad " + "x " * 500), a)[1] < lex.measures(folded("bad x"), a)[1]


def test_substitutes_anywhere_in_a_word():
    assert folded("L053R 5h17, a$$ a55; 1d107 m0r0n p@t@ _4ss_ $h17$") == " loser shit ass ass idiot moron pata ass shits "
    assert folded("x3 2024 $100 3.14 @ 50% 7") == " x3 2024 100 3 14 50 7 "
    assert folded("0a" * 40000) == f" {'oa' * 40000} " and folded("a" * 80000) == f" {'a' * 80000} "
    lex = Lexicon({" loser ": 2.0, " shit ": 2.0, " ass ": 2.0})
    assert all(lex.measures(folded(f"what {w} they are"), lex.automaton())[2] == 2.0 for w in ("l053r", "5h17", "a$$"))


def test_learned_lexicon_finds_words():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        words = [f"n{v}" for v in rng.integers(0, 200, 30)]
        toxic = i % 5 == 0
        if toxic:
            words[int(rng.integers(0, 30))] = str(rng.choice(["m0ron", "moron", "MORON"]))
        rows.append((" ".join(words), int(toxic)))
    lex = learn_lexicon(rows)
    a = lex.automaton()
    assert " moron " in lex.weights and lex.score(lex.measures(folded("a moron"), a)) > 0.7 > lex.score(lex.measures(folded("a n5"), a))


def test_automaton_equals_plain_search(spark):
    """Scores over whole texts against a search of every entry at every place, exceptions taken out one by one."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("text", "toxic").orderBy("doc_id").collect()
    lex = learn_lexicon([(r.text or "", r.toxic) for r in rows if r.toxic is not None])
    assert lex.weights
    some = sorted(lex.weights)[:3]
    lex.exceptions = lex.exceptions + [f" fine{w}" for w in some if w.endswith(" ")] + [f"{w.rstrip()}x " for w in some]
    a = lex.automaton()
    texts = [r.text for r in rows[:150]] + [None, "", " ".join(some * 3), " ".join(f"fine{w}" for w in some), "0" * 50_000, " ".join(some) * 2000]
    for raw in texts:
        t = folded(raw)
        spans = [(i, i + len(p) - 1) for p in lex.exceptions for i in range(len(t)) if t.startswith(p, i)] if len(t) < 20_000 else None
        if spans is None:
            continue
        best = {}
        for term, w in lex.weights.items():
            for i in range(len(t)):
                if t.startswith(term, i) and not any(x <= i and i + len(term) - 1 <= y for x, y in spans):
                    best[i] = max(best.get(i, 0.0), w)
        total = sum(best.values())
        want = (np.log1p(total), np.log1p(100 * total / max(1, t.count(" ") - 1)), max(best.values(), default=0.0))
        assert np.allclose(lex.measures(t, a), want)


def test_batch_scores_equal_features_text_by_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and text is not null").select("text", "lang").orderBy("doc_id").collect()
    m = train([(r.text, r.lang) for r in rows[:80]])
    texts = [r.text for r in rows[:60]] + [None, "", "x", "ab", "é", "漢字 " * 500, rows[0].text * 50]
    from medtab.llm.language_id import features, softmax

    want = []
    for t in texts:
        slot, share = features(t or "")
        want.append(softmax(((share @ m.table[slot.astype(int)] + m.bias) / m.temperature)[None])[0])
    assert np.allclose(m.scores(texts), np.array(want), atol=1e-3)
    import pickle

    again = pickle.loads(pickle.dumps(m))
    assert again.table is None and np.array_equal(again.scores(texts), m.scores(texts))


def _places(spark, long):
    """200 short texts and one long one, whose id is such that its hash comes first, in the middle or last."""
    from pyspark.sql import functions as F

    ids = spark.range(1000, 3000).select("id", F.xxhash64(F.col("id").alias("doc_id"), F.lit(long).alias("text"), F.lit(29)).alias("h")).orderBy("h").collect()
    return [ids[0].id, ids[len(ids) // 2].id, ids[-1].id]


def test_a_long_text_pushes_no_other_out_of_the_sample(spark):
    from medtab.llm.sampling import PART, ROW, within_bytes

    short = [(i, f"{i:024d}") for i in range(200)]
    for most, want in (((ROW + 24) * 300, 200), ((ROW + 24) * 38, 38)):
        long = "x" * (most // PART + 1)
        for at in _places(spark, long):
            got = within_bytes(spark.createDataFrame([*short, (at, long), (at, long)], "doc_id long, text string"), most).collect()
            assert len(got) == want and all(r.text != long for r in got)
    rows = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a")], "doc_id long, text string")
    assert within_bytes(rows).count() == 4 and within_bytes(rows, 0).count() == 0


def test_languages_are_named_with_a_text_above_the_bound(spark):
    from medtab.llm.language_id import identify

    rows = [(i, "the cat sat on the mat with a hat" if i % 2 else "le chat est sur la table avec une rose", "en" if i % 2 else "fr") for i in range(300)]
    bound = 200_000
    long = "word " * bound
    for at in _places(spark, long):
        df = spark.createDataFrame([*rows, (at, long, "en")], "doc_id long, text string, lang string")
        got = {r.doc_id: (r.lang_pred, r.rejected) for r in identify(df, ["doc_id"], sample_bytes=bound).collect()}
        assert sum(got[i][0] == lang for i, _, lang in rows) >= 297 and sum(r for _, r in got.values()) <= 5


def test_nothing_learned_rejects_everything(spark):
    from medtab.llm.language_id import identify

    got = identify(spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string"), ["doc_id"]).collect()
    assert all(r.lang_pred == "und" and r.rejected for r in got) and len(got) == 2


def test_language_model_needs_no_rows():
    m = train([])
    assert m.classes == ["und"] and m.scores(["abc", None, ""]).shape == (3, 1)


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = lambda p, n=60: " ".join(f"{p}{i}" for i in range(n))
    a, b, c, d = text("a"), text("b"), text("c"), text("d")
    rows = [(1, a), (1, a), (1, a), (2, a.replace("a59", "zz")), (None, a), (None, b), (None, b), (None, c), (3, d), (3, text("e")), (1, text("f")), (4, None), (4, None), (None, ""), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], kind)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    want = [(1, a), (None, b), (None, c), (3, d), (3, text("e")), (1, text("f")), (4, None), (4, None), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)

    spark.createDataFrame([(1, text("b", 20)), (2, text("d", 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([r for r in rows if r[1] not in (b, d)], key=str)


def test_pipeline_stages_against_plain_code(spark):
    """Which rows each stage keeps, row by row, by code that shares nothing with the operators but the language model."""
    import re
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    low = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    judged = {r.doc_id: r.rejected for r in language_id(docs).collect()}
    one = corpus_pipeline.language_stage(spark, docs, sf)
    assert ids(one) == sorted(d for d, gone in judged.items() if not gone)

    two, kept = corpus_pipeline.near_duplicate_stage(spark, one, sf), []
    texts = sorted((r.doc_id, r.text) for r in one.collect())
    grams = {d: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", low(t))) for d, t in texts}
    root = {d: d for d, _ in texts}
    for i, (a, _) in enumerate(texts):
        for b, _ in texts[:i]:
            if grams[a] and grams[b] and 100 * len(grams[a] & grams[b]) >= 75 * len(grams[a] | grams[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    kept = sorted(d for d in root if not grams[d] or root[d] == d)
    assert ids(two) == kept

    three = corpus_pipeline.decontamination_stage(spark, two, sf)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    assert ids(three) == sorted(r.doc_id for r in two.collect() if not hit(words(r.text)))

    four = corpus_pipeline.mixing_stage(spark, three, sf)
    assert set(ids(four)) <= set(ids(three)) and four.count() > 0

    five = {r.doc_id: r for r in corpus_pipeline.token_stage(spark, four, sf).collect()}
    ref, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in sorted(four.collect(), key=lambda r: r.doc_id):
        x = np.array([*ref.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (five[r.doc_id].start, five[r.doc_id].n_tokens, five[r.doc_id].ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)


def test_pipeline_on_empty_tables_and_clashing_columns(spark, docs, clashing, no_docs):
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0
    for name, stage in corpus_pipeline.STAGES[1:4]:
        plain, odd = (sorted(r.doc_id for r in stage(spark, d, sf).collect()) for d in (docs, clashing))
        assert plain == odd and set(plain) <= set(range(1, 13)), name


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n, seen = docs.count(), [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], "/root/testdata/sf0.001"))
        if name != "token_store":
            assert seen[-1].columns == docs.columns and seen[-1].count() <= seen[-2].count()
    counts = [d.count() for d in seen]
    assert counts[0] == n and counts[1] >= 0.95 * n and counts[4] == counts[5] > 0
    from medtab.llm.jaccard_join import jaccard_components

    assert jaccard_components(seen[2]).where("n_shingles > 0 and doc_id <> component_id").count() == 0
    last = seen[-1].orderBy("start").collect()
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in last) and last[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(last, last[1:], strict=False))
