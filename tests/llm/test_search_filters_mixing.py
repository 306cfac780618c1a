from __future__ import annotations

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from medtab.llm import decontaminate, queries, source_mixing, token_rollup, topk_search, url_filter
from medtab.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple("None" if v is None or v != v else (round(float(v), 6) if isinstance(v, float) else str(v)) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_decontamination_edges(spark, docs, clashing, no_docs):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20, 35))), (2, "One, TWO!"), (3, None), (4, "..."), (10, "one two")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, items).collect()}
    assert got[1] == (60, 15, 1, True) and got[7] == (2, 2, 2, True) and got[8] == (2, 2, 2, True) and got[4] == (0, 0, 0, False) and got[5] == (0, 0, 0, False) and got[12] == (30, 0, 0, False)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(clashing, items).collect()} == got
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_rows_without_an_id_or_with_a_shared_one(spark):
    phrase = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(None, phrase), (None, "clean text"), (None, None), (1, phrase), (1, "clean text here"), (1, phrase + " w0"), (2, phrase), (2, phrase)], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([("a", phrase), ("b", "w0 w1 w2")], "item_id string, text string")).collect()
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got)
    assert rows == sorted([("None", 12, 12, 2, True), ("None", 2, 0, 0, False), ("None", 0, 0, 0, False), ("1", 12, 12, 2, True), ("1", 3, 0, 0, False), ("1", 13, 12, 2, True), ("2", 12, 12, 2, True), ("2", 12, 12, 2, True)])


def test_texts_that_share_the_hash_of_the_index(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(7, 1, "x a b c"), (7, 2, "x a b d"), (7, 3, "a b c")], "doc_id long, row long, text string")
    found, _ = decontaminate.match_windows(docs, items, carry=("row",))
    assert sorted((r.doc_id, r.row, r.start) for r in found.collect()) == [(7, 1, 1), (7, 3, 0)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x x c"), (2, "a b c"), (3, "c x x x x x x x x x b")], "doc_id long, text string")
    near, _ = decontaminate.match_windows(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"), slop=2)
    assert sorted({r.doc_id for r in near.collect()}) == [1, 2]


def test_proximity_looks_at_the_whole_phrase(spark):
    phrase = [f"t{i}" for i in range(10)]
    filler = [f"x{i}" for i in range(30)]
    moved = phrase[:4] + ["y"] + phrase[5:3:-1] + phrase[6:]
    texts = [phrase, filler + moved + filler, filler[:5] + phrase[:2] + filler, phrase[:9] + filler, phrase[:5] + filler + phrase[5:], moved[::-1], [], phrase[:5] + ["t0", "t0"] + phrase[5:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(phrase))], "item_id long, text string")
    near, _ = decontaminate.match_windows(docs, items, slop=2)
    assert sorted({r.doc_id for r in near.collect()}) == [0, 1, 7]
    wide, _ = decontaminate.match_windows(docs, items, slop=10)
    assert sorted({r.doc_id for r in wide.collect()}) == [0, 1, 5, 7]
    exact, _ = decontaminate.match_windows(docs, items)
    assert {(r.doc_id, r.start) for r in exact.collect()} == {(0, 0)}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(0, 0.1, 40) * rng.choice([0.1, 1, 3])]) for i in range(300)]
    vecs += [(1000, None), (1001, []), (1002, [None] * 40), (1003, [float("nan")] * 40), (1004, [float("inf")] * 40), (1005, [1.0, 2.0]), (1100, [3.0, 1.0]), (7, vecs[7][1]), (20, vecs[20][1]), (1006, vecs[9][1]), (1007, [0.0] * 40), (1200, [1e30] * 3)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vecs], "vec_id long, embedding array<float>, v string, rank int")
    for block in (50, 8192):
        topk_search.BLOCK_ROWS = block
        got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 10 == 0, 10).collect()))
        # rows that repeat id and vector: one query, and as many candidates as there are
        good = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in vecs if v and all(x is not None and math.isfinite(x) for x in v)]
        want = []
        for q, qv in dict.fromkeys(good):
            if q % 10 == 0:
                s = sorted((-sum(a * b for a, b in zip(qv, c, strict=True)), i) for i, c in good if i != q and len(c) == len(qv))[:10]
                want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
        assert got == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_rollup_is_idempotent_and_signed(spark):
    state = token_rollup.Rollup(spark, scratch_path(spark, "t"))
    kind = "struct<source:string,lang:string,version:string,tokens:bigint>"
    change = lambda *r: spark.createDataFrame(list(r), f"before {kind}, after {kind}")
    assert state.totals().count() == 0
    one = change((None, ("s", "en", "v1", 5)), (None, (None, None, "v1", 2)), (None, ("s", "en", "v1", None)), (None, None))
    assert state.commit(1, one) and not state.commit(1, one)
    assert state.commit(2, change((("s", "en", "v1", 5), ("s", "en", "v2", 9)), (("s", "en", "v1", None), None)))
    assert state.commit(3, one.limit(0))
    assert sorted(map(tuple, state.totals().collect()), key=str) == sorted([(None, None, "v1", 1, 2), ("s", "en", "v2", 1, 9)], key=str)
    assert state.batches() == [1, 2, 3]


def test_rollup_carries_batches_into_a_base(spark):
    path = scratch_path(spark, "t")
    state = token_rollup.Rollup(spark, path, compact=3)
    kind = "struct<source:string,lang:string,version:string,tokens:bigint>"
    insert = lambda k: spark.createDataFrame([(None, ("s", "en", "v", k))], f"before {kind}, after {kind}")
    for k in (5, 1, 9, 2, 7, 4, 3):
        assert state.commit(k, insert(k))
    assert [tuple(r) for r in state.totals().collect()] == [("s", "en", "v", 7, 31)] and state.batches() == [1, 2, 3, 4, 5, 7, 9]
    assert not any(state.commit(k, insert(k)) for k in (5, 9, 7, 3)) and len(state._numbers("base")) == 1 and len(state._numbers("batch")) < 3
    # a base whose job died has no marker; batches of a base that were not removed yet count once
    (spark.read.schema(token_rollup.TOTALS + ", batch long").parquet(f"{path}/base={state._numbers('base')[0]}").write.parquet(f"{path}/base=99"))
    at, fs = state._fs(f"{path}/base=99/_SUCCESS")
    fs.delete(at, False)
    token_rollup.signed(insert(5)).write.parquet(f"{path}/batch=5")
    assert [tuple(r) for r in state.totals().collect()] == [("s", "en", "v", 7, 31)] and not state.commit(5, insert(5))


def test_rollup_edges(spark, docs, clashing, no_docs):
    want = sorted(map(tuple, token_rollup.replay(docs).collect()), key=str)
    assert sorted(map(tuple, token_rollup.replay(clashing).collect()), key=str) == want and sum(r[3] for r in want) > 0
    assert token_rollup.replay(no_docs).count() == 0


def test_counts_by_a_tokenizer_file(spark, docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    got = {r.doc_id: (r.version, r.tokens) for r in token_rollup.counted_by(docs, path, "bpe").collect()}
    assert got == {r.doc_id: ("bpe", len(ref.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()}
    assert token_rollup.counted_by(no_docs, path, "bpe").count() == 0


def test_counts_of_null_and_empty(spark, docs):
    got = {(r.doc_id, r.version): r.tokens for r in token_rollup.counted(docs).collect()}
    assert got[4, "words-1"] == 0 and got[5, "words-1"] == 0 and got[1, "words-1"] == 60 and got[7, "runs-2"] == 2


def test_raked_weights_meet_the_margins(spark):
    cells = spark.createDataFrame([("a", "en", "x", 900), ("a", "fr", "x", 50), ("b", "en", "y", 30), ("b", "fr", "y", 20), ("a", "en", "y", 0), ("b", "fr", "x", 7)], "source string, lang string, topic string, tokens long")
    targets = {"source": spark.createDataFrame([("a", 1.0), ("b", 3.0)], "value string, share double"), "lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, share double"), "topic": spark.createDataFrame([("x", 1.0), ("y", 1.0)], "value string, share double")}
    w = source_mixing.rake(cells, targets, sweeps=60).toPandas()
    total = w.w.sum()
    assert abs(total - 1007) < 1e-6 and abs(w[w.source == "b"].w.sum() / total - 0.75) < 0.02 and abs(w[w.lang == "fr"].w.sum() / total - 0.5) < 0.02
    p = source_mixing.calibrate(source_mixing.rake(cells, targets, sweeps=60), budget=0.05).toPandas()
    assert abs((p.p * p.tokens).sum() - 0.05 * 1007) < 0.5 and p.p.between(0, 1).all() and p[p.tokens == 0].p.eq(1).all()


def test_sweeps_go_on_until_the_margins_are_met(spark):
    tokens = iter([5000, 3, 40, 700, 90, 2, 1, 1200, 10, 8, 300, 6])
    cells = spark.createDataFrame([(s, g, t, next(tokens)) for s in ("a", "b", None) for g in ("en", "fr") for t in ("x", "y")], "source string, lang string, topic string, tokens long")
    out = source_mixing.rake(cells, sweeps=4)
    errors = source_mixing.margin_errors(out).toPandas()
    assert len(errors) == 7 and errors.error.abs().max() <= source_mixing.TOLERANCE and abs(errors[errors.margin == "lang"].share.sum() - 1) < 1e-9
    gone = source_mixing.rake(cells.where("source is not null"), {"source": spark.createDataFrame([("nobody", 1.0)], "value string, share double")}, sweeps=4)
    assert gone.agg(F.sum("w")).first()[0] == 0
    assert source_mixing.margin_errors(source_mixing.rake(cells.limit(0))).count() == 0


def test_null_groups_are_apart_from_names_like_theirs(spark):
    rows = spark.createDataFrame([(1, "a b", None, None), (2, "a b", "(none)", "(none)")], "doc_id long, text string, lang string, source string")
    assert source_mixing.placed(rows, ["doc_id"]).select("m_source", "m_lang").distinct().count() == 2


def test_mix_edges(spark, docs, clashing, no_docs):
    keep = ["doc_id", "text"]
    got = sorted(r.doc_id for r in source_mixing.mix(docs, keep).collect())
    assert got == sorted(r.doc_id for r in source_mixing.mix(clashing, keep).collect()) and set(got) <= set(range(1, 13))
    twice = source_mixing.mix(docs.unionByName(docs), keep).groupBy("doc_id").count().collect()
    assert all(r["count"] == 2 for r in twice)
    assert source_mixing.mix(no_docs, keep).count() == 0


def test_url_intervals(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("Bad.com", "block", day(5)), ("bad.com", "clear", day(10)), ("ok.bad.com", "allow", day(1)), ("bad.com", "block", day(20)), ("bad.com", "allow", day(20)), (None, "block", day(1)), ("x", "what", day(1)), ("bad.com", "block", day(5))], "key string, action string, since date")
    caps = spark.createDataFrame([(1, "http://www.BAD.com:80/x", day(5)), (2, "http://bad.com/", day(10)), (3, "https://u:p@a.ok.bad.com./", day(6)), (4, "bad.com", day(6)), (5, None, day(6)), (6, "http://bad.com", None), (7, "http://bad.com", day(25)), (7, "http://bad.com", day(25)), (8, "http://bad.com", day(4))], "page_id long, url string, fetched date")
    got = {r.page_id: (r.decision, r.rule, r.n_active, r.n_rows) for r in url_filter.evaluate(caps, entries).collect()}
    assert got == {1: ("block", "bad.com", 1, 1), 2: ("allow", None, 0, 1), 3: ("allow", "ok.bad.com", 2, 1), 4: ("allow", None, 0, 1), 5: ("allow", None, 0, 1), 6: ("allow", None, 0, 1), 7: ("block", "bad.com", 1, 2), 8: ("allow", None, 0, 1)}
    odd = url_filter.evaluate(caps.withColumns({c: F.lit("z") for c in ("key", "action", "since", "decision", "rule")}), entries).collect()
    assert {r.page_id: (r.decision, r.rule, r.n_active, r.n_rows) for r in odd} == got
    assert url_filter.evaluate(caps.limit(0), entries).count() == 0 and url_filter.evaluate(caps, entries.limit(0)).where("decision = 'block'").count() == 0
