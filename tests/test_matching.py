"""Indexes of many patterns against plain loops over all of them."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from medtab.operators import facts, matching, ranges, sides


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_substrings_of_fifty_thousand_patterns(spark):
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    patterns = sorted({some(rng.randrange(1, 9)) for _ in range(70_000)})
    while len(patterns) < 50_000:
        patterns = sorted({*patterns, *(some(rng.randrange(6, 12)) for _ in range(20_000))})
    texts = [(i, some(rng.randrange(60))) for i in range(150)] + [(150, None), (151, ""), (152, "ab"), (153, "ab"), (154, "abcde " * 20_000), (155, "é\nab漢")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "id int, t string, n int")
    dim = spark.createDataFrame([(p, k) for k, p in enumerate(patterns)] + [("ab", -1), ("", -2), (None, -3), ("\nab", -4), ("漢", -5)], "p string, k int")
    found = matching.substring_matches(df, ["id"], "t", dim, "p", ["n"])
    got = sorted((r.id, r.k) for r in found.collect())
    every = [(p, k) for k, p in enumerate(patterns)] + [("ab", -1), ("\nab", -4), ("漢", -5)]
    assert got == sorted((i, k) for i, t in texts if t for p, k in every if p in t)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert matching.substring_matches(df, ["id"], "t", dim.limit(0), "p").collect() == [] and matching.substring_matches(df.limit(0), ["id"], "t", dim, "p").collect() == []


def test_substrings_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sides, "SMALL_BYTES", 0)
    df, dim = spark.createDataFrame([(1, "before ef"), (2, "of")], "id int, t string"), spark.createDataFrame([("ef",), ("o",), ("fore e",)], "p string")
    assert sorted(map(tuple, matching.substring_matches(df, ["id"], "t", dim, "p").collect())) == [(1, "ef"), (1, "fore e"), (1, "o"), (2, "o")]


def lexicon(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    out = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return word, out


def test_a_lexicon_of_a_hundred_thousand_phrases(spark):
    rng = random.Random(2)
    word, phrases = lexicon(rng, 100_000)
    phrases[5:12] = ["e/a", "e/e'", "(left)", "é bb", "left-sided", "60%", "B12"]
    clauses = [" ".join(rng.choice(["No", "mild", "e/a", "E/E' x", "a(left)b", "É BB", "left-sided", "left sided", "60% x", "b12", word(), word(), word()]) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    df = spark.createDataFrame([("d", 1, 1, "t", i, c) for i, c in enumerate(clauses)], "doc_id string, page int, section_no int, title string, clause_no int, clause string")
    routed = spark.createDataFrame([("d", "generic")], "doc_id string, rule_set string")
    dim = spark.createDataFrame([("generic", i, p) for i, p in enumerate(phrases)] + [("other", 0, "no")], "rule_set string, position int, pattern string")
    position: dict[str, int] = {}
    for i, p in enumerate(phrases):
        position.setdefault(p.lower(), i)
    want, seen = {}, set()
    tried = [(i, re.compile(rf"(?i)\b{re.escape(p)}\b")) for i, p in enumerate(phrases) if not re.fullmatch(r"[a-z]+( [a-z]+)*", p)]
    for no, c in enumerate(clauses):
        if c.lower() in seen:
            continue
        seen.add(c.lower())
        ws = re.findall(r"\w+(?:\W+\w+)*", c.lower())
        tokens = [m.span() for m in re.finditer(r"\w+", c)]
        hits = [position[c.lower()[tokens[a][0] : tokens[b][1]]] for a in range(len(tokens)) for b in range(a, min(a + 3, len(tokens))) if c.lower()[tokens[a][0] : tokens[b][1]] in position]
        hits += [i for i, rx in tried if rx.search(c)]
        if hits and ws:
            want[no] = phrases[min(hits)]
    for gated in (True, False):
        found = facts.findings(df, routed, dim, gated)
        got = {r.clause_no: r.pattern for r in found.collect()}
        short = {no: p for no, p in want.items() if len(clauses[no].strip()) >= 3 and len(clauses[no].split()) <= 10 and not clauses[no][0].isdigit()} if gated else want
        assert got == short
        assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_anatomy_of_long_texts(spark):
    rng = random.Random(3)
    word, phrases = lexicon(rng, 3000)
    text = " ".join(word() for _ in range(30_000))
    df = spark.createDataFrame([("d", 1, 1, "Left ventricle", text), ("d", 1, 2, None, None), ("d", 2, 1, "x", "the left\nventricle (LEFT VENTRICLE).")], "doc_id string, page int, section_no int, title string, text string")
    routed = spark.createDataFrame([("d", "generic")], "doc_id string, rule_set string")
    dim = spark.createDataFrame([("generic", i, p) for i, p in enumerate([*phrases, "left ventricle"])], "rule_set string, position int, pattern string")
    got = {(r.page, r.term.lower()) for r in facts.anatomy(df, routed, dim).collect()}
    full = f" Left ventricle {text} ".lower()
    assert got == {(1, p) for p in {*phrases, "left ventricle"} if f" {p} " in full} | {(2, "left ventricle")}


def test_longest_alias_and_an_alias_without_a_code(spark):
    aliases = spark.createDataFrame([("glucose", "G"), ("fasting glucose", "FG"), ("fasting glucose ratio", None), ("t3", "T"), ("free t3", "FT")], "alias string, code string")
    names = spark.createDataFrame([("Fasting-Glucose (serum)",), ("Fasting glucose ratio",), ("GLUCOSE",), ("glucoses",), (None,), (" free  T3 ",)], "name string")
    found = ranges.resolve_codes(names, aliases)
    assert {r.name: r.code for r in found.collect()} == {"Fasting-Glucose (serum)": "FG", "Fasting glucose ratio": None, "GLUCOSE": "G", "glucoses": None, None: None, " free  T3 ": "FT"}
    assert "NestedLoop" not in plan(found)


def test_no_array_of_a_lexicon(spark):
    df = spark.createDataFrame([("d", "Serum glucose level")], "doc_id string, source string")
    links = spark.createDataFrame([(0, "glucose level", "A"), (1, "glucose", "B"), (2, "serum glucose level", "C")], "position int, key string, target string")
    found = facts.relationships(df, links, "MEASURES")
    assert [tuple(r) for r in found.collect()] == [("d", "Serum glucose level", "MEASURES", "C")] and "collect_list" not in plan(found)
    assert [r.target for r in facts.relationships(df.select("doc_id", F.lit("High glucose level").alias("source")), links, "MEASURES").collect()] == ["A"]


def test_few_patterns_post_no_trigrams(spark, monkeypatch):
    df = spark.createDataFrame([(1, "red bolt, hot"), (2, "bolt%_"), (3, ""), (4, None), (5, "xré")], "id int, t string")
    dim = spark.createDataFrame([("bolt", 1), ("bolt", 2), ("red bolt", 3), ("ol", 4), ("%_", 5), ("é", 6), ("", 7), (None, 8)], "p string, k int")
    rows = lambda: matching.substring_matches(df, ["id"], "t", dim, "p")
    few = rows()
    assert "regexp_extract_all" not in plan(few)
    got = sorted((r.id, r.k) for r in few.collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 4), (2, 5), (5, 6)]
    monkeypatch.setattr(matching, "FEW", 0)
    assert sorted((r.id, r.k) for r in rows().collect()) == got
    monkeypatch.setattr(sides, "SMALL_BYTES", 0)
    assert sorted((r.id, r.k) for r in rows().collect()) == got
