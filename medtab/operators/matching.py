"""Many patterns against many texts, as equality joins: an index of the patterns' rarest trigrams, and a dictionary of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medtab.operators.sides import small
from medtab.sources.scratch import kept

#: Length of an index key; patterns that are shorter are keys by themselves.
GRAM = 3
#: One of so many texts is looked at to tell rare trigrams from common ones.
SAMPLED = 64
#: Patterns up to which each is looked for in each text at once: cheaper than posting all trigrams of the texts.
FEW = 64


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters, in time that grows with the text's length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _lengths(patterns: DataFrame, size: Column) -> list[int]:
    """The different sizes of patterns: a few small numbers."""
    return sorted(r[0] for r in patterns.select(size.alias("n")).distinct().collect() if r[0])


def substring_matches(texts: DataFrame, keys: list[str], text: str, patterns: DataFrame, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """``(*keys, *carry, *patterns.columns)``: every pattern that stands in a text, as it is written in both.

    ``keys``, never null, name a row of ``texts``; ``carry`` are further columns of it. Up to FEW distinct patterns are looked for
    in each text where it stands. Of more, each distinct pattern is posted under
    one of its trigrams, the one that the fewest texts of a sample hold (ties: the first in order; the choice changes the cost,
    never the result); texts meet it by equality of trigrams, and what meets is verified. Patterns of one or two characters are posted whole. Null and empty
    texts and patterns match nothing; rows of equal patterns all come back.
    """
    held = patterns.where(F.length(pattern) > 0)
    distinct = held.select(F.col(pattern).alias("__p")).distinct()
    few = sorted(r[0] for r in distinct.limit(FEW + 1).collect())
    if not few:
        return texts.select(*keys, *(carry or [])).limit(0).crossJoin(held.limit(0))
    own = texts.where(F.length(text) > 0).select(*keys, *(carry or []), F.col(text).alias("__t"))
    if len(few) <= FEW:
        stands = F.array_except(F.array(*(F.when(F.col("__t").contains(p), F.lit(p)) for p in few)), F.array(F.lit(None).cast("string")))
        found = own.select(*keys, *(carry or []), F.explode(stands).alias("__p"))
        return found.join(small(held), found["__p"] == held[pattern]).drop("__p")
    lengths = _lengths(distinct, F.least(F.length("__p"), F.lit(GRAM)))
    # a text's grams without the text: long texts would else be copied once for every gram
    posted = own.select(*keys, F.explode(F.flatten(F.array(*(grams(F.col("__t"), n) for n in lengths)))).alias("__g"))
    entries = distinct.select("__p", F.explode(F.when(F.length("__p") >= GRAM, grams(F.col("__p"), GRAM)).otherwise(F.array("__p"))).alias("__g"))
    used = entries.select("__g").distinct()
    seen = posted.where(F.pmod(F.xxhash64(*keys), F.lit(SAMPLED)) == 0)
    frequency = seen.join(small(used, entries), "__g").groupBy("__g").agg(F.count("*").alias("__n"))
    rarest = entries.join(small(frequency, entries), "__g", "left").groupBy("__p").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__g").alias("g"))).alias("k"))
    index = rarest.select(F.col("k.g").alias("__g"), "__p")
    near = posted.join(small(index, distinct), "__g").groupBy(*keys).agg(F.collect_set("__p").alias("__ps"))
    found = own.join(near, keys).select(*keys, *(carry or []), F.explode(F.filter("__ps", lambda p: F.col("__t").contains(p))).alias("__p"))
    return found.join(small(held), found["__p"] == held[pattern]).drop("__p")


#: A word as regular expressions see it with Unicode on: what a word boundary stands at either end of. ASCII is told apart first.
_IN, _OUT = r"[a-zA-Z0-9_[\x80-\x{10FFFF}&&[\w]]]", r"[\x00-/:-@\[-\^`\{-\x7f[\x80-\x{10FFFF}&&[\W]]]"
_WORD = rf"(?U){_IN}+"


def phrases(text: Column, lengths: list[int]) -> Column:
    """Stretches of so many words, from a word's start to a word's end, lower-cased, with what stands between them as it is."""
    each = [F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)(?<!{_IN})(?=({_IN}++(?:{_OUT}++{_IN}++){{{n - 1}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(each[0] if len(each) == 1 else F.flatten(F.array(*each)))


def words_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))


def as_words(phrase: Column) -> Column:
    """The expression of a phrase that stands as words, whatever the case."""
    return F.concat(F.lit(r"(?iu)\b"), F.regexp_replace(phrase, r"([\\.\[\]{}()*+?^$|/\-])", r"\\$1"), F.lit(r"\b"))


def phrase_matches(texts: DataFrame, text: str, lexicon: DataFrame, phrase: str, on: list[str], light: bool = False, tried: bool = True) -> DataFrame:
    """``texts`` joined with the ``lexicon`` rows whose phrase stands in the text as words, whatever the case.

    ``on`` are further columns that must be equal, such as the rule set. A text's stretches of one, two ... words are joined by
    equality with the phrases of so many words. Phrases that begin or end with another character than a letter, digit or
    underscore, of which a word boundary asks for a word beyond them, go by their inner words first and are then tried as
    an expression. All columns of ``texts`` travel with every stretch, so give short texts (clauses, names); for long ones ask for
    ``light`` matches, without the text and without that trial, which the caller makes by `as_words` on the text; with a small
    lexicon the text may stay (nothing is shuffled) while ``tried=False`` leaves out the trial alone.
    """
    columns = [c for c in texts.columns if not (light and c == text)]
    own = lexicon.select(*on, F.col(phrase).alias("__phrase"), F.struct(*(c for c in lexicon.columns)).alias("__entry")).where(F.length("__phrase") > 0)
    inner = F.regexp_replace(F.lower("__phrase"), r"(?U)^\W+|\W+$", "")
    # stored, so that its own size is known, not an estimate by the table that it was drawn from
    dim = kept(own.withColumn("__k", inner).where("__k <> ''").withColumn("__edge", F.col("__k") != F.lower("__phrase")), "phrases")
    lengths = _lengths(dim, words_of(F.col("__k")))
    if not lengths:
        return texts.limit(0).crossJoin(lexicon.drop(*on).limit(0))
    met = texts.select(*columns, F.explode(phrases(F.col(text), lengths)).alias("__k")).join(small(dim), [*on, "__k"])
    if tried and not light:
        met = met.where(~F.col("__edge") | F.regexp_like(F.col(text), as_words(F.col("__phrase"))))
    return met.select(*columns, *(F.col("__entry")[c].alias(c) for c in lexicon.columns if c not in on))
