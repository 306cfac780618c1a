"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index stores postings (term, document, position) of the training documents, for terms that occur in a benchmark
window. Document frequencies come from those postings. For each window the postings of its rarest terms are fetched, each
moved back by the term's offset in the window, and intersected on (document, window, start): what remains are places where
these terms stand as in the window. Full windows are then compared word by word there, which gives exact phrase matches.
With ``slop`` above 0 the lists meet where they come within so many words of each other, and a place matches where every
term of the window, as often as it has it, stands in the window's span stretched by so many words on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medtab.llm.common import ascii_lower, cut

#: What separates words (every ASCII character that is neither a digit nor a lower-case letter).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest terms of a window whose postings are intersected.
ANCHORS = 2
#: Counted rows of a side up to which it is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; an empty array for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def windows_of(items: DataFrame, size: int = 10) -> DataFrame:
    """``(item_id, win, terms)``: every run of ``size`` words of an item; all of them for one with fewer, but not none.

    Windows are numbered by content, so items that share a phrase share its ``win``.
    """
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    runs = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("terms"))
    return runs.select("item_id", F.xxhash64(F.array_join("terms", " ")).alias("win"), "terms").distinct()


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a side for broadcast where its counted rows are within BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings ``(term, doc_id, pos)`` of every occurrence of the given terms (positions from 0)."""
    n = terms.count()
    post = docs.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return cut(post.join(small(terms, n), "term").select("term", "doc_id", "pos"), "index")


def anchors(wins: DataFrame, index: DataFrame, count: int = ANCHORS) -> DataFrame:
    """``(win, rank, off, term)``: the ``count`` rarest places of each window, by the number of postings of their terms."""
    freq = index.groupBy("term").agg(F.count("*").alias("df"))
    placed = wins.select("win", F.posexplode("terms").alias("off", "term"))
    ranked = placed.join(freq, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("win").orderBy("df", "off"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= count)


def intersect(index: DataFrame, picks: DataFrame, count: int = ANCHORS, slop: int = 0) -> DataFrame:
    """``(doc_id, win, start)`` where the offset-adjusted postings of a window's rarest terms meet.

    With ``slop`` above 0 the lists need only come within twice that many words of the rarest term's: each of two terms may
    be off by that many.
    """
    picks = cut(picks.select("win", "rank", "off", "term"), "picks")
    n = picks.count()
    need = picks.groupBy("win").agg(F.max("rank").alias("need"))
    first = index.join(small(picks.where("rank = 1"), n), "term").select("doc_id", "win", (F.col("pos") - F.col("off")).alias("start"))
    found = first.distinct()
    for k in range(2, count + 1):
        other = index.join(small(picks.where(F.col("rank") == k), n), "term").select("doc_id", "win", (F.col("pos") - F.col("off")).alias("at"))
        has = found.join(small(need, n), "win")
        more, done = has.where(F.col("need") >= k).drop("need"), has.where(F.col("need") < k).drop("need")
        if slop:
            near = more.join(other, ["doc_id", "win"]).where(F.abs(F.col("at") - F.col("start")) <= 2 * slop).select("doc_id", "win", "start").distinct()
        else:
            near = more.join(other.withColumnRenamed("at", "start").distinct(), ["doc_id", "win", "start"])
        found = near.unionByName(done)
    return found.where("start >= 0") if not slop else found


def match_windows(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Matches ``(doc_id, win, start, len)`` and the windows ``(item_id, win, terms)`` they belong to.

    Each text is compared by itself: columns of ``carry`` say which of several rows that share a doc_id a match is in.

    With ``slop`` above 0 these are proximity matches; ``start`` is then where the window would start by its rarest term, and
    may be under 0.
    """
    wins = cut(windows_of(items, size), "windows")
    unique = wins.select("win", "terms").dropDuplicates(["win"])
    index = build_index(docs, unique.select(F.explode("terms").alias("term")).distinct())
    spots = intersect(index, anchors(unique, index), slop=slop)
    spots = cut(spots, "spots")
    # a check against the documents that have a spot, over the words of the span around it
    held = spots.groupBy("doc_id").agg(F.collect_set(F.struct("start", "win")).alias("spots"))
    texts = docs.select("doc_id", *carry, "text").join(held, "doc_id").select("doc_id", *carry, words_of(F.col("text")).alias("words"), "spots")
    span = lambda s: F.slice("words", F.greatest(s["start"] - slop, F.lit(0)) + 1, F.least(s["start"] - slop, F.lit(0)) + size + 2 * slop)
    found = texts.select("doc_id", *carry, F.explode(F.transform(F.filter("spots", lambda s: s["start"] + size + slop > 0), lambda s: F.struct(
        s["start"].alias("start"), s["win"].alias("win"), span(s).alias("span")))).alias("s")).select("doc_id", *carry, "s.*")
    found = found.join(small(unique, unique.count()), "win")
    if slop:
        times = lambda words, t: F.size(F.filter(words, lambda w: w == t))
        near = F.slice("span", 1, F.greatest(F.size("terms") + F.least(F.col("start") - slop, F.lit(0)) + 2 * slop, F.lit(0)))
        exact = found.where(F.size(near) > 0).withColumn("near", near).where(F.forall("terms", lambda t: times(F.col("near"), t) >= times(F.col("terms"), t)))
    else:
        exact = found.where(F.slice("span", 1, F.size("terms")) == F.col("terms"))
    return exact.select("doc_id", *carry, "win", "start", F.size("terms").alias("len")).distinct(), wins


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row for each row of ``docs``.

    A word is hit where it lies inside an exact occurrence of an item's window. Null and empty texts have no words; an
    empty ``items`` hits nothing; equal windows of several items count for each. Each row is judged by its own text, without
    a doc_id or with a shared one: postings carry a hash of id and text, and what they lead to is compared text by text
    under a second hash, so rows that share the first only cost a comparison. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id", "text").alias("doc_id"), F.xxhash64(F.lit("row"), "text", "doc_id").alias("row"))
    matches, wins = match_windows(docs, items.select("item_id", "text"), size, carry=("row",))
    matches = cut(matches, "matches")
    key = ["doc_id", "row"]
    order = Window.partitionBy(*key).orderBy("start", "end")
    spans = matches.select(*key, "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gain = F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))
    hit = spans.select(*key, gain.alias("gain")).groupBy(*key).agg(F.sum("gain").alias("n_hit"))
    named = matches.select(*key, "win").distinct().join(small(wins.select("item_id", "win"), wins.count()), "win").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    items_of = named.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = (docs.select("id", *key, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
           .join(hit, key, "left").join(items_of, key, "left"))
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_col, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


#: DuckDB SQL of ``contamination`` over documents and benchmark with windows of ten words.
SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k, least(10, len(w)) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, win.n, item_id FROM grams JOIN win ON grams.k = win.k AND grams.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
