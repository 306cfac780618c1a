"""Temporal URL filter, in DataFrame operations only.

A list is a history of dated entries: from its date an entry blocks or allows a domain (and what is below it), or takes a
standing entry back. Entries become validity intervals, from their date to the date of the next entry for the same key.
Every capture is evaluated against the intervals that hold its fetch time, over its host and the domains above it; of
those the longest key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Actions an entry may have; ``clear`` ends a standing entry.
ACTIONS = ("block", "allow", "clear")
#: Distinct list keys up to which intervals are broadcast; a longer list is joined by a shuffle with split skew.
BROADCAST_KEYS = 100_000


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without user, port or trailing dot; null where there is none."""
    authority = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"(:[0-9]*)?\.?(:[0-9]*)?$", "")
    return F.when(host != "", host)


def keys_of(host: Column) -> Column:
    """A host and the domains above it, longest first, single labels left out where there is more."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(n <= 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(key, action, since)`` as ``(key, action, since, until)``; until is exclusive, null while it stands.

    Entries of one key and time: the strictest counts (block, then allow, then clear). Entries with a null key, action or
    time, or another action, are left out; repeated ones count once.
    """
    good = entries.where(F.col("key").isNotNull() & F.col("since").isNotNull() & F.col("action").isin(*ACTIONS))
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    one = good.groupBy(F.lower("key").alias("key"), "since").agg(F.min_by("action", rank).alias("action"))
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return one.withColumn("until", until).where(F.col("action") != "clear").select("key", "action", "since", "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(page_id, url, fetched)`` with ``host``, ``n_active``, ``rule``, ``decision``.

    ``n_active`` counts the entries active at the fetch for the host and the domains above it; ``rule`` is the longest of
    their keys and decides (``block`` or ``allow``); where none is active the rule is null and the page is ``allow``. Null
    urls, urls without a host and null fetch times match no entry. Captures with equal page_id, url and time are one
    row with their number as ``n_rows``. Distinct (host, time) pairs are evaluated once, however many captures share them.
    """
    rows = (captures.select("page_id", "url", "fetched").groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n_rows"))
            .withColumn("host", host_of(F.col("url"))))
    asked = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    spread = asked.select("host", "fetched", F.explode(keys_of(F.col("host"))).alias("key"))
    valid = intervals(entries)
    if valid.select("key").count() <= BROADCAST_KEYS:
        valid = F.broadcast(valid)
    active = spread.join(valid, "key").where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    told = active.groupBy("host", "fetched").agg(F.count("*").alias("n_active"), F.max_by(F.struct("key", "action"), F.length("key")).alias("top"))
    out = rows.join(told, ["host", "fetched"], "left")
    return out.select("page_id", "url", "fetched", "n_rows", "host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
                      F.col("top.key").alias("rule"), F.coalesce("top.action", F.lit("allow")).alias("decision"))


def hashed(c: Column, salt: str) -> Column:
    """32 bits of md5 as a number: the same in Spark and SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), c)), 1, 8), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of a pages table, which has no fetch times: each page's time follows from its id, over three years."""
    day = hashed(F.col("page_id").cast("string"), "day:") % 1096
    return pages.select("page_id", "url", F.date_add(F.lit("2022-01-01").cast("date"), day.cast("int")).alias("fetched"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of a pages table and the domains above them, with one to three entries a key."""
    keys = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct().select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()
    h = hashed(F.col("key"), "list:")
    some = keys.withColumn("h", h).where("h % 3 < 2")
    first = F.date_add(F.lit("2021-06-01").cast("date"), (F.col("h") % 701).cast("int"))
    dated = F.array(
        F.struct(F.when(F.col("h") % 5 < 3, "block").otherwise("allow").alias("action"), first.alias("since")),
        F.struct(F.when(F.col("h") % 7 < 4, "clear").otherwise("block").alias("action"), F.date_add(first, (F.col("h") % 301 + 30).cast("int")).alias("since")),
        F.struct(F.lit("block").alias("action"), F.date_add(first, (F.col("h") % 301 + 400).cast("int")).alias("since")))
    return some.select("key", F.explode(F.slice(dated, 1, (F.col("h") % 3 + F.col("h") % 2 + 1).cast("int"))).alias("e")).select("key", "e.action", "e.since")


def filtered_pages(pages: DataFrame) -> DataFrame:
    """The filter over a whole pages table with the list derived from it."""
    return evaluate(page_captures(pages), page_list(pages)).withColumn("fetched", F.col("fetched").cast("string"))


_HASH = "CAST('0x' || substr(md5('{salt}' || {value}), 1, 8) AS BIGINT)"
SQL = rf"""
WITH rows AS (SELECT page_id, url, DATE '2022-01-01' + CAST({_HASH.format(salt="day:", value="CAST(page_id AS VARCHAR)")} % 1096 AS INTEGER) AS fetched, count(*) AS n_rows
  FROM pages GROUP BY page_id, url),
hosts AS (SELECT *, nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)', 1)), '^.*@', ''), '(:[0-9]*)?\.?(:[0-9]*)?$', ''), '') AS host FROM rows),
asked AS (SELECT DISTINCT host, fetched, string_split(host, '.') AS parts FROM hosts WHERE host IS NOT NULL),
spread AS (SELECT host, fetched, array_to_string(parts[i:], '.') AS key FROM (SELECT *, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) AS i FROM asked)),
keys AS (SELECT DISTINCT key, {_HASH.format(salt="list:", value="key")} AS h FROM spread),
dated AS (SELECT key, h, DATE '2021-06-01' + CAST(h % 701 AS INTEGER) AS first FROM keys WHERE h % 3 < 2),
entries AS (SELECT key, CASE WHEN h % 5 < 3 THEN 'block' ELSE 'allow' END AS action, first AS since FROM dated
  UNION ALL SELECT key, CASE WHEN h % 7 < 4 THEN 'clear' ELSE 'block' END, first + CAST(h % 301 + 30 AS INTEGER) FROM dated WHERE h % 3 + h % 2 + 1 >= 2
  UNION ALL SELECT key, 'block', first + CAST(h % 301 + 400 AS INTEGER) FROM dated WHERE h % 3 + h % 2 + 1 >= 3),
valid AS (SELECT * FROM (SELECT key, action, since, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM entries) WHERE action <> 'clear'),
told AS (SELECT host, fetched, count(*) AS n_active, arg_max(key, length(key)) AS rule, arg_max(action, length(key)) AS decision
  FROM spread JOIN valid USING (key) WHERE since <= fetched AND (until IS NULL OR fetched < until) GROUP BY host, fetched)
SELECT page_id, url, CAST(fetched AS VARCHAR) AS fetched, n_rows, host, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, rule, coalesce(decision, 'allow') AS decision
FROM hosts LEFT JOIN told USING (host, fetched)
"""
