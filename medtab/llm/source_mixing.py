"""Mixing sources to target weights: iterative proportional fitting over token counts, then calibrated sampling.

Everything is DataFrame operations. Documents are summed to cells (source, language, topic); the cells' weights are raked
to each margin's targets in turn; a document is kept with its cell's probability, which is the ratio of raked to present
tokens, scaled so that the expected kept tokens meet the budget with no probability above 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medtab.llm.common import cut

MARGINS = ("source", "lang", "topic")
#: Powers that flatten each margin's token shares to its targets where none are given.
FLATTEN = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Rounds of raking, rounds of scaling, and the share of all tokens to keep.
SWEEPS, SCALINGS, BUDGET = 12, 6, 0.6
#: Sweeps go on past SWEEPS while a margin misses its target by more than this share of all tokens, up to so many.
TOLERANCE, MOST_SWEEPS = 1e-3, 48
#: What a null source or language is called; others stand behind a sign, so that none is called so.
NONE, SIGN = "(none)", "="


def topic_of(text: Column) -> Column:
    """A document's topic by its dominant form: tables, markup, shouting, lines of prose, or one paragraph."""
    t = F.coalesce(text, F.lit(""))
    words = F.greatest(F.regexp_count(t, F.lit("[^ \\n]+")), F.lit(1))
    return (F.when(F.regexp_count(t, F.lit(" \\| ")) * 4 >= words, "tables")
            .when(F.regexp_count(t, F.lit("[#$%&*!]{2}")) * 4 >= words, "markup")
            .when(words < 50, "short").when(F.regexp_count(t, F.lit("\\n")) > 0, "lines").otherwise("prose"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def placed(docs: DataFrame, keep: list[str], topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Columns ``keep`` with each document's margins (``m_<name>``) and tokens (``m_tokens``)."""
    topic = topic_of(F.col("text")) if topic is None else topic
    tokens = token_count(F.col("text")) if tokens is None else tokens
    named = lambda c: F.coalesce(F.concat(F.lit(SIGN), c), F.lit(NONE)).alias(f"m_{c}")
    margins = [named("source"), named("lang"), topic.alias("m_topic")]
    return docs.select(*keep, *margins, tokens.alias("m_tokens"))


def margin_errors(raked: DataFrame) -> DataFrame:
    """``(margin, value, target, share, error)`` of raked cells: what each margin value should and does have of all weight.

    Targets that no cell can meet (a value without tokens) show here.
    """
    out = None
    for m in MARGINS:
        sums = raked.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.first(f"t_{m}").alias("target"), F.sum("w").alias("w"))
        out = sums if out is None else out.unionByName(sums)
    whole = raked.agg(F.sum("w")).first()[0] or 0.0
    share = F.col("w") / F.lit(whole) if whole else F.lit(0.0)
    return out.select("margin", "value", "target", share.alias("share"), (share - F.col("target")).alias("error"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with their raked weight ``w``, which sums to the cells' tokens.

    A target is a table ``(value, share)`` of a margin; values it lacks get none, and shares are scaled to sum to 1. A
    margin without a table has its token shares flattened by FLATTEN. Nulls of a margin are one group, called NONE. The cells are few (distinct combinations), and each
    step is a window over one margin. Sweeps go on while ``margin_errors`` exceed TOLERANCE, MOST_SWEEPS at most: margins that
    contradict each other or the cells are then met as nearly as the last sweep does.
    """
    cells = cells.withColumns({m: F.coalesce(m, F.lit(NONE)) for m in MARGINS})
    out = cells
    for m in MARGINS:
        if targets and m in targets:
            shares = targets[m].groupBy(F.col("value").alias(m)).agg(F.sum("share").alias("share"))
            share = F.col("share") / F.sum("share").over(Window.partitionBy())
            shares = shares.select(m, share.alias(f"t_{m}"))
            out = out.join(shares, m, "left").withColumn(f"t_{m}", F.coalesce(f"t_{m}", F.lit(0.0)))
        else:
            sums = cells.groupBy(m).agg(F.sum("tokens").alias("own"))
            flat = F.pow(F.col("own").cast("double"), F.lit(FLATTEN[m]))
            sums = sums.select(m, (flat / F.sum(flat).over(Window.partitionBy())).alias(f"t_{m}"))
            out = out.join(sums, m)
    out = cut(out.withColumn("w", F.col("tokens").cast("double")), "cells")
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    k = 0
    while k < sweeps or (whole and k < MOST_SWEEPS and (margin_errors(out).agg(F.max(F.abs("error"))).first()[0] or 0) > TOLERANCE):
        for _ in range(4):
            for m in MARGINS:
                had = F.sum("w").over(Window.partitionBy(m))
                out = out.withColumn("w", F.when(had > 0, F.col("w") * F.col(f"t_{m}") * F.lit(float(whole)) / had).otherwise(0.0))
        out, k = cut(out, "raked"), k + 4
    return out


def calibrate(raked: DataFrame, budget: float = BUDGET, scalings: int = SCALINGS) -> DataFrame:
    """Cells with ``ratio`` (raked to present tokens) and ``p``, the probability to keep a document of the cell."""
    cells = cut(raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))), "ratios")
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    k = budget
    for _ in range(scalings):
        full = F.col("ratio") * F.lit(k) >= 1
        capped, free = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.coalesce("w", F.lit(0.0))))).first()
        if not free:
            break
        k = max(k, (budget * whole - (capped or 0)) / free)
    return cells.withColumn("p", F.when(F.col("ratio").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("ratio") * F.lit(k))))


def uniform(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) fixed by the id."""
    return F.coalesce(F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col(doc_id).cast("string"))), 1, 8), 16, 10).cast("double"), F.lit(0.0)) / F.lit(4294967296.0)


def mix(docs: DataFrame, keep: list[str], targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """Columns ``keep`` of the sampled documents with ``topic``, ``p`` and ``weight`` (1 / p).

    A document stays where its id's fixed number is under its cell's probability, so reruns and repeated rows agree. Null
    sources and languages are groups of their own, a null id has number 0 and stays; a cell without tokens costs nothing
    and is kept whole. An empty table stays empty.
    """
    rows = placed(docs, keep)
    if "text" not in keep:  # narrow rows: measured once and kept, not once for the cells and again for the sample
        rows = cut(rows, "placed")
    cells = rows.groupBy(*(F.col(f"m_{m}").alias(m) for m in MARGINS)).agg(F.sum("m_tokens").alias("tokens"))
    cells = cut(cells, "mixcells")
    p = calibrate(rake(cells, targets), budget).select(*(F.col(m).alias(f"m_{m}") for m in MARGINS), "p")
    u = uniform("doc_id") if "doc_id" in keep else uniform(keep[0])
    kept = rows.join(cut(p, "probabilities"), [f"m_{m}" for m in MARGINS]).where(u < F.col("p"))
    return kept.select(*keep, F.col("m_topic").alias("topic"), "p", (1 / F.col("p")).alias("weight"))


def sampled(docs: DataFrame) -> DataFrame:
    """``(doc_id, topic, p)`` of the documents that the mix keeps, p rounded to six places."""
    return mix(docs, ["doc_id"]).select("doc_id", "topic", F.round("p", 6).alias("p"))


def sql(view: str = "documents") -> str:
    """DuckDB SQL of ``sampled`` over a view."""
    parts = [f"""
base AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t FROM {view}),
counted AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens,
  greatest(len(regexp_extract_all(t, '[^ \\n]+')), 1) AS words, len(regexp_extract_all(t, ' \\| ')) AS pipes,
  len(regexp_extract_all(t, '[#$%&*!]{{2}}')) AS marks, len(regexp_extract_all(t, '\\n')) AS breaks FROM base),
placed AS (SELECT doc_id, source, lang, tokens, CASE WHEN pipes * 4 >= words THEN 'tables' WHEN marks * 4 >= words THEN 'markup'
  WHEN words < 50 THEN 'short' WHEN breaks > 0 THEN 'lines' ELSE 'prose' END AS topic FROM counted),
cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM placed GROUP BY ALL)"""]
    for m in MARGINS:
        parts.append(f"t_{m} AS (SELECT {m}, f / sum(f) OVER () AS t_{m} FROM (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {FLATTEN[m]}) AS f FROM cells GROUP BY {m}))")
    parts.append("whole AS (SELECT CAST(sum(tokens) AS DOUBLE) AS n FROM cells)")
    parts.append("r0 AS (SELECT *, CAST(tokens AS DOUBLE) AS w FROM cells " + " ".join(f"JOIN t_{m} USING ({m})" for m in MARGINS) + ")")
    k = 0
    for _ in range(SWEEPS):
        for m in MARGINS:
            parts.append(f"r{k + 1} AS (SELECT * REPLACE (CASE WHEN h > 0 THEN w * t_{m} * (SELECT n FROM whole) / h ELSE 0 END AS w) EXCLUDE (h) FROM (SELECT *, sum(w) OVER (PARTITION BY {m}) AS h FROM r{k}))".replace("SELECT * REPLACE", "SELECT * EXCLUDE (h) REPLACE").replace(") EXCLUDE (h) FROM", ") FROM"))
            k += 1
    parts.append(f"ratios AS (SELECT source, lang, topic, tokens, w, CASE WHEN tokens > 0 THEN w / tokens END AS ratio FROM r{k})")
    parts.append(f"k0 AS (SELECT CAST({BUDGET} AS DOUBLE) AS k)")
    for j in range(SCALINGS):
        parts.append(f"k{j + 1} AS (SELECT CASE WHEN free > 0 THEN greatest(k, ({BUDGET} * (SELECT n FROM whole) - capped) / free) ELSE k END AS k FROM (SELECT any_value(k) AS k, sum(CASE WHEN ratio * k >= 1 THEN tokens ELSE 0 END) AS capped, sum(CASE WHEN ratio * k >= 1 THEN 0 ELSE coalesce(w, 0) END) AS free FROM ratios, k{j}))")
    parts.append(f"p AS (SELECT source, lang, topic, CASE WHEN ratio IS NULL THEN 1 ELSE least(1, ratio * k) END AS p FROM ratios, k{SCALINGS})")
    # every stage is used once or is small; all of them are materialised, or nested views would be expanded again and again
    body = ",\n".join(x.strip().replace(" AS (", " AS MATERIALIZED (", 1) if x.startswith(("r", "k", "p ", "w", "t_")) else x.strip() for x in parts)
    return f"""WITH {body}
SELECT doc_id, topic, round(p, 6) AS p FROM placed JOIN p USING (source, lang, topic)
WHERE CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < p"""
