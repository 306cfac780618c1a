"""Exact top-k by inner product over norm buckets.

Vectors become integers, so scores are exact. Rows are dealt to buckets of like length (norm), longest first, and each
bucket to blocks of bounded size. The queries first meet the longest bucket, which gives each a k-th score to beat. That
score makes a local threshold for every other bucket: the least cosine with which one of its vectors could still enter.
A bucket whose threshold is above 1 is never sent the query. Inside a block the threshold chooses the pruning: a high one
keeps the longest vectors only (length), a low one bounds the product by the query's largest coordinates and the norm of
the rest (coordinates). What is left is verified by full products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medtab.llm.common import cut

#: Integer steps of 1.0; buckets by length; rows of a block and of a group of queries.
SCALE, BUCKETS, BLOCK_ROWS, QUERY_ROWS = 1024, 8, 8192, 4096
#: Coordinates of the partial product, and the local cosine threshold from which length alone prunes.
FOCUS, BY_LENGTH = 16, 0.9
_HITS = "query_id long, vec_id long, score long, copies long"


def quantised(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v, norm, dim)``: components as floor(SCALE * x); vectors null, empty or with a null or non-finite part leave."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(e * F.lit(float(SCALE))))
    rows = vectors.where("embedding is not null and vec_id is not null").where(~bad & (F.size("embedding") > 0)).select("vec_id", whole.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return rows.select("vec_id", "v", norm.alias("norm"), F.size("v").alias("dim"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2**53, else in Python integers."""
    if np.abs(rows).max(initial=0) * np.abs(q).max(initial=0) * len(q) < 2**53:
        return (rows @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows], object).clip(-(2**63), 2**63 - 1).astype(np.int64)


def search_block(ids: np.ndarray, rows: np.ndarray, norms: np.ndarray, copies: np.ndarray, queries: Iterator[tuple[int, np.ndarray, float, int | None]], k: int) -> list[tuple[int, int, int, int]]:
    """Each query's best ``k`` of a block that can be among its best ``k`` of all: (query, vector, score, rows that are this vector)."""
    order = np.argsort(-norms, kind="stable")
    ids, rows, norms, copies = ids[order], rows[order], norms[order], copies[order]
    square = rows**2
    out = []
    for qid, q, q_norm, beat in queries:
        alive = np.arange(len(ids))
        if beat is not None and beat > 0 and q_norm > 0:
            local = beat / (q_norm * norms[0]) if norms[0] > 0 else 2.0
            if local > 1 + 1e-9:
                continue
            # by length: products are at most the product of the norms
            alive = alive[: np.searchsorted(-norms, -(beat / q_norm) * (1 - 1e-9), side="right")]
            if local < BY_LENGTH and len(q) > 2 * FOCUS and len(alive) > 64:
                focus = np.argpartition(-np.abs(q), FOCUS)[:FOCUS]
                rest = np.sqrt(max(0.0, q_norm**2 - float(q[focus] @ q[focus])))
                seen = rows[np.ix_(alive, focus)]
                left = np.sqrt(np.maximum(norms[alive] ** 2 - square[np.ix_(alive, focus)].sum(axis=1), 0))
                alive = alive[(seen @ q[focus] + rest * left) * (1 + 1e-9) + 1e-6 >= beat]
        if not len(alive):
            continue
        score = products(rows[alive], q)
        own, times = ids[alive], copies[alive]
        keep = own != qid
        if beat is not None:
            keep &= score >= beat
        score, own, times = score[keep], own[keep], times[keep]
        best = np.lexsort((own, -score))[:k]
        out += [(qid, int(own[i]), int(score[i]), int(times[i])) for i in best]
    return out


def _search(k: int):
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(queries):
            rows = _matrix(block.v)
            beats = [None if pd.isna(b) else int(b) for b in queries.beat]
            out = search_block(block.vec_id.to_numpy(np.int64), rows, block.norm.to_numpy(float), block.copies.to_numpy(np.int64), zip(queries.vec_id.tolist(), _matrix(queries.v), queries.norm.tolist(), beats, strict=True), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "copies"], dtype="int64")

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query; a vector of several rows counts as often."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    every = hits.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(1).cast("long").alias("copies"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's ``k`` largest integer products with the other rows.

    ``is_query`` picks the queries by ``vec_id``. Ties go to the smaller vec_id; a query with fewer than ``k`` others gets
    them all. Vectors that are null, empty or hold a null or non-finite part take no part, and vectors of different
    dimensions never meet. Rows that repeat id and vector are one query, and as candidates as many rows as they are; further
    columns are ignored.
    """
    rows = cut(quantised(vectors).groupBy("vec_id", "v", "norm", "dim").agg(F.count("*").alias("copies")), "vectors")
    total = rows.count()
    edges = rows.select(F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 1000)).first()[0] or []
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(F.col("norm") < F.lit(float(e)), 1).otherwise(0)
    salts = max(1, -(-total // (BUCKETS * BLOCK_ROWS)))
    placed = rows.withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    queries = rows.where(is_query)
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(groups)).cast("int"))
    blocks = placed.groupBy("dim", "bucket", "salt").agg(F.max("norm").alias("longest"))
    key = ["dim", "bucket", "salt", "part"]

    def meet(asked: DataFrame, where: DataFrame) -> DataFrame:
        """Queries (with the blocks they go to) against those blocks, each block sent to the query groups that ask for it."""
        wanted = asked.select(*key).distinct()
        sent = placed.join(wanted, ["dim", "bucket", "salt"]).select(*(F.col(c).alias(c) for c in (*key, "vec_id", "v", "norm", "copies")))
        return asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(_search(k), _HITS)

    nearest = blocks.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    first = queries.join(blocks.join(nearest, ["dim", "bucket"]), "dim").withColumn("beat", F.lit(None).cast("long"))
    seed = cut(_best(meet(first.select(*key, "vec_id", "v", "norm", "beat"), blocks), k), "seed")
    beat = seed.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("beat"))
    rest = blocks.join(nearest.withColumnRenamed("bucket", "done"), "dim").where(F.col("bucket") > F.col("done"))
    can = F.col("beat").isNull() | (F.col("beat") <= F.col("norm") * F.col("longest") * (1 + 1e-9))
    asked = queries.join(beat, "vec_id", "left").join(rest, "dim").where(can).select(*key, "vec_id", "v", "norm", "beat")
    hits = seed.select("query_id", "vec_id", "score", "copies").unionByName(meet(asked, blocks))
    return _best(hits, k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of the query: rows with vec_id divisible by 100 against all others.
SQL = f"""
WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
