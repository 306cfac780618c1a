"""Connected components of an edge table as repeated joins (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medtab.llm.common import cut


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges(a long, b long)`` to ``(node long, comp long)``, comp being the smallest node of the component.

    Each round hangs every node's larger neighbours, then its smaller ones, under the smallest node around it; stars
    remain after a number of rounds that is logarithmic in the component size. Nodes without an edge to another node
    do not appear. Self-loops, repeated edges and nulls are ignored. Rounds are written tables, so lineage stays short.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = cut(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        small = cut(small, "small")
        # stars only: no node that hangs under another has something under itself
        settled = small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
        again = small.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
        e = small
        if settled and again:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
