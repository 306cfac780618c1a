"""Sides of joins that may be sent to every executor."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medtab.sources.scratch import kept

#: Bytes, as the optimiser estimates a side from its files and rows, up to which it is broadcast. Files are compressed; in memory
#: this is some tens of megabytes.
SMALL_BYTES = 8 << 20


def is_small(side: DataFrame) -> bool:
    """By the optimiser's estimate; rows that the driver made have none, so a side made of them is measured by a job."""
    plan = side._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) <= SMALL_BYTES:
        return True
    if "LogicalRDD" not in plan.toString():
        return False
    return (side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0) <= SMALL_BYTES


def small(side: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """``side`` marked for broadcast where its estimated bytes are within SMALL_BYTES, else as it is: the join then shuffles, or
    adaptive execution broadcasts it by its measured size. ``bound`` is a table of which ``side`` has
    at most one narrow row for each of its rows, whose estimate then counts."""
    return F.broadcast(side) if is_small(side if bound is None else bound) else side


def read_once(rows: DataFrame, keys: list[str], read: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``rows`` with what ``read`` adds to the columns ``keys``, on which alone it rests; it may also leave rows out.

    Where the different values are few enough to be sent to every task, each is read once and joins its rows (nulls too); else
    each is read where it stands. Rows that are costly to make should be stored, as they are gone through twice.
    """
    different = kept(rows.select(*keys).distinct(), name)
    if is_small(different):
        told = kept(read(different), f"{name}-read")
        if is_small(told):
            own = [f"__key{i}" for i in range(len(keys))]
            told = told.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), *(c for c in told.columns if c not in keys))
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)])
            return rows.join(F.broadcast(told), same).drop(*own)
    return read(rows)
