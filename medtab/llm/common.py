"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medtab.sources.scratch import kept as cut
from medtab.sources.scratch import scratch_path, shared_dir

__all__ = ["ascii_lower", "cut", "fold", "give_back", "scratch_path", "shared_dir", "table"]

#: The ASCII letters and their lower forms, for folding that leaves other letters alone.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null ids: fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def give_back() -> None:
    """At a task's end: hand freed memory back to the system, since Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library may have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
