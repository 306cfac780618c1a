"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FINE = 1 << 30
#: Bytes of text of a training sample, and the part of them that one text may have.
SAMPLE_BYTES, PART = 64_000_000, 64
#: What a row counts besides its text.
ROW = 1024


def within_bytes(rows: DataFrame, most: int = SAMPLE_BYTES) -> DataFrame:
    """Of a sample ``(doc_id, text, ...)`` as many rows as hold ``most`` bytes of text, by a hash of id and text.

    A text of more than ``most / PART`` bytes is left out by itself and pushes out no other, wherever its hash falls; so the
    sample holds at least ``most - most / PART`` bytes or all other rows. A row counts ``ROW`` bytes besides its text, which
    bounds their number; rows that repeat id and text stay or go together. Only hashes and lengths are gathered, those of the
    smallest hashes that could fit; texts are read for the rows that stay. Null texts count as empty.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    short = size <= most // PART
    narrow = rows.where(short).select(F.xxhash64("doc_id", "text", F.lit(29)).alias("h"), (size + ROW).cast("long").alias("n")).groupBy("h").agg(F.sum("n").alias("n"))
    total, last = 0, None
    for h, n in narrow.orderBy("h").limit(most // ROW + 1).collect():
        total += n
        if total > most:
            break
        last = h
    return rows.where(short & (F.lit(False) if last is None else F.xxhash64("doc_id", "text", F.lit(29)) <= last))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, size: int) -> DataFrame:
    """``docs`` rows with ``label`` for about ``size`` labelled ids that ``allowed`` (over doc_id) lets in.

    The ids are those whose hash lies under a threshold set from their count, so the sample covers the whole table and is
    the same on every run; at most ``2 * size`` ids, which bounds what is broadcast. Rows with a null label or doc_id teach nothing; an id labelled in
    several ways counts by its largest label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    share = int(_FINE * min(1.0, size / max(1, total)))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(_FINE)) < share).limit(2 * size)
    return docs.join(F.broadcast(picked), "doc_id")
