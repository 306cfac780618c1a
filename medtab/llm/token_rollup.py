"""Token counts by source, language and tokenizer version, maintained from batches of document changes.

A change carries the images of a document's row before and after it. Its counts enter the totals with a sign: what an
insert adds, a delete takes away, and a revision does both. Totals are additive, so a batch is reduced to one signed row for
each group before it is stored, and the state is the sum of the stored batches. A batch is written by Spark's committer
into a folder named after its id, whose success marker is the commit: a batch that is delivered again is skipped, and one
whose job died left no marker and is written anew. After so many batches the totals are carried into a base: a folder with
the summed groups and the ids of the batches in it, again with one success marker as its commit. Reads take the newest base
and the batches after it, so they don't grow with the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medtab.llm.common import cut, scratch_path
from medtab.llm.token_store import slices, tokens_of

#: Counting rules by tokenizer version, as the regular expression of one token.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "runs-2": r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[^A-Za-z0-9\x00-\x20\x7F-\x{10FFFF}]",
}
KEYS = ["source", "lang", "version"]
TOTALS = "source string, lang string, version string, docs long, tokens long"
#: Batches behind the base from which a commit carries them into a new one.
COMPACT = 32


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a whole text under a counting rule (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def counted(docs: DataFrame, versions: list[str] | None = None, text: str = "text") -> DataFrame:
    """``(doc_id, source, lang, version, tokens)``: one row for each document and version, the text read once."""
    images = F.array(*(F.struct(F.lit(v).alias("version"), count_tokens(F.col(text), v).alias("tokens")) for v in versions or VERSIONS))
    return docs.select("doc_id", "source", "lang", F.explode(images).alias("i")).select("doc_id", "source", "lang", "i.version", "i.tokens")


def counted_by(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """``counted`` for one version: the ids that a file of the tokenizers library gives whole texts (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens_of(tokenizer)
        for b in batches:
            text = b.schema.get_field_index("text")
            for at, count in slices(b.column(text)):
                part = b.slice(at, count)
                yield part.set_column(text, "tokens", pa.array(t.encode_column(part.column(text))[1]))

    rows = docs.select("doc_id", "source", "lang", F.lit(version).alias("version"), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, tokens long")


def image(version: str, tokens: str) -> Column:
    """A document's row as one version counts it."""
    return F.struct("source", "lang", F.lit(version).alias("version"), F.col(tokens).cast("long").alias("tokens"))


def no_image() -> Column:
    """What an insert has before it and a delete after it."""
    return F.lit(None).cast("struct<source:string,lang:string,version:string,tokens:bigint>")


def signed(changes: DataFrame) -> DataFrame:
    """One batch's changes ``(before, after)`` as signed totals, one row a group; groups that come out even are left out."""
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("i")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("i")))
    rows = changes.select(F.explode(both).alias("x")).where("x.i is not null").select("x.sign", "x.i.*")
    sums = rows.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
    return sums.where("docs <> 0 or tokens <> 0")


class Rollup:
    """The stored state under ``path``; any number of readers, one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT):
        self.spark, self.path, self.after = spark, path.rstrip("/"), compact

    def _fs(self, folder: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the folders ``<kind>=<number>`` that have their success marker."""
        root, fs = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = [n for n in names if n.startswith(f"{kind}=")]
        return sorted(int(n[len(kind) + 1 :]) for n in found if fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[0]))

    def _base(self) -> tuple[int, set[int]]:
        """Number of the newest base (0: none) and the batches in it."""
        bases = self._numbers("base")
        if not bases:
            return 0, set()
        held = self.spark.read.schema(f"{TOTALS}, batch long").parquet(f"{self.path}/base={bases[-1]}").where("batch is not null")
        return bases[-1], {r.batch for r in held.select("batch").collect()}

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Apply a batch once; False where it had been committed before."""
        pending = self._numbers("batch")
        if int(batch_id) in pending or int(batch_id) in self._base()[1]:
            return False
        signed(changes).coalesce(8).write.mode("overwrite").parquet(f"{self.path}/batch={int(batch_id)}")
        if len(pending) + 1 >= self.after:
            self.compact()
        return True

    def batches(self) -> list[int]:
        """Ids of all committed batches."""
        return sorted({*self._numbers("batch"), *self._base()[1]})

    def compact(self) -> None:
        """Carry all committed batches into a new base; what it holds is removed afterwards, and ignored until then."""
        number, held = self._base()
        done = self._numbers("batch")
        ids = self.spark.createDataFrame([(i,) for i in sorted({*held, *done})], "batch long")
        rows = self.totals().withColumn("batch", F.lit(None).cast("long")).unionByName(ids, allowMissingColumns=True)
        rows.coalesce(8).write.mode("overwrite").parquet(f"{self.path}/base={number + 1}")
        for name in [f"batch={b}" for b in done] + ([f"base={number}"] if number else []):
            at, fs = self._fs(f"{self.path}/{name}")
            fs.delete(at, True)

    def totals(self) -> DataFrame:
        """``(source, lang, version, docs, tokens)`` over all committed batches; empty groups are gone."""
        number, held = self._base()
        folders = [f"base={number}"] if number else []
        folders += [f"batch={b}" for b in self._numbers("batch") if b not in held]
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*(f"{self.path}/{f}" for f in folders))
        sums = rows.where("docs is not null").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def replay(docs: DataFrame) -> DataFrame:
    """Totals of ``docs`` after a history of batches made from the table itself.

    Batch 1 inserts every document as counted by the first version; batch 2 deletes those of part 0 of 7 (by md5 of the
    id); batch 3 revises those of part 1 of 7 to the second version, arrives twice, and counts once. The first two are carried
    into a base before the third comes. Null sources and languages are groups of their own; rows that repeat an id each count;
    null and empty texts count none; further columns are ignored.
    """
    first, second = VERSIONS
    part = F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 7
    rows = cut(docs.select(part.alias("part"), "source", "lang", count_tokens(F.col("text"), first).alias("a"), count_tokens(F.col("text"), second).alias("b")), "counts")
    old, new = image(first, "a"), image(second, "b")
    state = Rollup(docs.sparkSession, scratch_path(docs.sparkSession, "rollup"), compact=2)
    state.commit(1, rows.select(no_image().alias("before"), old.alias("after")))
    state.commit(2, rows.where(F.col("part") == 0).select(old.alias("before"), no_image().alias("after")))
    revised = rows.where(F.col("part") == 1).select(old.alias("before"), new.alias("after"))
    state.commit(3, revised)
    state.commit(3, revised)
    return state.totals()


def replayed_sql() -> str:
    """DuckDB SQL of ``replay`` with folds taken from md5."""
    first, second = VERSIONS
    return rf"""
WITH d AS (SELECT source, lang, CAST('0x' || substr(md5('fold:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 7 AS f,
  len(regexp_extract_all(coalesce(text, ''), '{VERSIONS[first]}')) AS a, len(regexp_extract_all(coalesce(text, ''), '{VERSIONS[second]}')) AS b FROM documents),
kept AS (SELECT source, lang, CASE WHEN f = 1 THEN '{second}' ELSE '{first}' END AS version, CASE WHEN f = 1 THEN b ELSE a END AS tokens FROM d WHERE f IS NULL OR f <> 0)
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM kept GROUP BY ALL"""
