"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys: each key's 128-bit digest, in how many documents it was seen and
the largest id among them, bucketed and sorted by the digest. A new batch of documents is dealt into
the same buckets and merge-anti-joined with the runs: the keys that no run has become a run on level
0, so runs never share a key; what the batch says about the others is kept beside the runs, in tables
of the same form. When a level holds ``FANOUT`` tables they are compacted into one on the next level,
two at a time, so a store of any number of batches has few tables. All tables of a store have the
same buckets: joins with them and compactions merge sorted buckets and deal nothing out anew. There
are at least as many buckets as shuffle partitions, and more for more than ``BUCKET_ROWS`` rows in
each.

The tables are in the session's catalog, which alone knows buckets, until ``LineRuns.close``; what
``common_lines`` finds is staged, and its store closed.

Defined results: a null or empty text is one empty line; a line's key is the line with white space
(space and the control characters 9 to 13) stripped at both ends and A-Z lowered; lines repeated
inside a document count once for that document; rows that repeat a doc_id are one document; rows
without a doc_id are kept whole and not counted; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.runtime import hadoop_path, release, releases_staged, stage, staging_root

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 3
BATCHES = 4
BUCKET_ROWS = 1 << 22

_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def _digest(key: Column) -> list[Column]:
    """Two 64-bit halves: as good as 128 bits, and plain longs to sort and join."""
    return [F.xxhash64(key).alias("low"), F.xxhash64(key, F.lit(1)).alias("high")]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every line with a long key: ``doc_id``, ``text_key``, ``line`` (from 0), ``low``, ``high``.

    ``text_key`` tells texts apart that share a doc_id.
    """
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", _text_key(), F.posexplode(split_lines(F.col("text"))).alias("line", "held"))
        .withColumn("held", line_key(F.col("held")))
        .where(F.length("held") >= min_chars)
        .select("doc_id", "text_key", "line", *_digest(F.col("held")))
    )


def _text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


class LineRuns:
    """The runs of one store. ``levels[n]`` names those of level n; ``again`` in the same way the
    tables of what later batches have said about keys of earlier runs."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark = spark
        self.buckets = buckets
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.again: list[list[str]] = [[]]
        self._all: set[str] = set()

    def _write(self, rows: DataFrame) -> str:
        """A new table; the tasks of ``rows`` have a bucket each."""
        table = f"{self.name}_{uuid.uuid4().hex}"
        self._all.add(table)
        (
            rows.write.bucketBy(self.buckets, "low", "high")
            .sortBy("low", "high")
            .option("path", f"{staging_root(self.spark)}/{table}")
            .format("parquet")
            .saveAsTable(table)
        )
        return table

    def _drop(self, *tables: str) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            filesystem, path = hadoop_path(self.spark, f"{staging_root(self.spark)}/{table}")
            filesystem.delete(path, True)
            self._all.discard(table)

    def close(self) -> None:
        """Drop all tables of the store."""
        self._drop(*list(self._all))
        self.levels, self.again = [[]], [[]]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose line no run has."""
        for table in [t for level in self.levels for t in level]:
            keys = keys.join(self.spark.table(table), ["low", "high"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch's keys (one row per document and key), and compact full levels."""
        counted = keys.groupBy("low", "high").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")
        )
        batch = self._write(counted.repartition(self.buckets, "low", "high"))
        if not any(self.levels):
            self._push(self.levels, batch)
            return
        rows = self.spark.table(batch)
        run = self._write(self.unseen(rows))
        seen = self._write(rows.join(self.spark.table(run), ["low", "high"], "left_anti"))
        self._drop(batch)
        self._push(self.levels, run)
        self._push(self.again, seen)

    def _push(self, levels: list[list[str]], table: str) -> None:
        levels[0].append(table)
        level = 0
        while len(levels[level]) >= FANOUT:
            if len(levels) == level + 1:
                levels.append([])
            full, levels[level] = levels[level], []
            levels[level + 1].append(self._compacted(full))
            level += 1

    def _compacted(self, tables: list[str]) -> str:
        return reduce(self._merged, tables)

    def _merged(self, left: str, right: str) -> str:
        """Two tables as one, by a merge of their sorted buckets."""
        merged = self._write(self.merge(self.spark.table(left), self.spark.table(right)))
        self._drop(left, right)
        return merged

    @staticmethod
    def merge(left: DataFrame, right: DataFrame, how: str = "full") -> DataFrame:
        right = right.toDF("low", "high", "more_docs", "later_doc")
        return left.join(right, ["low", "high"], how).select(
            "low",
            "high",
            (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more_docs", F.lit(0))).alias("n_docs"),
            F.greatest("last_doc", "later_doc").alias("last_doc"),
        )

    def merged(self) -> DataFrame:
        """All that the store knows: ``low``, ``high``, ``n_docs``, ``last_doc``; every key once."""
        runs = [self.spark.table(t) for level in self.levels for t in level]
        later = [t for level in self.again for t in level]
        if later:
            self.again = [[self._compacted(later)]]
            seen = self.spark.table(self.again[0][0])
            runs = [self.merge(run, seen, "left") for run in runs]
        return reduce(DataFrame.unionByName, runs)


def common_lines(
    lines: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """Of the long lines of a table, those that go: ``doc_id``, ``text_key``, ``line``.

    The keys pass through the runs in ``batches`` batches of documents.
    """
    spark = lines.sparkSession
    keys = lines.select("doc_id", "low", "high").distinct()
    keys = stage(keys.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "line-keys")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark, max(partitions, math.ceil(keys.count() / batches / BUCKET_ROWS)))
    try:
        for number in range(batches):
            runs.add(keys.where(F.col("batch") == number))
        release(keys)
        common = stage(runs.merged().where(F.col("n_docs") >= min_docs), "common-lines")
    finally:
        runs.close()
    return (
        lines.join(common, ["low", "high"])
        .where(F.col("doc_id") != F.col("last_doc"))
        .select("doc_id", "text_key", "line")
    )


@releases_staged
def drop_common_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES
) -> DataFrame:
    """The documents with their common lines gone; other columns stay as they are.

    A line is gone from every document but the largest doc_id that holds it, if at least
    ``min_docs`` documents hold its key and the key has at least ``min_chars`` code points.
    Adds ``n_lines`` (before) and ``n_dropped``, in place of columns of these names; a null text
    becomes an empty one.
    """
    lines = stage(long_lines(docs, min_chars), "long-lines")
    gone = (
        common_lines(lines, min_docs, batches)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("line").alias("gone"))
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    others = [c for c in kept if c != "text"]
    # the caller's columns are inside one, so that their names meet none of these
    split = docs.select(
        F.struct(*others).alias("row"), "doc_id", _text_key(), split_lines(F.col("text")).alias("lines")
    )
    joined = split.join(gone, ["doc_id", "text_key"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(left, lambda n: F.get(F.col("lines"), n)), "\n")
    )
    return joined.select(
        *((text if c == "text" else F.col("row")[c]).alias(c) for c in kept),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
