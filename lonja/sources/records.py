"""The records of delimited text files whose quoted fields hold line breaks, found in parallel.

Files are read as lines, in blocks as Spark splits them. Where a record begins depends on whether a
line begins inside quotes, and so on all lines before it. A line, and likewise a block, is a
function of that state: from outside or from inside, in which state does it end? Tasks compose the
lines of their block to one such function, and how many records begin in it for either state. A
running composition over the blocks of a file then gives each block's state and first record number,
and a second pass gives every line its record. Only records of several lines meet in a shuffle.

Quotes count where a field begins, as in the reader that splits the records into fields: inside an
unquoted field (``5" pipe``) they are text. A file that ends inside quotes is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.runtime import stage

_BLOCKS = "file string, block bigint, f0 int, f1 int, starts0 bigint, starts1 bigint, simple boolean"
_LINES = "file string, block bigint, n bigint, record bigint, alone boolean, value string"

_INSIDE = '[^"]*+(?:""[^"]*+)*+'


def _closed_fields(sep: str) -> str:
    mark = re.escape(sep)
    return f'(?:(?:"{_INSIDE}"[^{mark}]*+|[^"{mark}][^{mark}]*+)?+{mark})*+'


def opens(line: Column, sep: str) -> Column:
    """Whether a line that begins outside quotes ends inside them."""
    return line.contains('"') & line.rlike(rf'\A{_closed_fields(sep)}"{_INSIDE}\z')


def stays_inside(line: Column, sep: str) -> Column:
    """Whether a line that begins inside quotes ends inside them."""
    mark = re.escape(sep)
    again = rf'"[^{mark}]*+{mark}{_closed_fields(sep)}"{_INSIDE}\z'
    return ~line.contains('"') | line.rlike(rf"\A{_INSIDE}(?:\z|{again})")


def _lines(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """Every line with its place: ``file``, ``block`` and, inside the block, the order of ``n``."""
    read = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value")
    if encoding.upper() != "UTF-8":
        value = F.decode(value.cast("binary"), encoding)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        value.alias("value"),
        opens(value, sep).cast("int").alias("t0"),
        stays_inside(value, sep).cast("int").alias("t1"),
    )


def _states(t0: np.ndarray, t1: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Whether each line begins inside quotes, and the state after the last one."""
    constant, flips = t0 == t1, np.cumsum((t0 == 1) & (t1 == 0))
    last = np.maximum.accumulate(np.where(constant, np.arange(len(t0)), -1))
    known = np.maximum(last, 0)
    after = np.where(last >= 0, t0[known] ^ ((flips - flips[known]) & 1), state ^ (flips & 1))
    return np.concatenate([[state], after[:-1]]), int(after[-1])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batches cut where a block ends."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        files = batch.column("file").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if last > first:
                yield batch.column("file")[first].as_py(), int(blocks[first]), batch.slice(first, last - first)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: its function of the state, and how many records begin in it."""
    place, held = None, [0, 1, 0, 0, True]

    def row() -> pa.RecordBatch:
        values = [*place, *held]
        names = ["file", "block", "f0", "f1", "starts0", "starts1", "simple"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for file, block, batch in _runs(batches):
        if place != (file, block):
            if place:
                yield row()
            place, held = (file, block), [0, 1, 0, 0, True]
        t0, t1 = batch.column("t0").to_numpy(), batch.column("t1").to_numpy()
        for start in (0, 1):
            inside, held[start] = _states(t0, t1, held[start])
            held[2 + start] += int((inside == 0).sum())
        held[4] = held[4] and not t0.any()
    if place:
        yield row()


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line with the number of its record in the file, and whether it is all of it."""
    place, state, record = None, 0, 0
    for file, block, batch in _runs(batches):
        if place != (file, block):
            place = (file, block)
            state, record = batch.column("state")[0].as_py(), batch.column("first")[0].as_py() - 1
        inside, state = _states(batch.column("t0").to_numpy(), batch.column("t1").to_numpy(), state)
        numbers = record + np.cumsum(inside == 0)
        record = int(numbers[-1])
        alone = (inside == 0) & (batch.column("t0").to_numpy() == 0)
        columns = [batch.column(name) for name in ("file", "block", "n")]
        columns += [pa.array(numbers), pa.array(alone), batch.column("value")]
        yield pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "record", "alone", "value"])


def _block_states(summaries: DataFrame) -> DataFrame:
    """Each block's ``state`` at its start, ``first`` record number and state at its end."""
    order = Window.partitionBy("file").orderBy("block")
    flips = F.sum(((F.col("f0") == 1) & (F.col("f1") == 0)).cast("int")).over(order)
    known = F.when(F.col("f0") == F.col("f1"), F.struct("block", F.col("f0").alias("value"), "flips"))
    last = F.max(known).over(order)
    parity = F.when(last.isNull(), F.col("flips") % 2).otherwise(
        (last["value"] + F.col("flips") - last["flips"]) % 2
    )
    stated = summaries.withColumn("flips", flips).withColumn("after", parity.cast("int"))
    stated = stated.withColumn("state", F.lag("after", 1, 0).over(order))
    starts = F.when(F.col("state") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stated = stated.withColumn("starts", starts)
    return stated.select(
        "file",
        "block",
        "state",
        F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("first"),
        "after",
        # the first block of a file holds the header
        (F.col("simple") & (F.col("state") == 0) & (F.col("block") > 0)).alias("simple"),
        (F.lead("block").over(order).isNull()).alias("ends"),
    )


def read_records(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> tuple[DataFrame, list[str]]:
    """Every record but the files' headers as column ``value``, and the distinct headers.

    Raises ``ValueError`` for files that end inside quotes.
    """
    lines = _lines(spark, path, sep, encoding)
    places = lines.select("file", "block", "t0", "t1").mapInArrow(_summarise, _BLOCKS)
    blocks = stage(_block_states(places), "csv-blocks")
    broken = [row["file"] for row in blocks.where("ends and after = 1").select("file").limit(5).collect()]
    if broken:
        raise ValueError(f"text ends inside quotes: {', '.join(broken)}")

    placed = lines.join(blocks.select("file", "block", "state", "first", "simple"), ["file", "block"])
    # a broadcast join keeps the lines' order, another one doesn't
    hard = placed.where(~F.col("simple")).drop("simple").sortWithinPartitions("file", "block", "n")
    numbered = hard.mapInArrow(_number, _LINES)
    split = numbered.where(~F.col("alone")).groupBy("file", "record")
    parts = F.array_sort(F.collect_list(F.struct("block", "n", "value")))
    joined = split.agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    whole = numbered.where("alone").select("file", "record", "value").unionByName(joined)
    headers = whole.where("record = 0").select(_without_return(F.col("value")).alias("value")).distinct()
    named = [row["value"] for row in headers.limit(6).collect()]
    rest = whole.where("record > 0").select("value").unionByName(placed.where("simple").select("value"))
    rest = rest.select(_without_return(F.col("value")).alias("value"))
    return rest.where(F.col("value") != ""), named


def _without_return(value: Column) -> Column:
    return F.regexp_replace(value, r"\r\z", "")
