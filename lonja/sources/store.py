"""The stored operations table: versions, each a list of the folders that hold its rows.

    folder/versions/v00000012.json     a version: schema, layout, and the folders of each bucket
    folder/data/_write=<id>/_bucket=7/_by_year=v2025/part-....parquet

Rows are dealt into buckets by a hash of the table's key; rows without a key have a bucket of their
own. A change by key therefore writes only the buckets that its keys fall into, and the new version
names the other folders as they are. Versions are numbered, and a version's file is only ever
created, never replaced: of two writers that start from the same version the second gets a
``StaleTable`` error, whatever it has written is removed, and readers of any version keep their
files until ``vacuum``. The file system must refuse to create a name that exists (local folders and
HDFS do; a plain object store does not).

The values of partition columns are written in the folders' names behind a letter (``v2025``, or
``n`` for NULL) and read back as their column's type, so that texts such as ``007`` or the empty one
come back as they were and filters on these columns still leave out folders.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.runtime import hadoop_path, release, shuffles_dropped, stage, staged_bytes

#: About one for each gigabyte of the table is a good number; ``rebucket`` changes it.
BUCKETS = 32
NO_KEY = -1

# Rows are dealt out in rounds of buckets, one for so many bytes that they have staged, ROUNDS at most:
# the executors' disks hold the shuffle of one round at a time.
ROUND_BYTES = 1 << 30
ROUNDS = 8
CODEC = "zstd"

_WRITE, _BUCKET, _BY = "_write", "_bucket", "_by_"
_PARTITION_TYPES = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.DecimalType)


class StaleTable(RuntimeError):
    """Another writer has published a version since this one was read."""


@dataclass(frozen=True)
class StoredTable:
    """One version of a table. ``parts`` names the folders of each bucket, relative to ``data``."""

    spark: SparkSession
    folder: str
    version: int
    schema: T.StructType
    partition_by: tuple[str, ...]
    key: str | None
    buckets: int
    parts: Mapping[int, tuple[str, ...]]

    def rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        chosen = self.parts if buckets is None else sorted(set(buckets) & set(self.parts))
        paths = [f"{self.folder}/data/{path}" for bucket in chosen for path in self.parts[bucket]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([field for field in self.schema if field.name not in self.partition_by])
        stored = stored.add(_WRITE, T.StringType()).add(_BUCKET, T.IntegerType())
        for name in self.partition_by:
            stored = stored.add(_BY + name, T.StringType())
        read = self.spark.read.schema(stored).option("basePath", f"{self.folder}/data").parquet(*paths)
        return read.select(*[self._read_back(field) for field in self.schema])

    def _read_back(self, field: T.StructField) -> Column:
        if field.name not in self.partition_by:
            return F.col(f"`{field.name}`")
        written = F.col(f"`{_BY}{field.name}`")
        value = F.when(written != "n", F.substring(written, 2, 2**31 - 1))
        return value.cast(field.dataType).alias(field.name)

    def bucket(self) -> Column:
        """The bucket of a row."""
        if self.key is None:
            return F.lit(NO_KEY)
        hashed = F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets))
        return F.when(F.col(f"`{self.key}`").isNull(), NO_KEY).otherwise(hashed).cast("int")

    def write(self, rows: DataFrame) -> dict[int, str]:
        """Write rows beside the table's own, in no version yet; the folder of each bucket."""
        wanted = [(field.name, field.dataType) for field in self.schema]
        given = {field.name: field.dataType for field in rows.schema}
        if given != dict(wanted) or len(rows.columns) != len(wanted):
            raise ValueError(f"the rows' columns are not the table's: {given}")
        place = f"{_WRITE}={uuid.uuid4().hex}"
        by = [_BY + name for name in self.partition_by]
        values = [F.col(f"`{name}`").cast("string") for name in self.partition_by]
        encoded = [F.when(v.isNull(), "n").otherwise(F.concat(F.lit("v"), v)) for v in values]
        filesystem, target = hadoop_path(self.spark, f"{self.folder}/data/{place}")
        # what computing the rows has shuffled goes before they are dealt out
        held = stage(rows, "rows", CODEC)
        try:
            rounds = self.rounds(staged_bytes(held))
            for n in range(rounds):
                chosen = held.where(F.pmod(self.bucket(), F.lit(rounds)) == n) if rounds > 1 else held
                dealt = chosen.withColumns({_BUCKET: self.bucket(), **dict(zip(by, encoded))}).drop(*self.partition_by)
                # few files for each folder, and several tasks for a large one
                dealt = dealt.hint("rebalance", *[F.col(f"`{name}`") for name in (_BUCKET, *by)])
                with shuffles_dropped(self.spark):
                    dealt.write.mode("append").partitionBy(_BUCKET, *by).parquet(
                        f"{self.folder}/data/{place}", compression=CODEC
                    )
        except BaseException:
            filesystem.delete(target, True)
            raise
        finally:
            release(held)
        names = [status.getPath().getName() for status in filesystem.listStatus(target)]
        found = [name for name in names if name.startswith(f"{_BUCKET}=")]
        return {int(name.split("=")[1]): f"{place}/{name}" for name in found}

    def rounds(self, size: int) -> int:
        """In how many rounds so many bytes are dealt out: round n has the buckets that leave n."""
        return 1 if self.key is None else max(1, min(ROUNDS, self.buckets, -(-size // ROUND_BYTES)))

    def discard(self, written: Mapping[int, str]) -> None:
        """Delete what ``write`` has written."""
        for path in written.values():
            filesystem, target = hadoop_path(self.spark, f"{self.folder}/data/{path}")
            filesystem.delete(target.getParent(), True)

    def succeed(self, written: Mapping[int, str], parts: Mapping[int, Sequence[str]]) -> StoredTable:
        """Make ``parts`` the next version. If that is taken, what was written goes."""
        following = replace(self, version=self.version + 1, parts={b: tuple(p) for b, p in parts.items() if p})
        try:
            _create_version(following)
        except StaleTable:
            self.discard(written)
            raise
        return following


def _version_path(folder: str, version: int) -> str:
    return f"{folder}/versions/v{version:08d}.json"


def _create_version(table: StoredTable) -> None:
    """Create the version's file in one step, or raise ``StaleTable`` if there is one."""
    spark = table.spark
    kept = {
        "schema": table.schema.jsonValue(),
        "partition_by": table.partition_by,
        "key": table.key,
        "buckets": table.buckets,
        "parts": {str(bucket): paths for bucket, paths in table.parts.items()},
    }
    filesystem, draft = hadoop_path(spark, f"{table.folder}/versions/draft-{uuid.uuid4().hex}")
    _, target = hadoop_path(spark, _version_path(table.folder, table.version))
    stream = filesystem.create(draft, False)
    stream.write(json.dumps(kept).encode())
    stream.close()
    jvm = spark._jvm
    try:
        if filesystem.getScheme() == "file":  # its rename looks first and moves then
            link, existing = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft))
            jvm.java.nio.file.Files.createLink(link, existing)
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                filesystem.getUri(), spark._jsc.hadoopConfiguration()
            )
            context.rename(draft, target, options)
    except Py4JJavaError as error:
        if not filesystem.exists(target):
            raise
        raise StaleTable(f"{table.folder} has a version {table.version} already") from error
    finally:
        filesystem.delete(draft, False)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    filesystem, versions = hadoop_path(spark, f"{folder}/versions")
    if not filesystem.exists(versions):
        return []
    names = [status.getPath().getName() for status in filesystem.listStatus(versions)]
    return sorted(int(name[1:-5]) for name in names if name.startswith("v") and name.endswith(".json"))


def current_version(spark: SparkSession, folder: str) -> int:
    """The number of the table's current version; 0 if there is no table."""
    return max(_versions(spark, folder), default=0)


def open_table(spark: SparkSession, folder: str, version: int | None = None) -> StoredTable:
    """The table's current version, or an earlier one that is still kept."""
    version = version or current_version(spark, folder)
    if not version:
        raise FileNotFoundError(f"there is no table in {folder}")
    filesystem, path = hadoop_path(spark, _version_path(folder, version))
    stream = filesystem.open(path)
    try:
        kept = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return StoredTable(
        spark,
        folder,
        version,
        T.StructType.fromJson(kept["schema"]),
        tuple(kept["partition_by"]),
        kept["key"],
        kept["buckets"],
        {int(bucket): tuple(paths) for bucket, paths in kept["parts"].items()},
    )


def create_operations(
    df: DataFrame,
    folder: str,
    partition_by: Sequence[str] = (),
    key: str = "operation_id",
    buckets: int = BUCKETS,
) -> StoredTable:
    """Create the table from a source, or replace it and its layout.

    Without the key among its columns the table is one bucket, and uploads are only added to it.
    """
    unfit = [name for name in partition_by if not isinstance(df.schema[name].dataType, _PARTITION_TYPES)]
    if unfit or len(partition_by) >= len(df.columns):
        raise ValueError(f"not columns to partition by: {unfit or list(partition_by)}")
    spark = df.sparkSession
    key = key if key in df.columns else None
    version = current_version(spark, folder)
    return publish(df, StoredTable(spark, folder, version, df.schema, tuple(partition_by), key, buckets, {}))


def publish(df: DataFrame, table: StoredTable) -> StoredTable:
    """Make ``df`` all rows of the table, in a new version of the same layout.

    ``df`` may be computed from the table itself. If writing fails the table stays as it was;
    ``StaleTable`` says that ``table`` is not the current version any more.
    """
    written = table.write(df)
    return table.succeed(written, {bucket: [path] for bucket, path in written.items()})


def rebucket(table: StoredTable, buckets: int) -> StoredTable:
    """The same rows dealt into another number of buckets, one folder each."""
    return publish(table.rows(), replace(table, buckets=buckets))


def vacuum(spark: SparkSession, folder: str, keep: int = 1, older_than_hours: float = 24.0) -> None:
    """Drop all but the newest ``keep`` versions, and folders in none of these.

    Folders that are younger are left, as their writer may not have published yet.
    """
    versions = _versions(spark, folder)
    for version in versions[:-keep]:
        filesystem, path = hadoop_path(spark, _version_path(folder, version))
        filesystem.delete(path, False)
    tables = [open_table(spark, folder, version) for version in versions[-keep:]]
    used = {path for table in tables for paths in table.parts.values() for path in paths}
    before = (time.time() - older_than_hours * 3600) * 1000
    filesystem, data = hadoop_path(spark, f"{folder}/data")
    for write in filesystem.listStatus(data):
        if write.getModificationTime() > before:
            continue
        place = write.getPath().getName()
        buckets = [status for status in filesystem.listStatus(write.getPath()) if status.isDirectory()]
        held = [status.getPath() for status in buckets if f"{place}/{status.getPath().getName()}" in used]
        if not held:
            filesystem.delete(write.getPath(), True)
        for status in buckets if held else []:
            if f"{place}/{status.getPath().getName()}" not in used:
                filesystem.delete(status.getPath(), True)


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the table's current version."""
    return open_table(spark, folder).rows()


def save_snapshot(df: DataFrame, path: str) -> None:
    """Keep a copy of the table under a path that is not in use."""
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
