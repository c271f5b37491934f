"""Bringing a batch of operations into the table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.runtime import folder_bytes, releases_staged, stage
from lonja.sources.csv_files import coerce_dates
from lonja.sources.store import CODEC, NO_KEY, StoredTable


def _fitted(schema: T.StructType, incoming: DataFrame) -> DataFrame:
    """The incoming columns that the table has, with the table's types."""
    types = {field.name: field.dataType for field in schema}
    known = [name for name in incoming.columns if name in types]
    if not known:
        raise ValueError("no column of the upload is in the table")
    dated = coerce_dates(incoming.select(*[F.col(f"`{name}`") for name in known]), schema)
    return dated.select(*[F.col(f"`{name}`").cast(types[name]).alias(name) for name in known])


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def upsert(target: DataFrame, incoming: DataFrame, key: str = "operation_id") -> DataFrame:
    """The table without the rows whose key arrives, and with every incoming row.

    Columns the upload lacks are NULL and columns the table lacks are ignored. Repeated
    incoming keys all stay; NULL keys match nothing; without the key column all is appended.
    """
    fresh = _fitted(target.schema, incoming)
    kept = target
    if key in fresh.columns:
        # rows without a key skip the join, where they would all fall in one partition
        keyed = target.where(F.col(key).isNotNull())
        kept = keyed.join(_keys(fresh, key), key, "left_anti").unionByName(
            target.where(F.col(key).isNull())
        )
    return kept.select(*target.columns).unionByName(fresh, allowMissingColumns=True)


def _hit_buckets(table: StoredTable, fresh: DataFrame) -> list[int]:
    """The buckets that the incoming keys fall into."""
    keyed = fresh.where(F.col(table.key).isNotNull())
    return sorted(row["bucket"] for row in keyed.select(table.bucket().alias("bucket")).distinct().collect())


@releases_staged
def upsert_table(table: StoredTable, incoming: DataFrame) -> StoredTable:
    """The next version of a stored table: ``upsert`` by the table's key, in place.

    Reads and writes only the buckets that the incoming keys fall into; all other files stay as
    they are, and rows without a key are added beside those that are there. Buckets are taken in
    rounds, so that the executors' disks hold a part of a large table at a time. Nothing changes if
    the upload cannot be read or another writer was faster (``StaleTable``).
    """
    # read once: the batch decides which buckets are read, and is joined and written
    fresh = stage(_fitted(table.schema, incoming), "upload", CODEC)
    parts = dict(table.parts)
    added = table.spark.createDataFrame([], table.schema).unionByName(fresh, allowMissingColumns=True)
    if table.key is not None and table.key in fresh.columns:
        hit = _hit_buckets(table, fresh)
        written = _replace_buckets(table, hit, fresh, added)
        parts = {bucket: paths for bucket, paths in parts.items() if bucket not in hit}
    else:
        written = table.write(added)
    for bucket, path in written.items():
        parts[bucket] = (*parts.get(bucket, ()), path) if bucket == NO_KEY else (path,)
    return table.succeed(written, parts)


def _replace_buckets(table: StoredTable, hit: list[int], fresh: DataFrame, added: DataFrame) -> dict[int, str]:
    """Write the rows of the hit buckets whose key does not arrive, and all added rows."""
    folders = [f"{table.folder}/data/{path}" for bucket in hit for path in table.parts.get(bucket, ())]
    rounds = table.rounds(sum(folder_bytes(table.spark, folder) for folder in folders))
    written: dict[int, str] = {}
    for n in range(rounds):
        of_round = F.pmod(table.bucket(), F.lit(rounds)) == n if rounds > 1 else F.lit(True)
        keys = _keys(fresh.where(of_round), table.key)
        kept = table.rows([bucket for bucket in hit if bucket % rounds == n]).join(keys, table.key, "left_anti")
        try:
            written |= table.write(kept.select(*added.columns).unionByName(added.where(of_round)))
        except BaseException:
            table.discard(written)
            raise
    return written


def upsert_summary(target: DataFrame, incoming: DataFrame, key: str = "operation_id") -> DataFrame:
    """Rows that arrive, table rows they replace, and arriving rows whose key is new.

    One pass over the table: of its rows only those whose key arrives are counted.
    """
    fresh = _fitted(target.schema, incoming)
    counted = F.count(F.lit(1))
    if key not in fresh.columns:
        none = F.lit(0).cast("bigint")
        return fresh.agg(counted.alias("incoming_rows")).select(
            "incoming_rows", none.alias("replaced_rows"), F.col("incoming_rows").alias("inserted_rows")
        )
    arriving = fresh.groupBy(key).agg(counted.alias("arriving"))
    held = target.select(key).join(_keys(fresh, key), key, "left_semi")
    held = held.groupBy(key).agg(counted.alias("held"))
    both = arriving.join(held, key, "left")
    none = F.lit(0).cast("bigint")
    return both.agg(
        F.coalesce(F.sum("arriving"), none).alias("incoming_rows"),
        F.coalesce(F.sum("held"), none).alias("replaced_rows"),
        F.coalesce(F.sum(F.when(F.col("held").isNull(), F.col("arriving"))), none).alias("inserted_rows"),
    )


def upsert_table_summary(table: StoredTable, incoming: DataFrame) -> DataFrame:
    """``upsert_summary`` of a stored table, from the buckets that the incoming keys fall into."""
    fresh = _fitted(table.schema, incoming)
    if table.key is None or table.key not in fresh.columns:
        return upsert_summary(table.rows([]), incoming, table.key or "")
    return upsert_summary(table.rows(_hit_buckets(table, fresh)), incoming, table.key)
