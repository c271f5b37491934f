"""Session settings and staged tables for jobs that read an intermediate more than once.

A staged table lives as long as something reads it. ``release`` drops one that its successor has
replaced. An operator marked with ``releases_staged`` drops on its return every table it has staged
but those that its result reads; they pass to the operator that called it, and in the end to the
application: ``drop_staged`` removes them, at the latest when Python ends.
"""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for; ``conf`` overrides them.

    Adaptive execution sizes shuffle partitions, splits skewed join partitions and turns a
    shuffle join into a broadcast only after it has measured the side.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = "8"
        settings["spark.driver.memory"] = "8g"
        settings["spark.ui.showConsoleProgress"] = "false"
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without it; there a new temporary folder is named instead.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="lonja-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _application_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/lonja-{spark.sparkContext.applicationId}"


# A query's shuffle files go when it has ended (Spark 4.1; unknown to others, and then without effect).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries inside have shuffled is removed from the executors' disks when they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives later joins the true size. What the
    write has shuffled is not needed any more and is removed from the executors' disks.
    """
    spark = df.sparkSession
    path = f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark)
    _innermost().add(path)
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def staged_bytes(df: DataFrame) -> int:
    """The bytes of the files that ``df`` reads."""
    return sum(folder_bytes(df.sparkSession, folder) for folder in _folders_read(df))


def folder_bytes(spark: SparkSession, path: str) -> int:
    filesystem, target = hadoop_path(spark, path)
    return filesystem.getContentSummary(target).getLength()


# For each thread the tables staged so far: by the application, by the operator that runs, by the
# operator that this one has called, and so on.
_scopes = threading.local()


def _innermost() -> set[str]:
    return _open_scopes()[-1]


def _open_scopes() -> list[set[str]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = [set()]
    return _scopes.open


def _folders_read(df: DataFrame) -> set[str]:
    """The folders of files that a plan reads, its subqueries included."""
    analyzed = df._jdf.queryExecution().analyzed()
    plans = [analyzed]
    found = analyzed.subqueriesAll()
    plans += [found.apply(n) for n in range(found.size())]
    folders = set()
    for plan in plans:
        leaves = plan.collectLeaves()
        for leaf in (leaves.apply(n) for n in range(leaves.size())):
            if leaf.getClass().getSimpleName() == "LogicalRelation":
                relation = leaf.relation()
                if relation.getClass().getSimpleName() == "HadoopFsRelation":
                    paths = relation.location().rootPaths()
                    folders |= {paths.apply(n).toString() for n in range(paths.size())}
    return folders


def _without_scheme(path: str) -> str:
    return path.split(":", 1)[-1].lstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    filesystem, target = hadoop_path(spark, path)
    filesystem.delete(target, True)


def release(*tables: DataFrame) -> None:
    """Drop the staged tables that these read: nothing else may read them any more."""
    for df in tables:
        read = {_without_scheme(folder) for folder in _folders_read(df)}
        for scope in _open_scopes():
            for path in [p for p in scope if _without_scheme(p) in read]:
                _delete(df.sparkSession, path)
                scope.discard(path)


def releases_staged(function: Callable) -> Callable:
    """Of the tables that ``function`` stages, only those that the DataFrame it returns reads stay.

    If it fails, or returns something else, none stays.
    """

    @functools.wraps(function)
    def run(*args, **kwargs):
        scopes = _open_scopes()
        own: set[str] = set()
        scopes.append(own)
        read: set[str] = set()
        try:
            result = function(*args, **kwargs)
            if isinstance(result, DataFrame):
                read = {_without_scheme(folder) for folder in _folders_read(result)}
            return result
        finally:
            scopes.pop()
            spark = SparkSession.getActiveSession()
            for path in own:
                if _without_scheme(path) in read:
                    scopes[-1].add(path)
                elif spark is not None:
                    _delete(spark, path)

    return run


_at_exit: set[str] = set()


def _drop_at_exit(spark: SparkSession) -> None:
    """Before Python ends, and with it the session, the application's staged tables go."""
    application = spark.sparkContext.applicationId
    if application in _at_exit:
        return
    _at_exit.add(application)

    def drop() -> None:
        active = SparkSession.getActiveSession()
        if active is not None and active.sparkContext.applicationId == application:
            drop_staged(active)

    atexit.register(drop)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table this application has staged."""
    _delete(spark, _application_folder(spark))
    for scope in _open_scopes():
        scope.clear()


def hadoop_path(spark: SparkSession, path: str | os.PathLike):
    """The Hadoop file system that owns ``path``, and the path as that system's object."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(str(path))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target
