"""Session settings and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app: str = "trialweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; partition counts are left to the caller or the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local folder is made only on a local master that names none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if not current:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when the query ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


#: Spark lists the folders of an input with a task for each of them, up to this many.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextlib.contextmanager
def listing_by_cores(spark: SparkSession) -> Iterator[None]:
    """Inputs opened inside are listed by a few tasks per core, each for many folders: a task costs more than a folder."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


_TABLES: list[tuple[object, str]] = []


def write_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back.

    The rows are fixed on shared storage, later readers prune columns and push filters
    down, and a lost executor costs only its own tasks. The files go at the end of the
    surrounding `scratch` scope or else of the session. An empty result keeps its schema.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_end_with_query(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not _TABLES:
        atexit.register(drop_tables)
    _TABLES.append((spark.sparkContext._jvm, path))
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def _drop(tables: list[tuple[object, str]]) -> None:
    for jvm, path in tables:
        with contextlib.suppress(Exception):  # the session's JVM may be gone
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


def drop_tables() -> None:
    """Delete what `write_table` wrote; DataFrames over those tables end with it."""
    _drop(_TABLES)
    _TABLES.clear()


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end, but for those that the yielded function was given.

    What leaves the scope must not read the others any more: hand out written tables.
    """
    first = len(_TABLES)
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.scratch_path)
        return table

    try:
        yield keep
    finally:
        own = _TABLES[first:]
        _TABLES[first:] = [t for t in own if t[1] in kept]
        _drop([t for t in own if t[1] not in kept])


def tables_written() -> list[str]:
    """The paths of all tables that still exist, in the order in which they were written."""
    return [path for _, path in _TABLES]


def release_tables(paths: Iterable[str], reader: DataFrame) -> list[str]:
    """Drop these written tables, but for those that `reader` still reads; their paths are returned."""
    own = [t for t in _TABLES if t[1] in set(paths)]
    if not own:
        return []
    read = reader.inputFiles()
    used = {path for _, path in own if any(path.split(":", 1)[-1].lstrip("/") in file for file in read)}
    gone = [t for t in own if t[1] not in used]
    _TABLES[:] = [t for t in _TABLES if t not in gone]
    _drop(gone)
    return sorted(used)


#: A partition may hold so many times its core's share of the rows before a table is dealt out anew.
MAX_SHARE = 1.5


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input out anew where its partitions would leave cores idle.

    That is so with fewer partitions than cores, and with files of few row groups: a file is
    cut by size, but a whole row group goes to one of the cuts and the others are empty. Rows
    per partition come from the files' footers. Other inputs pass through without a shuffle.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts >= cores:
        counts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
        held = counts.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
        if not held["total"] or held["most"] * cores <= MAX_SHARE * held["total"]:
            return df
    return df.repartition(max(cores, parts))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for models whose factories live in it."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="run-"), "trialweave")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "trialweave"))
    _SHIPPED.add(spark.sparkContext.applicationId)
