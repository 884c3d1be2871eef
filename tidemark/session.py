"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Times in the logs are instants; every derived clock value is rendered in UTC.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# What a task reads is bounded, so its sorts and hash tables are too: the number of tasks grows with the input, not their size.
TASK_CONF = {
    "spark.sql.files.maxPartitionBytes": "16m",  # a packed column file holds millions of rows in 128 MB
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "800",  # small ones are put together again
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of a query, when it ends


def prepare(spark: SparkSession, conf: dict[str, str] = RUNTIME_CONF) -> SparkSession:
    """Apply the runtime settings every job relies on to an existing session."""
    for key, value in conf.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "tidemark", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")  # tiny data, CPU-bound
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    context.setCheckpointDir(folder)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What a query that starts in here has shuffled is deleted when it ends, not when the driver's memory happens to be cleared."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(table: DataFrame, label: str) -> DataFrame:
    """Write a table that later steps read more than once to the shared folder and read it back.

    The lineage ends at the files, so neither a lost executor nor a second use recomputes what is above,
    and the optimizer knows the real size of what it reads. What was shuffled to make it is deleted when it is written.
    """
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        table.write.option("compression", "zstd").parquet(path)
    for made in _on_the_way:
        made.append(path)
    return spark.read.schema(table.schema).parquet(path)


_on_the_way: list[list[str]] = []  # folders staged since each `stage_result` that has not ended


def stage_result(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """`stage` of the table that `make` returns; the tables staged while it was made are then deleted.

    For results that are all that is read of what leads to them. If it fails, nothing is deleted.
    """
    made: list[str] = []
    _on_the_way.append(made)
    try:
        result = make()
    finally:
        _on_the_way.pop()
    result = stage(result, label)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in map(hadoop.Path, made):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return result


def spread(table: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer partitions than cores over all cores.

    For CPU-bound work on a few small files; an input that already fills the cluster is left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def spread_by(table: DataFrame, column: str) -> DataFrame:
    """Deal the rows over all cores by a column, in four partitions for each of the input, so that none is large.

    What is then grouped by that column and others needs no further shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, 4 * table.rdd.getNumPartitions()), column)
