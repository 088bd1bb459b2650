"""Session building and lineage cutting."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gaugewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GAUGEWELL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``), a private one for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gaugewell-shared-")
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint, so a lost executor never repeats an iterative plan.

    The folder comes from ``spark.checkpoint.dir``.  Only a local master with
    the setting absent gets a private temporary folder (tests); on a cluster
    the missing setting is an error, since a machine-local folder would not
    survive there.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keeps a narrow input in memory (spilling to disk) while a loop reads it.

    Blocks lost with an executor are recomputed from the lineage.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


#: Rows of a task whose Python work is long for each row.
ROWS_PER_TASK = 250_000


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """At least one partition per core before Python-heavy work, if wanted none far over ``rows_per_task`` rows.

    A large table already has them and is left alone; only an input of few or
    too large splits (counted without reading a column) is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    have, largest, rows = sizes.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if have >= cores and (rows_per_task is None or largest <= 2 * rows_per_task):
        return df
    return df.repartition(max(cores, math.ceil((rows or 0) / rows_per_task) if rows_per_task else 0))


def gathered(df: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """At most one partition per core or ``rows_per_task`` rows, for loops whose tasks each answer with a table of their own.

    A narrow table that comes from wide rows has far more partitions than its
    size needs.  None is shuffled, and fewer partitions are left alone.
    """
    most = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows_per_task))
    return df.coalesce(most)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
