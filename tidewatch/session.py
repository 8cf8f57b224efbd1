"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench. On a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewatch")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_OWN: dict[str, str] = {}  # application id -> folder, where the cluster names none


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A folder of this process's own is taken only where the setting is absent and all tasks run on this
    machine (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidewatch-")
    return _OWN[app]


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting: beyond ``max_rows`` the plan stays a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the configured number of partitions.

    Adaptive execution merges small shuffle outputs by bytes; steps that spend long on few bytes (Python
    kernels, array windows) would end up in one task. A fixed number keeps them apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    Steps that several branches use (file summaries, assigned files, learned occurrences) are computed
    once, survive lost executors, and their size is known to the joins that follow.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
