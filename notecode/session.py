"""Session settings, reliable checkpoints and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Session settings the operators are written for.

    Joins are left to adaptive execution: it measures each side, broadcasts one only if it is small,
    and splits oversized partitions of a hot key, also where that costs one more shuffle.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",  # very long texts make small batches
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder of its own: on a
    cluster a machine-local folder would be lost together with its executor.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="notecode-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


# Spark's setting to remove the shuffle files of a job at its end
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Jobs whose shuffle files go when they end: what they stored is read from the shared folder only."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the reliable checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    with _freed(df.sparkSession):
        return df.select("*").checkpoint()  # a frame takes the setting when it is made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the checkpoint folder, for tables handed from one step to the next."""
    return f"{checkpoint_folder(spark)}/notecode-{uuid.uuid4().hex}/{name}"


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Unlike a checkpoint the table keeps its size statistics, so later joins can still be planned
    from them, and it is column-pruned when read again.
    """
    path = scratch_path(df.sparkSession, name)
    with _freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
