"""Cutting the lineage of iterative jobs with reliable checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all machines read: ``spark.checkpoint.dir``; a private one only for local sessions without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidelake-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from that copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether the shuffle files of an action go at its end; by default they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go as each ends; what is shuffled for a written table is in the table."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``cut`` for tables of many rows: by columns and compressed, of which later reads take only the columns they use."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/stored/{uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
