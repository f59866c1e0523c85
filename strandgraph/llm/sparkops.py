"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is set only in a local session that has none (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not set_dir and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="strandgraph-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: its lineage ends, lost executors lose nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold few rows: texts are long, and each task keeps a batch outside the heap.

    This is a setting of the session; it is only ever lowered, and stays so.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
