"""Intermediate results in the folder that the driver and all executors share, and rows dealt to as many tasks as the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder (spark.checkpoint.dir) and cut from its lineage. Only a local session makes a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys, in as many tasks as the session has shuffle partitions, however small they are.

    Left to itself, Spark merges partitions by their compressed size. Rows of a log repeat themselves and take some 20 bytes
    there, and 50 times that in a task that sorts them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
