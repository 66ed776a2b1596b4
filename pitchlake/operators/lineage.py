"""Cutting of lineage by files that every executor can read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a part of a shuffle as the optimizer estimates them, from compressed files; what joins multiply can be far too much.
PART_BYTES, MOST_PARTS = 4 << 20, 4096


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the folder that its context was given. Only a session on one machine that has none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp("checkpoint")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def more_parts(df: DataFrame) -> list[int]:
    """How many parts a shuffle of the rows should have, by the optimizer's estimate of their bytes; nothing where those that it has are enough."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(size // PART_BYTES + 1, MOST_PARTS)
    return [n] if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def written(df: DataFrame) -> DataFrame:
    """The rows, from the checkpoint folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)
