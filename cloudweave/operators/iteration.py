"""Cutting lineage between rounds of an iteration."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder in spark.checkpoint.dir, which every executor shares.

    On one machine, as in tests, a folder of our own is set where the session names none.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "cloudweave-checkpoints"))
    return df.checkpoint(eager=True)
