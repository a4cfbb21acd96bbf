"""Ranks over a whole table without a task that sorts all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.operators.iteration import cut


def ranked(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows with a rank counted from 1 in the given order, which has to be total for the ranks to be the same in every run.

    Rows are cut into ranges of the order and ranked inside each; a range starts where the counts of those before it end.
    Only these counts, one row a range, meet in one task.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(before, "_part").withColumn(name, (inside + F.col("_before")).cast("long")).drop("_part", "_before")
