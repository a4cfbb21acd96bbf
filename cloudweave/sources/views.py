"""The driver's tables seen as point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, x, y, z, label from the first three numbers of each embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    xyz = [F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("pid"), *xyz, "label")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer points (quantity, discount, tax in hundredths); many rows share a point and none has a key."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.col("l_quantity").cast("long").alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y"),
        F.round(F.col("l_tax") * 100).cast("long").alias("z"),
    )


#: The same views in SQL.
CLOUD_SQL = "pc AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"
LATTICE_SQL = "lat AS (SELECT l_quantity::BIGINT AS x, round(l_discount * 100)::BIGINT AS y, round(l_tax * 100)::BIGINT AS z FROM lineitem)"
