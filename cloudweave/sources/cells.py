"""Occupancy cells on disk: Parquet tables with full values, or with states only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.operators.occupancy import KEYS, Sensor, is_occupied, most_likely


def write_cells(cells: DataFrame, path: str) -> None:
    """Full values, sorted by key inside files so that box queries skip row groups."""
    cells.select(*KEYS, "depth", "log_odds").sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_states(cells: DataFrame, path: str, sensor: Sensor = Sensor()) -> None:
    """States only: 1 occupied, 0 free."""
    cells.select(*KEYS, "depth", is_occupied(sensor).cast("tinyint").alias("state")).sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(path)


def read_states(spark: SparkSession, path: str, sensor: Sensor = Sensor()) -> DataFrame:
    """Cells with the clamping bound of their state."""
    read = spark.read.parquet(path).select(*KEYS, "depth", (F.col("state") - 0.5).alias("log_odds"))
    return most_likely(read, Sensor(sensor.hit, sensor.miss, sensor.low, sensor.high, 0.0))


def write_map(cells: DataFrame, path: str, resolution: float = 0.05) -> None:
    """A map of fixed resolution, which is kept in the table."""
    cells.select(*KEYS, "depth", is_occupied().cast("tinyint").alias("state"), F.lit(resolution).alias("resolution")).write.mode("overwrite").parquet(path)
