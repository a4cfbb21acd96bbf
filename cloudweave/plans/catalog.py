"""All registered queries over the driver's tables and the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudweave.plans import cleaning, clustering, labelling, models, occupancy, peaks, sources  # noqa: F401  (they register their queries)
from cloudweave.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["dbscan"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
