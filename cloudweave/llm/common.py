"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python. Long texts make larger batches costly.
ARROW_ROWS = 512


def session_for(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches small enough for long texts."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def fold(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null ids: the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; on one machine, as in tests, set a folder of our own where none is set."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "cloudweave-checkpoints"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


#: DuckDB has no crc32: this CTE folds the nibbles of each text through the reflected polynomial 0xEDB88320.
CRC_SQL = """crc_nibble AS (
  SELECT list_transform(range(16), lambda n: list_reduce(range(4),
         lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, n::BIGINT)) AS t
), text_hex AS (SELECT doc_id, string_split(hex(encode(coalesce(text, ''))), '') AS x FROM documents
), text_crc AS (
  SELECT doc_id, CASE WHEN x = [''] OR len(x) = 0 THEN 0::BIGINT ELSE xor(list_reduce(range(len(x)), lambda a, k:
         xor(a >> 4, t[(xor(a, instr('0123456789ABCDEF', x[k + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END]) - 1) & 15) + 1]),
         4294967295::BIGINT), 4294967295::BIGINT) END AS crc
  FROM text_hex, crc_nibble
)"""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder where that is unset."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Intermediate tables in the shared folder: compressed, read column by column, and gone when the block ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)
