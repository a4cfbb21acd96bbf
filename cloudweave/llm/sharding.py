"""Sharding by proportional stratified interleaving (DataFrame functions only).

Every stratum (source) is shuffled by a seeded hash and ranked; a row's fractional rank
(2r+1)/(2n) says how far through its stratum it lies. Sorting all rows by fractional rank
interleaves the strata in proportion, so any contiguous cut has the mixture of the whole.

No window ever sees a whole stratum: ranks are a prefix sum over hash ranges of about
``block_rows`` rows plus a row number inside the range, and likewise for the global order.

Defined cases: a null text has no bytes and the checksum of nothing; a null stratum is a stratum of
its own; a null id hashes as the empty text; repeated rows are placed one by one; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.llm.common import documents, materialise

SEED = "cloudweave-1"


def _shuffle_key(seed: str):
    """A 60-bit number from md5 of seed and id; the same in any SQL engine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def stratified_shards(
    df: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
    seed: str = SEED,
    block_rows: int = 50_000,
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; shard sizes differ by one row at most."""
    text = F.col(text_col).cast("string").cast("binary")
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(stratum_col).cast("string")), F.lit("n")).alias("_s"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
    ).withColumn("_h", _shuffle_key(seed))
    total = df.count()
    blocks = max(1, -(-total // block_rows))
    # Hash range of a row: the top 32 of its 60 bits, scaled to the number of blocks.
    bucket = F.shiftright(F.shiftright("_h", 28) * F.lit(blocks).cast("long"), 32).cast("int")
    rows = rows.withColumn("_b", bucket)

    by_range = rows.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select(
        F.col("_s"), F.col("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("_s")).alias("_total"),
    )
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "_id", "text_crc32", "size")
    ranked = (
        rows.join(starts, ["_s", "_b"])
        .withColumn("_r", F.col("_start") + F.row_number().over(inside) - 1)
        .withColumn("_f", (2 * F.col("_r") + 1).cast("double") / (2 * F.col("_total")).cast("double"))
        .withColumn("_k", F.least(F.floor(F.col("_f") * blocks), F.lit(blocks - 1)).cast("long"))
        .select("_id", "size", "text_crc32", "_s", "_h", "_f", "_k")
    )
    ranked = materialise(ranked)

    # One row a block of block_rows rows: a prefix sum over a table that small needs one task only.
    offsets = ranked.groupBy("_k").agg(F.count("*").alias("_n")).select(
        F.col("_k"),
        F.coalesce(F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"),
    )
    order = Window.partitionBy("_k").orderBy("_f", "_s", "_h", "_id", "text_crc32", "size")
    placed = ranked.join(offsets, "_k").withColumn("_p", F.col("_at") + F.row_number().over(order) - 1)
    placed = placed.withColumn("shard", F.expr(f"int(_p * {n_shards}L div {max(total, 1)}L)"))
    return placed.select(
        F.col("_id").alias("doc_id"), "size", "text_crc32", "shard",
        F.expr(f"_p - (shard * {total}L + {n_shards - 1}L) div {n_shards}L").alias("slot"),
    )


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP10_SQL = f"""
WITH {{crc}}, ranked AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, text_crc32, h, s,
         row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS r, count(*) OVER (PARTITION BY s) AS n
  FROM (SELECT d.doc_id, d.text, c.crc AS text_crc32, coalesce('s' || d.source, 'n') AS s,
               ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 15))::BIGINT AS h
        FROM documents d JOIN text_crc c ON c.doc_id = d.doc_id)
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, s, h, doc_id) - 1 AS p, count(*) OVER () AS total
  FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p * 24 // total)::INT AS shard,
       (p - ((p * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""
