"""A corpus pipeline: language ID, near-duplicate removal, masking of personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again
as the next stage's documents. The input's partitions are scanned as they are; no stage gathers documents anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm import langid, packing, pii, simhash
from cloudweave.llm.common import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages learned from ``lang``: null and empty texts, texts without a letter, and long ones
    whose vector is no nearer to any language than chance. A null ``lang`` gets the prediction; all else stays as it is, repeated
    rows and null ids too. An empty table gives no rows."""
    return langid.keep_known(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every group of near duplicates (five-word shingles, similarity 0.8 or more), and rows without a doc_id.

    Null and empty texts are one group; of repeated rows one stays; rows that repeat an id with another text are judged by their texts;
    texts of any length are compared whole. An empty table gives no rows."""
    return simhash.keep_near_duplicates_once(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span of personal data, secrets among them; n_chars follows the text. A null text becomes an empty one; repeated
    rows are masked alike. An empty table gives no rows."""
    found = pii.find(docs, carry=("lang", "source"))
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens, one row a piece with its ids. A null or empty text is one end token;
    repeated rows are packed each; texts of any length are cut. An empty table gives no rows."""
    return packing.pack(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack_sequences),
]

#: Models and fingerprints are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written to the shared folder and read
    again by the next, after which they are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
