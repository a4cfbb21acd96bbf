"""The queries and reference SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloudweave.llm.ann import op7_ann
from cloudweave.llm.classlm import op5_classlm
from cloudweave.llm.common import CRC_SQL
from cloudweave.llm.langid import op4_langid
from cloudweave.llm.licenses import op2_licenses
from cloudweave.llm.nbest import op8_nbest
from cloudweave.llm.packing import op3_packing
from cloudweave.llm.pii import op6_pii
from cloudweave.llm.sharding import OP10_SQL, op10_stratified_shards
from cloudweave.llm.simhash import op1_simhash
from cloudweave.llm.telephony import op9_telephony


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_licenses": op2_licenses,
        "op3_packing": op3_packing,
        "op4_langid": op4_langid,
        "op5_classlm": op5_classlm,
        "op6_pii": op6_pii,
        "op7_ann": op7_ann,
        "op8_nbest": op8_nbest,
        "op9_telephony": op9_telephony,
        "op10_stratified_shards": op10_stratified_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_stratified_shards": OP10_SQL.format(crc=CRC_SQL),
    }
