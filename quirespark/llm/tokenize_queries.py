"""Problem 6 over DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quirespark.llm.records import by_batch
from quirespark.llm.tokenize import TOKENIZERS, encoder
from quirespark.sources.tables import table


def token_ids(frame: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids array<int>: the ids of each text, whole and unchanged, without special tokens.

    Names of special tokens inside a text are ordinary text. Null and empty texts give an empty list; repeated rows are
    encoded as often as they stand. Every executor needs the vocabulary file under ``folder``.
    """
    kind = frame.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), encoder(name, folder).encode_batch(batch.column(1))], names=["key", "ids"])

    return by_batch(frame.select(key, text), work, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents").select("doc_id", "text").distinct())


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
