"""Problem 7 over DataFrames."""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.leaks import Items, plain_texts
from quirespark.llm.records import by_batch
from quirespark.sources.tables import cut, table

#: Items of one automaton; of more items, blocks of so many are held against all documents one after the other.
BLOCK = 20_000


@lru_cache(maxsize=2)
def _items(rows: tuple) -> Items:
    return Items(rows)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, span_start, span_end of the longest passage of each item in each document that holds one.

    Null and empty texts hold nothing; documents delivered twice give equal rows. Items come to the driver in blocks of
    ``BLOCK`` by hash, one at a time: each of several blocks is held against all documents and its result written before the
    next is read. No document leaves its task.
    """
    own = items.select("item_id", "lang", "text").where("text is not null").distinct()
    number = -(-own.count() // BLOCK)

    def scan(block: tuple) -> DataFrame:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = _items(block)
            out: list[list[int]] = [[], [], [], []]
            for doc, (text, place) in zip(batch.column(0).to_pylist(), plain_texts(batch.column(1)), strict=True):
                for item, start, end in held.passages(text, place):
                    for column, value in zip(out, (doc, item, start, end), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "item_id", "span_start", "span_end"])

        return by_batch(documents.select("doc_id", "text").where("text is not null"), work, "doc_id long, item_id long, span_start long, span_end long")

    if number <= 1:
        return scan(tuple(sorted((r.item_id, r.lang, r.text) for r in own.collect())))
    found = []
    for k in range(number):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k)
        found.append(cut(scan(tuple(sorted((r.item_id, r.lang, r.text) for r in part.collect())))))
    return reduce(DataFrame.unionByName, found)


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where in each leaking document the longest passage of each item stands."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_spans(spark, folder).select("doc_id", "item_id").distinct()


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans}
SQL: dict[str, str] = {}
