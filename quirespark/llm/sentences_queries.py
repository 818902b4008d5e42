"""Problem 2 over DataFrames."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.records import by_batch, units
from quirespark.llm.sentences import MaxEnt, counted, fitted, sentences

SIDES = ("source", "target")


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = counted(batch.column(0).to_pylist())
    columns = ([f for f, _ in found], pa.string()), ([sure for _, sure in found], pa.int32()), (list(found.values()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in columns], names=["found", "sure", "n"])


def sentence_model(frame: DataFrame) -> MaxEnt:
    """The boundary model, fitted on the reliable marks of all distinct texts of both sides.

    Equal examples are counted where they stand; the driver gets each one once, so many as the words before marks make.
    """
    texts = frame.select(F.explode(F.array("source_text", "target_text")).alias("text")).where(F.length("text") > 0).distinct()
    rows = by_batch(texts, _counted, "found string, sure int, n long").groupBy("found", "sure").agg(F.sum("n").alias("n")).collect()
    return fitted(Counter({(r.found, r.sure): r.n for r in rows}))


def sentence_units(frame: DataFrame, model: MaxEnt) -> DataFrame:
    """doc_id, unit_id, side, sent_start, sent_end of every sentence of both sides of each unit.

    Null and blank texts give no row; a text without any closing mark is one sentence. Offsets are code points of the
    given text. Repeated rows give repeated sentences; ``units`` takes them out before.
    """
    weights = model.weights

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = MaxEnt(weights)
        found: list[list] = [[], [], [], [], []]
        docs, ids, *texts = (batch.column(i).to_pylist() for i in range(4))
        for side, column in zip(SIDES, texts, strict=True):
            for doc, unit, text in zip(docs, ids, column, strict=True):
                for start, end in sentences(text, own):
                    for out, value in zip(found, (doc, unit, side, start, end), strict=True):
                        out.append(value)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=["doc_id", "unit_id", "side", "sent_start", "sent_end"])

    return by_batch(frame.select("doc_id", "unit_id", "source_text", "target_text"), work, "doc_id string, unit_id string, side string, sent_start long, sent_end long")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    frame = units(spark, folder)
    return sentence_units(frame, sentence_model(frame))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
