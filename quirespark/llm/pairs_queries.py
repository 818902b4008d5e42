"""Problem 3 over DataFrames."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.pairs import LEAST_BEFORE, Finals, defect
from quirespark.llm.records import by_batch, slices, units


CLOSING_MARKS = np.asarray([ord(c) for c in "。！？"])
#: Bytes of text that are counted at a time.
PART = 4_000_000


@lru_cache(maxsize=1)
def _digits_alike() -> np.ndarray:
    """Every code point, decimal digits all as 0."""
    codes = np.arange(sys.maxunicode + 1)
    codes[[m.start() for m in re.finditer(r"\d", "".join(map(chr, range(len(codes)))))]] = ord("0")
    return codes


def _pairs_counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """key (two characters, digits alike), before, anywhere: what ``Finals.fit`` counts, over the texts of one batch."""
    texts = batch.column(0).to_pylist()
    chars = _digits_alike()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    # two neighbours are a pair unless the second opens a text; a mark counts behind a pair of its own text
    ends = np.cumsum([len(t) for t in texts])
    inner = np.ones(len(chars) + 1, bool)
    inner[[0, *ends[:-1]]] = False
    at = np.flatnonzero(inner[1:-1]) + 1
    keys = chars[at - 1] << 21 | chars[at]
    marked = np.append(np.isin(chars, CLOSING_MARKS) & inner[:-1], False)[at + 1]
    found, where = np.unique(keys, return_inverse=True)
    names = [chr(k >> 21) + chr(k & 0x1FFFFF) for k in found.tolist()]
    counts = [np.bincount(where, weights, len(found)).astype(np.int64) for weights in (marked, None)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *map(pa.array, counts)], names=["key", "before", "anywhere"])


def finals_model(frame: DataFrame) -> Finals:
    """What comes before closing marks in all answers that hold a full stop of Chinese, counted where they stand.

    Only pairs that may end a text come to the driver; any other pair decides as if it had never been seen.
    """
    texts = frame.where(F.col("target_text").contains("。")).select("target_text")
    work = lambda batch: map(_pairs_counted, slices(batch, 0, PART))
    counted = by_batch(texts, work, "key string, before long, anywhere long").groupBy("key").agg(F.sum("before").alias("before"), F.sum("anywhere").alias("anywhere"))
    rows = counted.where((F.col("before") > 0) & (F.col("before") >= LEAST_BEFORE * F.col("anywhere"))).collect()
    return Finals({r.key: r.before for r in rows}, {r.key: r.anywhere for r in rows})


def defective_pairs(frame: DataFrame, finals: Finals) -> DataFrame:
    """doc_id, unit_id, defect of each pair (source_text, target_text, unit_role) with a defective answer.

    A null or blank answer is 'empty', whatever the prompt; a null prompt counts as empty. Sound pairs give no row and
    repeated rows are judged as often as they stand.
    """
    before, anywhere = finals.before, finals.anywhere

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Finals(before, anywhere)
        found: list[list[str]] = [[], [], []]
        for doc, unit, role, source, target in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (kind := defect(source, target, role or "", own)) is not None:
                for out, value in zip(found, (doc, unit, kind), strict=True):
                    out.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in found], names=["doc_id", "unit_id", "defect"])

    return by_batch(frame.select("doc_id", "unit_id", "unit_role", "source_text", "target_text"), work, "doc_id string, unit_id string, defect string")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    frame = units(spark, folder)
    return defective_pairs(frame, finals_model(frame))


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
