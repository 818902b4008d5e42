"""The text tables as the operators of this subpackage read them: repeated deliveries once, records with one key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.sources.tables import spread, table


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """doc_id and the columns of documents, rows that are wholly equal once."""
    return table(spark, folder, "documents").select("doc_id", *columns)


def units(spark: SparkSession, folder: str) -> DataFrame:
    """annotation_index, units delivered twice once (they are equal but for loaded_at, so the first hash serves)."""
    rows = table(spark, folder, "annotation_index").select("doc_id", "unit_id", "unit_role", "source_text", "target_text")
    return spread(rows, "doc_id", "unit_id").dropDuplicates(["doc_id", "unit_id"])


def by_batch(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over the Arrow batches of ``frame``, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield from [made] if isinstance(made, pa.RecordBatch) else made.to_batches() if isinstance(made, pa.Table) else made

    return frame.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``most`` bytes of a text column, so that arrays made of them stay small; a longer
    text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def two_hashes(*columns) -> list:
    """128 bits of the columns as two longs."""
    return [F.xxhash64(*columns), F.xxhash64(*columns, F.lit(1))]
