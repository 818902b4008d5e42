"""Rows delivered more than once, and records kept by their latest event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(frame: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row of each key, the greatest by ``by`` and then by the other columns, so ties have one result.

    An aggregate rather than a window: it combines before the shuffle, so a key of very many deliveries is no hot group.
    Null order columns come first, that is they lose; null keys are a key of their own.
    """
    rest = [c for c in frame.columns if c not in {*keys, *by}]
    sortable = [c for c in rest if not frame.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    row = F.struct(*by, *sortable)
    best = frame.groupBy(*keys).agg(F.max(row).alias("row_"))
    return best.select(*keys, *[F.col("row_")[c].alias(c) for c in [*by, *sortable]]).select(*[c for c in frame.columns if c in {*keys, *by, *sortable}])
