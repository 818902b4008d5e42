"""Work on one group at a time that no expression can say, without a pandas frame a group.

The JVM gathers each group's rows into one array; Python takes them from Arrow batches of many groups, so that the cost of
a small group is that of its rows. A group must fit a task, as it must for any grouped function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_group(frame: DataFrame, keys: list[str], columns: list[str], work: Callable[[tuple, list[dict]], Iterable[tuple]], schema: str, most: int = 20_000) -> DataFrame:
    """The rows that ``work`` gives for each group's key and rows (dicts of ``columns``), by ``schema``; about ``most`` rows
    leave Python at a time."""
    arrays = frame.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("rows_"))
    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns_ = list(zip(*made, strict=True)) if made else [() for _ in arrow]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns_, arrow, strict=True)], schema=arrow)
            made.clear()
            return batch

        for batch in batches:
            names = [batch.column(i).to_pylist() for i in range(len(keys))]
            groups = batch.column(len(keys))
            cells = groups.flatten()  # the structs of all groups, one list a column instead of one dict a scalar
            fields = [cells.field(i).to_pylist() for i in range(cells.type.num_fields)]
            known = [f.name for f in cells.type]
            ends = (groups.offsets.to_numpy() - groups.offsets[0].as_py()).tolist()
            for i in range(batch.num_rows):
                part = zip(*(f[ends[i] : ends[i + 1]] for f in fields), strict=True)
                made.extend(work(tuple(n[i] for n in names), [dict(zip(known, row, strict=True)) for row in part]))
                if len(made) >= most:
                    yield flush()
        if made:
            yield flush()

    return arrays.mapInArrow(run, kinds)
