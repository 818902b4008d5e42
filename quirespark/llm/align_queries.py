"""Problem 5 over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.align import Concepts, choose, concept_pairs, spans
from quirespark.llm.pairs import LINES, defect
from quirespark.llm.pairs_queries import finals_model
from quirespark.llm.records import by_batch, units
from quirespark.llm.sentences import MaxEnt, sentences
from quirespark.llm.sentences_queries import sentence_model
from quirespark.sources.tables import cut

LEAST, GAIN = 0.15, 0.02
#: Units whose vectors are in a worker's memory at a time.
STEP = 256
#: Defects whose answers are no renderings.
NO_RENDERING = ("empty", "refusal", "copy", "wrong_language")
SPANS = (
    "doc_id string, unit_id string, source_starts array<bigint>, target_starts array<bigint>, "
    "source array<struct<first:int,wide:int,entries:array<struct<concept:int,weight:float>>>>, target array<struct<first:int,wide:int,weights:map<int,float>>>"
)


class Models:
    """What alignment is fitted on: boundaries and finals are counted over all units; at most ``sample`` units, those of the
    least hashes, are looked at for at most ``concepts`` shared ones of one or two sentences. Every unit is aligned."""

    def __init__(self, frame: DataFrame, sample: int = 4096, concepts: int = 1024) -> None:
        # the models of p2_found and p3_found, so that sentences and defects are theirs
        self.boundaries = sentence_model(frame)
        self.finals = finals_model(frame)
        paired = frame.where("target_text is not null and source_text is not null").select("unit_role", "source_text", "target_text").distinct()
        rows = [(r.unit_role or "", r.source_text, r.target_text) for r in paired.orderBy(F.xxhash64("source_text", "target_text"), "unit_role").limit(sample).collect()]
        chosen = []
        for role, source, target in rows:
            if len(chosen) < concepts and role not in LINES and defect(source, target, role, self.finals) is None:
                if 1 <= len(sentences(source, self.boundaries)) <= 2 and 1 <= len(sentences(target, self.boundaries)) <= 3:
                    chosen.append((source, target))
        self.concepts = Concepts(concept_pairs(chosen))


def span_vectors(frame: DataFrame, models: Models) -> DataFrame:
    """One row a unit with a rendering: where the sentences of both sides start, and the sparse concept vectors of windows
    of one and two of them. A unit of one sentence on both sides needs no vectors."""
    boundaries, finals, concepts = models.boundaries.weights, models.finals, models.concepts

    def windows(texts: list[str], side: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        parts = [concepts.parts(t, side) for t in texts]
        for first, wide in spans(len(parts)):
            own = parts[first] if wide == 1 else (parts[first][0] + parts[first + 1][0], parts[first][1] + parts[first + 1][1])
            yield (first, wide, *concepts.vector(*own))

    def nested(units: list[list[tuple]], as_map: bool) -> pa.ListArray:
        """Windows of units as one nested array, made of flat ones."""
        each = [w for own in units for w in own]
        offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        ids, weights = (pa.array(np.concatenate([w[k] for w in each]) if each else [], t) for k, t in ((2, pa.int32()), (3, pa.float32())))
        ends = offsets([len(w[2]) for w in each])
        inner = pa.MapArray.from_arrays(ends, ids, weights) if as_map else pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([ids, weights], names=["concept", "weight"]))
        rows = pa.StructArray.from_arrays([pa.array([w[0] for w in each], pa.int32()), pa.array([w[1] for w in each], pa.int32()), inner], names=["first", "wide", "weights" if as_map else "entries"])
        return pa.ListArray.from_arrays(offsets([len(own) for own in units]), rows)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = MaxEnt(boundaries)
        for part in (batch.slice(k, STEP) for k in range(0, batch.num_rows, STEP)):  # vectors are far larger than texts
            out: list[list] = [[] for _ in range(6)]
            for doc, name, role, *texts in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if not texts[0] or defect(*texts, role or "", finals) in NO_RENDERING:
                    continue
                cuts = [sentences(t, model) for t in texts]
                alone = len(cuts[0]) == len(cuts[1]) == 1
                vectors = ([] if alone else list(windows([t[a:b] for a, b in own], side)) for t, own, side in zip(texts, cuts, ("source", "target"), strict=True))
                for column, value in zip(out, (doc, name, *([a for a, _ in own] for own in cuts), *vectors), strict=True):
                    column.append(value)
            arrays = [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64())), nested(out[4], False), nested(out[5], True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "unit_id", "source_starts", "target_starts", "source", "target"])

    return by_batch(frame.select("doc_id", "unit_id", "unit_role", "source_text", "target_text"), work, SPANS)


#: The cosine of each two windows of a unit, at most one of them of two sentences, as one array in the unit's row.
COSINES = """
select doc_id, unit_id, source_starts, target_starts, flatten(transform(source, s -> transform(filter(target, t -> s.wide + t.wide <= 3), t -> named_struct(
  'si', s.first, 'sn', s.wide, 'ti', t.first, 'tn', t.wide, 'likeness', aggregate(s.entries, 0D, (sum, e) -> sum + e.weight * coalesce(element_at(t.weights, e.concept), 0)))))) as cells
from {vectors}
"""


def aligned(frame: DataFrame, models: Models) -> DataFrame:
    """doc_id, unit_id, source_start, target_start of the sentences that render each other.

    Units without a Chinese rendering and sentences without a partner give no row. A unit of one sentence on both sides is
    no question of likeness: the two are paired as they are. Omitted, added, moved, merged and split sentences are allowed.
    All windows of a unit stand in its row, so nothing is shuffled. A unit given twice gives its pairs twice.
    """
    cosines = frame.sparkSession.sql(COSINES, vectors=span_vectors(frame, models))

    def select(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for doc, unit, left, right, cells in zip(*(batch.column(i) for i in range(5)), strict=True):
            left, right = left.as_py(), right.as_py()
            if len(left) == len(right) == 1:
                pairs = {(0, 0)}
            else:
                tables: dict[tuple[int, int], dict[tuple[int, int], float]] = {(1, 1): {}, (2, 1): {}, (1, 2): {}}
                si, sn, ti, tn, likeness = (x.to_pylist() for x in cells.values.flatten())
                for i, n, j, m, v in zip(si, sn, ti, tn, likeness, strict=True):
                    if v > 0:
                        tables[n, m][i, j] = v
                pairs = choose(tables[1, 1], tables[2, 1], tables[1, 2], LEAST, GAIN)
            for i, j in sorted(pairs):
                for column, value in zip(out, (doc.as_py(), unit.as_py(), left[i], right[j]), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "unit_id", "source_start", "target_start"])

    return by_batch(cosines, select, "doc_id string, unit_id string, source_start long, target_start long")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    frame = cut(units(spark, folder))  # read by each model and by the alignment
    return aligned(frame, Models(frame))


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
