"""Problem 8: long stretches that stand verbatim in more than one document.

Every stretch of ``LEAST`` characters (a window) gets the least hash of its grams as its fingerprint, which depends on the
window's content alone: equal windows meet under equal fingerprints. Windows in a row with one fingerprint form a snippet;
those whose fingerprint only one document has are dropped, the others are gathered by fingerprint into shards of bounded
size. A compressed FM-index is built over each shard and every snippet is streamed through it by backward search, which
gives its matching statistics: for every place of a snippet, whether its window also stands in a snippet of another document.
A snippet that many documents hold alike stands in the index for two of them and is streamed once; its intervals hold for
all. A fingerprint with too many different snippets is split by the fingerprint of longer grams, in the end by that of the
window itself, so no shard grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm.fmindex import FMIndex
from quirespark.llm.lookalike import code_points
from quirespark.llm.records import by_batch, slices
from quirespark.sources.tables import cut, table

LEAST = 200
#: Characters of the grams of each level; of the last one a gram is the window. A longer gram is shared by fewer windows.
GRAMS = (96, 152, LEAST)
#: A snippet holds at most so many windows, a shard about so many characters, a fingerprint in a shard so many snippets.
WIDEST, SHARD, HOT = 256, 1_200_000, 2_000
BASE, OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
RUNS = "doc_id long, t long, print long, first int, last int, s1 long, s2 long"
NAMES = [c.split()[0] for c in RUNS.split(", ")]
SNIPPET = ["print", "s1", "s2"]


@lru_cache(maxsize=8)
def _power_table(size: int, base: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    filled = 1
    while filled < size:
        m = min(filled, size - filled)
        out[filled : filled + m] = out[:m] * np.uint64(pow(base, filled, 2**64))
        filled += m
    return out


def _powers(n: int, base: int) -> np.ndarray:
    return _power_table(1 << max(18, (n - 1).bit_length()), base)[:n]


class Hashes:
    """Hashes of any stretches of ``points``, which depend on the stretch's characters and length alone."""

    def __init__(self, points: np.ndarray, base: int = BASE) -> None:
        self.up, self.down = _powers(len(points) + 1, base), _powers(len(points) + 1, pow(base, -1, 2**64))
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[b] - self.sums[a]) * self.down[a]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return self.of(slice(0, n), slice(size, size + n))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def fingerprint_runs(points: np.ndarray, offsets: np.ndarray, gram: int, asked: np.ndarray | None = None) -> list[np.ndarray]:
    """Row, fingerprint, first and last window and two hashes of each run of windows with one fingerprint; texts stand one
    after the other. ``asked``: which places begin a window that counts."""
    none = [np.zeros(0, np.int64)] * 6
    if len(points) < LEAST:
        return none
    one = Hashes(points)
    least = sliding_least(one.grams(gram), LEAST - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    own = np.arange(len(least)) + LEAST <= offsets[row + 1]
    if asked is not None:
        own &= asked[: len(least)]
    starts = np.flatnonzero(own)
    if not len(starts):
        return none
    row, least = row[starts], least[starts]
    place = starts - offsets[row]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0))
    fresh |= (np.arange(len(starts)) - begin) % WIDEST == 0  # equal windows stay within equal fingerprints
    at = np.flatnonzero(fresh)
    end = np.append(at[1:], len(starts)) - 1
    two = Hashes(points, OTHER)
    sums = [h.of(starts[at], starts[end] + LEAST).view(np.int64) for h in (one, two)]
    return [row[at], least[at].view(np.int64), place[at], place[end], *sums]


def runs_of(documents: DataFrame, level: int, within: bool = False) -> DataFrame:
    """``RUNS`` of each text (doc_id, t, text); ``within``: only of windows in its ``runs`` (array of first, last)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 2, 1_000_000):
            points, offsets = code_points(part.column(2))
            asked = None
            if within:
                lists = part.column(3)
                held = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy()))
                first, last = (lists.flatten().field(k).to_numpy() + held for k in (0, 1))
                steps = np.zeros(len(points) + 1, np.int64)
                np.add.at(steps, first, 1)
                np.add.at(steps, last + 1, -1)
                asked = np.cumsum(steps)[:-1] > 0
            row, *found = fingerprint_runs(points, offsets, GRAMS[level], asked)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = [part.column(k).to_numpy(zero_copy_only=False)[row] for k in (0, 1)] + found
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    return by_batch(documents.select("doc_id", "t", "text", *(["runs"] if within else [])), work, RUNS)


def _islands(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of numbers one after the other."""
    gap = np.flatnonzero(np.diff(places) > 1) + 1
    return places[np.append(0, gap)], places[np.append(gap, len(places)) - 1]


def _search_shard(group: pa.Table) -> pa.Table:
    """Intervals of every asked snippet of a shard that stand in a snippet of another document, too."""
    points, offsets = code_points(group.column("snippet").combine_chunks())
    parts = [points[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    asked = group.column("asked").to_numpy()
    index = FMIndex(parts, group.column("owner").to_numpy())
    name, place = index.shared(np.flatnonzero(asked), LEAST)
    order = np.lexsort((place, name))
    name, place = name[order], place[order]
    rows, first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = np.flatnonzero(np.diff(name)) + 1
    for own, at in zip(np.split(name, cuts), np.split(place, cuts), strict=True) if len(name) else ():
        a, b = _islands(at)
        rows.append(np.full(len(a), own[0]))
        first.append(a)
        last.append(b + LEAST)
    row = np.concatenate(rows)
    keys = {c: pa.array(group.column(c).to_numpy()[row], pa.int64()) for c in SNIPPET}
    return pa.table({**keys, "a": pa.array(np.concatenate(first), pa.int64()), "b": pa.array(np.concatenate(last), pa.int64())})


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of one key that overlap or touch as one."""
    order = Window.partitionBy(*keys).orderBy("span_start", "span_end")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("span_start") <= reach, 0).otherwise(1)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return spans.withColumn("fresh", fresh).withColumn("island", island).groupBy(*keys, "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("island")


def _shared(runs: DataFrame) -> DataFrame:
    """The runs whose fingerprint two documents have. The count combines before the shuffle, so a fingerprint of very many
    documents is no hot group there; the join with it is left to adaptive planning, which splits skewed keys."""
    prints = runs.groupBy("print").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").select("print")
    return cut(runs.join(prints, "print", "left_semi").select(*NAMES))


def snippet_runs(texts: DataFrame) -> DataFrame:
    """All runs with a fingerprint of two documents or more, those of fingerprints with more than ``HOT`` different snippets
    replaced by the runs of the next level. At the last level a fingerprint has one snippet."""
    done: DataFrame | None = None
    runs = _shared(runs_of(texts, 0))
    for level in range(len(GRAMS)):
        crowded = runs.select(*SNIPPET).distinct().groupBy("print").count().where(F.col("count") > HOT).select("print")
        crowded = cut(crowded) if level + 1 < len(GRAMS) else None
        if crowded is None or crowded.isEmpty():
            return runs if done is None else done.unionByName(runs)
        usual = runs.join(crowded, "print", "left_anti")
        done = usual if done is None else done.unionByName(usual)
        again = runs.join(crowded, "print", "left_semi").groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))
        runs = _shared(runs_of(texts.join(again, ["doc_id", "t"]), level + 1, within=True))
    return done


def shared_spans(documents: DataFrame) -> DataFrame:
    """doc_id, span_start, span_end of the maximal runs of characters that lie in stretches of ``LEAST`` or more characters
    which another document holds verbatim.

    Null, empty and short texts give no row; a repetition within one document doesn't count; repeated rows count once. Of a
    document delivered with several texts each text's spans come out, never merged with one another's.
    """
    spark = documents.sparkSession
    texts = documents.where(F.length("text") >= LEAST).select("doc_id", F.xxhash64("text").alias("t"), "text")
    runs = snippet_runs(texts)
    different = cut(runs.groupBy(*SNIPPET).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(F.struct("doc_id", "t", "first", "last")).alias("at")))
    total = different.agg(F.sum(F.col("at.last") - F.col("at.first") + LEAST)).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-total // SHARD))

    wanted = different.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.t").alias("t")).agg(F.collect_list(F.struct(*SNIPPET, "least", "most", "at")).alias("runs"))
    each = texts.join(wanted, ["doc_id", "t"]).select("doc_id", "t", "text", F.explode("runs").alias("r")).dropDuplicates(["doc_id", "t", "r"])
    snippet = F.expr(f"substring(text, r.at.first + 1, r.at.last - r.at.first + {LEAST})")
    owners = F.array_distinct(F.array("r.least", "r.most"))
    indexed = each.select(*[F.col(f"r.{c}").alias(c) for c in SNIPPET], snippet.alias("snippet"), F.posexplode(owners).alias("k", "owner")).withColumn("asked", F.col("k") == 0).drop("k")
    gathered = indexed.withColumn("shard", F.pmod("print", F.lit(shards))).repartition(int(shards), "shard")
    found = gathered.groupBy("shard").applyInArrow(_search_shard, "print long, s1 long, s2 long, a long, b long")
    spans = runs.join(found, SNIPPET).select("doc_id", "t", (F.col("first") + F.col("a")).alias("span_start"), (F.col("first") + F.col("b")).alias("span_end"))
    return merged(spans, ["doc_id", "t"]).drop("t").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "documents"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shared_chars, share of each document with a text: how much of it stands elsewhere, too (share null if empty)."""
    sizes = table(spark, folder, "documents").where("text is not null").groupBy("doc_id").agg(F.max(F.length("text")).cast("long").alias("size"))
    held = p8_found(spark, folder).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    joined = sizes.join(held, "doc_id", "left").select("doc_id", "size", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
    return joined.select("doc_id", "shared_chars", F.when(F.col("size") > 0, F.col("shared_chars") / F.col("size")).alias("share"))


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
