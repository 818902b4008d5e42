"""Selections under a budget: greedy, by prefix, first occurrences, apportionment."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.text import rounded_share


def emphasis(candidates: DataFrame, totals: DataFrame, target: int = 600, cap: int = 1000) -> DataFrame:
    """doc_id, candidate_id of the spans that move a document's highlighted share closest to ``target`` / 10 000.

    ``candidates``: doc_id, candidate_id, importance, unit_order, unit_id, target_start, target_end, size (visible
    characters); ``totals``: doc_id, denominator. Taken in order of importance and place: a span that overlaps a taken one,
    passes ``cap``, or does not bring the share nearer is left out. Each step depends on those before, so a document is one
    ordered fold; candidates with nulls or without visible characters are dropped.
    """
    item = F.struct((-F.col("importance")).alias("less"), "unit_order", "target_start", "target_end", "candidate_id", "unit_id", "size")
    need = ["importance", "unit_order", "target_start", "target_end", "candidate_id", "size"]
    sound = candidates.dropna(subset=need).where("size > 0 and target_start < target_end")
    rows = sound.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(totals.where("denominator > 0"), "doc_id")
    kind = "array<struct<unit_order:bigint,target_start:bigint,target_end:bigint,candidate_id:string>>"
    start = F.struct(F.lit(0).cast("long").alias("taken"), F.from_json(F.lit("[]"), kind).alias("out"))
    away = lambda n: F.abs(n * 10_000 - F.col("denominator") * target)

    def step(state: Column, c: Column) -> Column:
        more = state["taken"] + c["size"]
        clash = F.exists(state["out"], lambda o: (o["unit_order"] == c["unit_order"]) & (o["target_start"] < c["target_end"]) & (c["target_start"] < o["target_end"]))
        take = ~clash & (more * 10_000 <= F.col("denominator") * cap) & (away(more) < away(state["taken"]))
        entry = F.array(F.struct(c["unit_order"].cast("long").alias("unit_order"), c["target_start"].cast("long").alias("target_start"), c["target_end"].cast("long").alias("target_end"), c["candidate_id"].cast("string").alias("candidate_id")))
        return F.struct(F.when(take, more).otherwise(state["taken"]).cast("long").alias("taken"), F.when(take, F.concat(state["out"], entry)).otherwise(state["out"]).alias("out"))

    folded = rows.select("doc_id", "denominator", F.aggregate("items", start, step).alias("s"))
    return folded.select("doc_id", F.explode("s.out").alias("o")).select("doc_id", F.col("o.candidate_id").alias("candidate_id"))


def emphasis_share(taken: DataFrame, candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id, highlighted, basis_points of every document with a total."""
    sums = taken.join(candidates.select("doc_id", "candidate_id", "size"), ["doc_id", "candidate_id"]).groupBy("doc_id").agg(F.sum("size").alias("highlighted"))
    joined = totals.join(sums, "doc_id", "left").withColumn("highlighted", F.coalesce("highlighted", F.lit(0)).cast("long"))
    return joined.select("doc_id", "highlighted", rounded_share(F.col("highlighted"), F.col("denominator")).alias("basis_points"))


def prefix_within(items: DataFrame, keys: list[str], order: list[str | Column], cost: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose costs add up to at most ``budget``, with ``spent``; null costs are 0."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = items.withColumn("spent", F.sum(F.coalesce(F.col(cost), F.lit(0))).over(window).cast("long"))
    return spent.withColumn("worst_", F.max("spent").over(window)).where(F.col("worst_") <= budget).drop("worst_")


def longest_feasible(items: DataFrame, keys: list[str], order: str, cost: Callable[[pd.DataFrame], int], budget: int) -> DataFrame:
    """keys, chosen: how many items in order fit, for any cost that does not fall as items are added.

    All are tried first, then the longest prefix is found by halving, so a group of n items needs about log2 n trials.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(order, kind="stable")
        low, high = 0, len(rows)
        if cost(rows) <= budget:
            low = high
        while low + 1 < high:
            middle = (low + high) // 2
            low, high = (middle, high) if cost(rows.iloc[:middle]) <= budget else (low, middle)
        return rows[keys].head(1).assign(chosen=low)

    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)
    return items.groupBy(*keys).applyInPandas(choose, f"{kinds}, chosen long")


def first_of(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``items`` with ``is_first``: the first of its keys in order, where a label stands."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("is_first", F.row_number().over(window) == 1)


def apportioned(parts: DataFrame, keys: list[str], part: str, weight: str, total: int = 1_000_000) -> DataFrame:
    """keys, part, share: whole shares that add up to exactly ``total``, by the largest remainders (ties: least part).

    Groups whose weights add up to 0 give no row; null and negative weights count as 0.
    """
    own = parts.select(*keys, part, F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("long").alias("w"))
    group = Window.partitionBy(*keys)
    summed = own.withColumn("all_", F.sum("w").over(group)).where("all_ > 0")
    exact = F.col("w") * total
    floored = summed.withColumn("floor_", F.call_function("div", exact, F.col("all_"))).withColumn("rest_", exact % F.col("all_"))
    order = Window.partitionBy(*keys).orderBy(F.desc("rest_"), part)
    left = F.lit(total) - F.sum("floor_").over(group)
    return floored.withColumn("more_", F.when(F.row_number().over(order) <= left, 1).otherwise(0)).select(*keys, part, (F.col("floor_") + F.col("more_")).cast("long").alias("share"))


def overlapping_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the groups in which two spans (span_start, span_end) overlap."""
    window = Window.partitionBy(*keys).orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.where("span_start < span_end").withColumn("reach_", F.max("span_end").over(window)).where("span_start < reach_").select(*keys).distinct()


def promoted(candidates: DataFrame) -> DataFrame:
    """``candidates`` (doc_id, key, kind, figure_id, priority, essential) with ``core`` and ``place``.

    Core are the essential ones, the first note (least key) of every figure, and, where no term of a document is essential, its
    best term. ``place`` orders the others: notes of figures first, then by priority and key. A null ``essential`` counts as
    false.
    """
    figure = F.col("kind") == "figure"
    first_note = F.row_number().over(Window.partitionBy("doc_id", "kind", "figure_id").orderBy("key")) == 1
    terms = Window.partitionBy("doc_id", "kind")
    best_term = F.row_number().over(terms.orderBy(F.desc("priority"), "key")) == 1
    given = F.coalesce("essential", F.lit(False))
    core = given | (figure & first_note) | (~figure & best_term & ~F.max(given).over(terms))
    marked = candidates.withColumn("core", core)
    others = Window.partitionBy("doc_id", "core").orderBy(F.when(figure, 0).otherwise(1), F.desc("priority"), "key")
    return marked.withColumn("place", F.when(~F.col("core"), F.row_number().over(others)).cast("long"))


def items_by_kind(items: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id, items, highlight_basis_points, teaching_basis_points of all items of a document (kind, size) against its total.

    ``totals``: doc_id, denominator. Documents without items have 0 of each.
    """
    part = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("size")).otherwise(0))
    sums = items.groupBy("doc_id").agg(F.count("*").alias("items"), part("highlight").alias("h"), part("teaching", "figure").alias("t"))
    joined = totals.join(sums, "doc_id", "left").fillna(0, ["items", "h", "t"])
    return joined.select("doc_id", "items", rounded_share(F.col("h"), F.col("denominator")).alias("highlight_basis_points"), rounded_share(F.col("t"), F.col("denominator")).alias("teaching_basis_points"))
