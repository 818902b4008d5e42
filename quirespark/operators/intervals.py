"""One-dimensional intervals: unions, gaps, persistence of a gutter, elementary parts, overlaps, clusters.

``keys`` name the group (a page, a unit); all windows are within one group. Intervals are [start, end) longs; rows with a
null or non-positive interval are dropped, repeated rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISLAND = "island"


def _positive(frame: DataFrame, start: str, end: str) -> DataFrame:
    return frame.where(F.col(start) < F.col(end))


def with_islands(frame: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``frame`` with the number of the island of touching intervals that each row is part of, from 1."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(end).over(before)
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return _positive(frame, start, end).withColumn("fresh_", fresh).withColumn(ISLAND, F.sum("fresh_").over(through)).drop("fresh_")


def interval_union(frame: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end of the stable union; intervals that touch are one."""
    distinct = _positive(frame, start, end).select(*keys, start, end).distinct()
    return with_islands(distinct, keys, start, end).groupBy(*keys, ISLAND).agg(F.min(start).alias(start), F.max(end).alias(end)).drop(ISLAND)


def gaps(frame: DataFrame, keys: list[str], start: str, end: str, minimum: int = 0) -> DataFrame:
    """keys, gap_start, gap_end of the inner gaps of at least ``minimum`` between islands."""
    order = Window.partitionBy(*keys).orderBy(start)
    islands = interval_union(frame, keys, start, end)
    found = islands.select(*keys, F.col(end).alias("gap_start"), F.lead(start).over(order).alias("gap_end"))
    return found.where(F.col("gap_end") - F.col("gap_start") >= minimum)


def persistence(boxes: DataFrame, gutters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gutter_left, gutter_right, ppm: of the height that boxes occupy, the share that no box across the gutter covers.

    ``gutters``: keys, gutter_left, gutter_right, y_bottom, y_top. Boxes are clipped to the gutter's height.
    """
    own = [*keys, "gutter_left", "gutter_right"]
    clipped = boxes.join(gutters, keys).select(
        *own,
        F.greatest("y_bottom", "y0").alias("low"),
        F.least("y_top", "y1").alias("high"),
        ((F.col("x0") < F.col("gutter_right")) & (F.col("x1") > F.col("gutter_left"))).alias("across"),
    )
    covered = interval_union(clipped, own, "low", "high").groupBy(*own).agg(F.sum(F.col("high") - F.col("low")).alias("occupied"))
    blocked = interval_union(clipped.where("across"), own, "low", "high").groupBy(*own).agg(F.sum(F.col("high") - F.col("low")).alias("blocked"))
    free = F.col("occupied") - F.coalesce("blocked", F.lit(0))
    share = F.greatest(F.lit(0), F.least(F.lit(1_000_000), F.call_function("div", free * 1_000_000, F.col("occupied"))))
    joined = gutters.select(*own).join(covered, own, "left").join(blocked, own, "left")
    return joined.select(*own, F.when(F.coalesce("occupied", F.lit(0)) == 0, F.lit(0)).otherwise(share).cast("long").alias("ppm"))


def overlapping_neighbours(frame: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose successor by (start, end) begins before they end, with ``next_start``; enough to tell whether any two of
    a group overlap."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    return _positive(frame, start, end).withColumn("next_start", F.lead(start).over(order)).where(F.col("next_start") < F.col(end))


def elementary(frame: DataFrame, keys: list[str], start: str, end: str, extra: DataFrame | None = None) -> DataFrame:
    """keys, start, end of the parts between all neighbouring boundaries of a group that some interval covers, and
    ``covers``, by how many. ``extra``: further boundaries (keys, point)."""
    rows = _positive(frame, start, end).select(*keys, start, end)
    points = rows.select(*keys, F.col(start).alias("point")).unionByName(rows.select(*keys, F.col(end).alias("point")))
    if extra is not None:
        points = points.unionByName(extra.select(*keys, "point"))
    # changes at each boundary, summed on the way, instead of a join of parts and intervals
    steps = rows.select(*keys, F.col(start).alias("point"), F.lit(1).alias("d")).unionByName(rows.select(*keys, F.col(end).alias("point"), F.lit(-1).alias("d")))
    change = points.distinct().join(steps.groupBy(*keys, "point").agg(F.sum("d").alias("d")), [*keys, "point"], "left")
    order = Window.partitionBy(*keys).orderBy("point")
    parts = change.select(*keys, F.col("point").alias(start), F.lead("point").over(order).alias(end), F.sum(F.coalesce("d", F.lit(0))).over(order).cast("long").alias("covers"))
    return parts.where(F.col(end).isNotNull() & (F.col("covers") > 0))


def chain_clusters(frame: DataFrame, keys: list[str], value: str, tolerance: int) -> DataFrame:
    """``frame`` with ``cluster``: a new one begins where the next value is more than ``tolerance`` above the last."""
    order = Window.partitionBy(*keys).orderBy(value)
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.when(F.col(value) - F.lag(value).over(order) > tolerance, 1).otherwise(0)
    return frame.where(F.col(value).isNotNull()).withColumn("fresh_", fresh).withColumn("cluster", F.sum("fresh_").over(through)).drop("fresh_")


def separated(values: Column, least: int) -> Column:
    """Of a sorted array, greedily those that keep ``least`` from the last one taken."""
    return F.aggregate(
        values,
        F.array().cast("array<long>"),
        lambda taken, v: F.when((F.size(taken) == 0) | (v - F.element_at(taken, -1) >= least), F.concat(taken, F.array(v))).otherwise(taken),
    )


def as_of(points: DataFrame, anchors: DataFrame, keys: list[str], point: str, anchor: str, tolerance: int = 0) -> DataFrame:
    """``points`` with the last anchor not above the point by more than ``tolerance``, or null.

    Anchors and points are merged and swept once in order, so no pair of them is ever formed.
    """
    tagged = points.withColumn("at_", F.col(point) + tolerance).withColumn("mark_", F.lit(None).cast("long")).withColumn("kind_", F.lit(1))
    marks = anchors.select(*keys, F.col(anchor).cast("long").alias("mark_")).distinct().withColumn("at_", F.col("mark_")).withColumn("kind_", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = tagged.unionByName(marks, allowMissingColumns=True).withColumn(anchor, F.last("mark_", ignorenulls=True).over(order))
    return swept.where("kind_ = 1").drop("at_", "mark_", "kind_")


def filled_labels(frame: DataFrame, keys: list[str], order: list[str], label: str, near: str | None = None, limit: int = 0, default: int = 1) -> DataFrame:
    """Unknown labels taken from both known neighbours if they agree above 1, else from the nearer one within ``limit`` of
    ``near``, else ``default``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    back, ahead = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(1, Window.unboundedFollowing)
    left, right = F.last(label, ignorenulls=True).over(back), F.first(label, ignorenulls=True).over(ahead)
    agreed = F.when((left == right) & (left > 1), left)
    if near is not None:
        known = F.when(F.col(label).isNotNull(), F.col(near))
        to_left = F.col(near) - F.last(known, ignorenulls=True).over(back)
        to_right = F.first(known, ignorenulls=True).over(ahead) - F.col(near)
        nearest = F.when(F.coalesce(to_left, F.lit(limit + 1)) <= F.coalesce(to_right, F.lit(limit + 1)), F.when(to_left <= limit, left)).otherwise(F.when(to_right <= limit, right))
        agreed = F.coalesce(agreed, nearest)
    return frame.withColumn(f"{label}_filled", F.coalesce(F.col(label), agreed, F.lit(default)))


def runs(frame: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``frame`` with ``run``: the number of its run of equal labels (nulls are equal) in order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(window)) & (F.row_number().over(window) > 1), 0).otherwise(1)
    return frame.withColumn("changed_", changed).withColumn("run", F.sum("changed_").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("changed_")
