"""Column factories for boxes (x0, y0, x1, y1 as longs) and intervals.

A box is given as four columns. Where any is null, predicates are null and so never hold in a filter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", frame: str = "") -> Box:
    """The four columns x0, y0, x1, y1 behind a prefix, of the alias ``frame``."""
    path = f"{frame}." if frame else ""
    return tuple(F.col(f"{path}{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def contains(outer: Box, inner: Box, tolerance: int = 0) -> Column:
    t = F.lit(tolerance)
    return (inner[0] >= outer[0] - t) & (inner[1] >= outer[1] - t) & (inner[2] <= outer[2] + t) & (inner[3] <= outer[3] + t)


def meets(a: Box, b: Box, tolerance: int = 0) -> Column:
    """Whether boxes touch or overlap, give or take ``tolerance``: the closed test of extraction."""
    t = F.lit(tolerance)
    return (a[0] <= b[2] + t) & (b[0] <= a[2] + t) & (a[1] <= b[3] + t) & (b[1] <= a[3] + t)


def overlaps(a: Box, b: Box) -> Column:
    """Whether boxes share an area: the open test of layout checks."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def shared_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The gap between two intervals, 0 where they meet."""
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1))


def area(a: Box) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates that give the smallest box around all of a group."""
    return [F.min(f"{prefix}x0").alias(f"{prefix}x0"), F.min(f"{prefix}y0").alias(f"{prefix}y0"), F.max(f"{prefix}x1").alias(f"{prefix}x1"), F.max(f"{prefix}y1").alias(f"{prefix}y1")]


def mpt(points: Column) -> Column:
    """Points as whole thousandths, halves up."""
    return F.round(points.cast("decimal(38,6)") * 1000, 0).cast("long")


def bottom_left(top: Box, height: Column) -> Box:
    """A box measured from the top edge of a page as one measured from the bottom edge."""
    return top[0], height - top[3], top[2], height - top[1]


def turned(a: Box, rotation: Column, width: Column, height: Column) -> Box:
    """A box of an unturned page of this size, as it is displayed after a turn by 0, 90, 180 or 270 degrees."""
    def by(*forms: Column) -> Column:
        return F.when(rotation == 0, forms[0]).when(rotation == 90, forms[1]).when(rotation == 180, forms[2]).when(rotation == 270, forms[3])

    return (
        by(a[0], a[1], width - a[2], height - a[3]),
        by(a[1], width - a[2], height - a[3], a[0]),
        by(a[2], a[3], width - a[0], height - a[1]),
        by(a[3], width - a[0], height - a[1], a[2]),
    )


def fit_scale(width: Column, height: Column, page_width: int = 595_276, page_height: int = 841_890) -> Column:
    """The scale in millionths that fits a page into another without enlarging it."""
    by_width = F.call_function("div", F.lit(page_width).cast("long") * 1_000_000, width.cast("long"))
    by_height = F.call_function("div", F.lit(page_height).cast("long") * 1_000_000, height.cast("long"))
    return F.least(F.lit(1_000_000).cast("long"), by_width, by_height)


def scaled(size: Column, scale: Column) -> Column:
    """A length under a scale in millionths, halves up."""
    return F.call_function("div", size.cast("long") * scale + 500_000, F.lit(1_000_000).cast("long"))


def lightness(colours: Column) -> Column:
    """The mean of all numeric components of an array of colours (arrays of text); null where there is none."""
    parts = F.filter(F.transform(F.flatten(F.filter(colours, lambda c: c.isNotNull())), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))
