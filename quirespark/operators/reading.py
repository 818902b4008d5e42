"""Reading pages: flows of measured lines set in one or two columns, what a last page reserves, and checks of the result."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.grouped import by_group
from quirespark.operators.layout import STYLES

# Roles that span both columns.
SPANNING = ("title", "abstract", "keywords")
PARTS = "part long, page long, columns long, column long, line_start long, line_end long, top long, height long, pages long"


@dataclass(frozen=True)
class Spacing:
    page_height: int = 841_890
    margin: int = 34_000
    gap: int = 6_000
    keep_with_next: int = 2


def unit_flows(units: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, unit_id, role, column_count, size_mpt, leading_mpt, source_pages, target_length of each unit with a rendering.

    ``units``: doc_id, id, role, fragments; ``targets``: doc_id, unit_id, chinese_text. A role without a style of its own has
    the body's; null fragments give no pages.
    """
    size = F.coalesce(F.create_map(*[F.lit(x) for pair in STYLES.items() for x in pair])[F.col("role")], F.lit(STYLES["body"])).cast("long")
    pages = F.array_sort(F.array_distinct(F.transform("fragments", lambda f: f["page_number"])))
    own = targets.where("chinese_text is not null").select("doc_id", "unit_id", F.length("chinese_text").cast("long").alias("target_length"))
    joined = units.withColumnRenamed("id", "unit_id").join(own, ["doc_id", "unit_id"])
    columns = F.when(F.col("role").isin(*SPANNING), 1).otherwise(2)
    return joined.select("doc_id", "unit_id", "role", columns.cast("long").alias("column_count"), size.alias("size_mpt"), F.call_function("div", size * 140, F.lit(100).cast("long")).alias("leading_mpt"), pages.alias("source_pages"), "target_length")


def page_budget(units: DataFrame) -> DataFrame:
    """doc_id, budget: how many different pages a document's units stand on, 1 at least."""
    each = units.select("doc_id", F.explode_outer("fragments").alias("f"))
    return each.groupBy("doc_id").agg(F.greatest(F.lit(1), F.countDistinct("f.page_number")).cast("long").alias("budget"))


class Setter:
    """Sets flows one after the other; ``reserved``: a page and the height at its foot that stays free."""

    def __init__(self, spacing: Spacing, reserved: tuple[int, int] = (0, 0)) -> None:
        self.s, self.reserved = spacing, reserved
        self.page, self.column, self.columns = 1, 0, 1
        self.top = self.start = self.lowest = spacing.margin

    def foot(self) -> int:
        page, height = self.reserved
        return self.s.margin + (height + self.s.gap if page == self.page else 0)

    def onward(self) -> None:
        if self.columns == 2 and self.column == 0:
            self.column, self.top = 1, self.start
        else:
            self.page, self.column = self.page + 1, 0
            self.top = self.start = self.lowest = self.s.margin

    def spans(self, columns: int, fresh_unit: bool) -> None:
        """A change of columns begins below all that stands on the page; a new unit keeps its gap."""
        changed = columns != self.columns
        if changed:
            self.top, self.column, self.columns = max(self.top, self.lowest), 0, columns
        self.top += self.s.gap * fresh_unit
        if changed:
            self.start = self.top

    def kept(self, flows: list[dict], k: int) -> int:
        """The height of a heading with the lines that must follow it."""
        height, left, unit = flows[k]["lines"] * flows[k]["line_height"], self.s.keep_with_next, flows[k]["unit"]
        for f in flows[k + 1 :]:
            if not left:
                break
            take = min(left, f["lines"])
            height += take * f["line_height"] + self.s.gap * (f["unit"] != unit)
            left, unit = left - take, f["unit"]
        return height

    def set(self, flows: list[dict]) -> list[tuple] | None:
        """Parts of the flows; None where one line is higher than a column."""
        out: list[tuple] = []
        for k, f in enumerate(flows):
            self.spans(f["columns"], bool(k) and flows[k - 1]["unit"] != f["unit"])
            done = part = 0
            while done < f["lines"]:
                end = self.s.page_height - self.foot()
                if not done and f["role"] == "heading" and self.top + (need := self.kept(flows, k)) > end >= self.s.margin + need:
                    self.onward()
                    continue
                fit = min(f["lines"] - done, (end - self.top) // f["line_height"])
                if fit < 1:
                    if self.top == self.s.margin:
                        return None
                    self.onward()
                    continue
                height = fit * f["line_height"]
                out.append((f["id"], part, self.page, f["columns"], self.column, done, done + fit, self.top, height))
                self.top += height
                self.lowest = max(self.lowest, self.top)
                done, part = done + fit, part + 1
                if done < f["lines"]:
                    self.onward()
        return out


def solved(flows: list[dict], spacing: Spacing, reserve: int) -> list[tuple] | None:
    """Parts of the flows with ``reserve`` free at the foot of the last page: all is set once, then with the reserve there, and
    if that needs one more page, with the reserve on that one. Each part ends with the number of pages."""
    found = Setter(spacing).set(flows)
    if found is None:
        return None
    last = max([1, *(p[2] for p in found)])
    if reserve:
        found = Setter(spacing, (last, reserve)).set(flows)
        if found is not None and max([1, *(p[2] for p in found)]) > last:
            last += 1
            found = Setter(spacing, (last, reserve)).set(flows)
        if found is None or max([1, *(p[2] for p in found)]) > last:
            return None
    return [(*p, last) for p in found]


def reading_pages(flows: DataFrame, key: str, order: str, spacing: Spacing = Spacing(), reserve: int = 0) -> DataFrame:
    """key, id and ``PARTS`` of flows: key, order, id, unit, role, columns (1 or 2), lines, line_height.

    Every place depends on those before, so a document is one group. Flows without lines are left out; a document with a line
    that no column holds, or without room for the reserve, gives no row.
    """
    fields = [order, "id", "unit", "role", "columns", "lines", "line_height"]
    kind = flows.schema[key].dataType.simpleString()
    sound = flows.select(key, *fields).where(F.col(order).isNotNull() & (F.col("lines") > 0) & (F.col("line_height") > 0) & F.col("columns").isin(1, 2))

    def work(name: tuple, rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: (r[order], r["id"]))
        return [(*name, *p) for p in solved(rows, spacing, reserve) or ()]

    return by_group(sound, [key], fields, work, f"{key} {kind}, id string, {PARTS}")


def page_trace(parts: DataFrame, budget: DataFrame) -> DataFrame:
    """doc_id, pages, budget, exceeded of each document that was set."""
    return parts.groupBy("doc_id").agg(F.max("pages").alias("pages")).join(budget, "doc_id").withColumn("exceeded", F.col("pages") > F.col("budget"))


def layout_problems(parts: DataFrame, flows: DataFrame, key: str) -> DataFrame:
    """key, id, problem: flows that are 'missing', 'unknown', not 'continuous' from part to part, or not set to their 'end'."""
    window = Window.partitionBy(key, "id").orderBy("part")
    before = F.coalesce(F.lag("line_end").over(window), F.lit(0))
    broken = (F.col("line_start") != before) | (F.col("part") != F.row_number().over(window) - 1) | (F.col("line_end") <= F.col("line_start"))
    seen = parts.withColumn("broken", broken).groupBy(key, "id").agg(F.max("broken").alias("broken"), F.max("line_end").alias("reached"))
    both = flows.select(key, "id", F.col("lines").alias("lines")).join(seen, [key, "id"], "full_outer")
    problem = F.when(F.col("reached").isNull(), "missing").when(F.col("lines").isNull(), "unknown").when(F.col("broken"), "continuous").when(F.col("reached") != F.col("lines"), "end")
    return both.withColumn("problem", problem).where("problem is not null").select(key, "id", "problem")


def band_heights(items: DataFrame, band: list[str], frame: str, padding: int) -> DataFrame:
    """band, height: the highest of a band's frames, each the sum of its gaps and heights and twice the padding."""
    frames = items.groupBy(*band, frame).agg(F.sum(F.col("gap") + F.col("height")).alias("h"))
    return frames.groupBy(*band).agg((F.max("h") + 2 * padding).cast("long").alias("height"))


def ranges_of(text: str | None, lines: list[str] | None) -> list[tuple[int, int]] | None:
    """The stretch of a text that each of its broken lines stands for, white space behind it included; together they are the
    whole text. None where the lines are not the text's."""
    if text is None or lines is None or not len(lines):
        return None
    starts, at = [], 0
    for line in lines:
        found = text.find(line, at) if line else -1
        if found < 0 or text[at:found].strip():
            return None
        starts.append(found)
        at = found + len(line)
    if text[at:].strip():
        return None
    edges = [0, *starts[1:], len(text)]
    return list(zip(edges, edges[1:], strict=False))


def line_ranges(text: Column, lines: Column) -> Column:
    """``ranges_of`` as a column: array of struct<start, end>."""

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def bind(texts: pd.Series, broken: pd.Series) -> pd.Series:
        found = [ranges_of(t, b) for t, b in zip(texts, broken, strict=True)]
        return pd.Series([None if r is None else [{"start": a, "end": b} for a, b in r] for r in found], dtype=object)

    return bind(text, lines)
