"""Reading order, offsets, sections, semantic units, packets and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.text import joined_fragments


def reading_order(blocks: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``blocks`` with ``position`` (from 0) and ``successor``, the id that comes next."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return blocks.withColumn("position", (F.row_number().over(window) - 1).cast("long")).withColumn("successor", F.lead("id").over(window))


def running_offsets(units: DataFrame, keys: list[str], order: list[str], text: str, gap: int = 0) -> DataFrame:
    """``units`` with char_start and char_end in the joined text of their group; a null text has length 0."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    end = F.sum(size).over(window) + gap * (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return units.withColumn("char_end", end.cast("long")).withColumn("char_start", F.col("char_end") - size)


def section_states(lines: DataFrame, keys: list[str], order: list[str], is_heading: Column, opens: Column) -> DataFrame:
    """``lines`` with ``section`` (number of headings so far), ``within`` (the last heading opened the wanted part) and
    ``past`` (some heading has opened it)."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flag = F.when(is_heading, F.coalesce(opens, F.lit(False)))
    return (
        lines.withColumn("section", F.sum(F.when(is_heading, 1).otherwise(0)).over(window).cast("long"))
        .withColumn("within", F.coalesce(F.last(flag, ignorenulls=True).over(window), F.lit(False)))
        .withColumn("past", F.coalesce(F.max(flag).over(window), F.lit(False)))
    )


# How a sentence ends, how lists and quotations begin, and what goes on.
SENTENCE_END = r"""[.!?]["'’”)\]]*$"""
LIST_START = r"^(?:[-•*▪◦–]\s|\(?[0-9a-zA-Z]{1,3}[.)]\s)"
QUOTE_START = r"""^["'‘“]"""
COORDINATION = r"(?i)\b(?:and|or|nor)\s*$"
PARENTHESIS = r"^\([a-z][^()\n]{0,80}\)\s*[,;]"
FORMULA_START = r"^(?:[A-Z][a-z]?\d*){2,}\b"
EDGE, INDENT = 20_000, 10_000


def boundary(left_role: Column, right_role: Column, left: Column, right: Column, breaks: Column, indented: Column) -> Column:
    """'separate', 'merge' or 'review' for two blocks one after the other.

    Only body blocks across a break of column or page may merge; a sentence that ended, an indent, a list item or an
    opening quotation separates, a hyphen or a small letter joins, anything else is for review.
    """
    a, b = F.rtrim(left), F.ltrim(right)
    small = b.rlike(r"^\p{Ll}")
    ended = a.rlike(SENTENCE_END) | indented | b.rlike(LIST_START) | b.rlike(QUOTE_START)
    goes_on = small | a.rlike(COORDINATION) | b.rlike(PARENTHESIS) | b.rlike(FORMULA_START)
    return (
        F.when((left_role != "body") | (right_role != "body") | ~breaks, "separate")
        .when((a == "") | (b == ""), "review")
        .when(ended, "separate")
        .when(a.endswith("-"), F.when(small, "merge").otherwise("review"))
        .when(goes_on, "merge")
        .otherwise("review")
    )


def located(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, page_number, band, column) with band_y0, band_y1, columns and column_x0 of their place; blocks
    without one are dropped."""
    place = bands.select("doc_id", "page_number", "band", "column", "columns", F.col("y0").alias("band_y0"), F.col("y1").alias("band_y1"), F.col("x0").alias("column_x0"))
    return blocks.join(place, ["doc_id", "page_number", "band", "column"])


def located_units(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``merged_units`` of located blocks, their breaks told from where they stand.

    A break lies between the foot of one column and the head of the next, between pages, where a caption floats between, or
    where a word is divided within a column or into the next. ``blocks``: what ``located`` gives, with id, role, text, y0, y1,
    first_x0 and confidence_ppm.
    """
    everything, flow = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*order)
    before = lambda c: F.lag(c).over(flow)
    head = F.col("band_y1") - F.col("y1") <= EDGE
    foot = before("y0") - before("band_y0") <= EDGE
    same_page, next_page = F.col("page_number") == before("page_number"), F.col("page_number") == before("page_number") + 1
    same_band, next_column = same_page & (F.col("band") == before("band")), F.col("column") == before("column") + 1
    turned = (same_band & next_column) | (next_page & (before("column") == before("columns")) & (F.col("column") == 1))
    floats = F.col("place_") - before("place_") > 1
    around = floats & ((same_page & (next_column | ((F.col("band") != before("band")) & (F.col("column") == 1)))) | next_page)
    divided = F.rtrim(before("text")).endswith("-") & F.ltrim("text").rlike(r"^\p{Ll}")
    below = same_band & (F.col("column") == before("column")) & (before("y0") - F.col("y1")).between(0, 50_000)
    breaks = (foot & head & turned) | around | (divided & (below | (same_band & next_column & head)))
    placed = blocks.withColumn("place_", F.row_number().over(everything))
    return merged_units(placed, keys, order, breaks, F.col("first_x0") - F.col("column_x0") > INDENT)


def merged_units(blocks: DataFrame, keys: list[str], order: list[str], breaks: Column, indented: Column) -> DataFrame:
    """keys, unit, text, blocks, confidence, needs_review: blocks joined where the boundary says merge.

    A caption floats: it is a unit of its own, and the body around it continues across.
    """
    floating = F.col("role").endswith("caption")
    flow = blocks.where(~floating)
    window = Window.partitionBy(*keys).orderBy(*order)
    verdict = F.coalesce(boundary(F.lag("role").over(window), F.col("role"), F.lag("text").over(window), F.col("text"), F.coalesce(breaks, F.lit(False)), F.coalesce(indented, F.lit(False))), F.lit("separate"))
    judged = flow.withColumn("verdict", verdict)
    numbered = judged.withColumn("unit", F.sum(F.when(F.col("verdict") == "merge", 0).otherwise(1)).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    floats = blocks.where(floating).withColumn("verdict", F.lit("separate")).withColumn("unit", -F.row_number().over(window))
    parts = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, "id", "text"]))))
    grouped = numbered.unionByName(floats).groupBy(*keys, "unit").agg(parts.alias("p"), F.min("confidence_ppm").alias("confidence_ppm"), F.max(F.col("verdict") == "review").alias("needs_review"))
    return grouped.select(*keys, F.col("unit").cast("long").alias("unit"), joined_fragments(F.transform("p", lambda x: x["text"])).alias("text"), F.transform("p", lambda x: x["id"]).alias("blocks"), "confidence_ppm", "needs_review")


def packets(units: DataFrame, keys: list[str], order: list[str], budget: int = 12_000) -> DataFrame:
    """keys, id, packet: units in order in packets of at most ``budget`` characters; a heading opens a packet that is half
    full. A unit is never split, so a longer one has a packet of its own.

    One group is one row of an ordered fold over lengths and roles alone; the texts stay where they are.
    """
    item = F.struct(*order, "id", F.coalesce(F.length("source_text"), F.lit(0)).cast("long").alias("size"), (F.col("role") == "heading").alias("head"))
    rows = units.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("packet"), F.array().cast("array<long>").alias("out"))

    def step(state: Column, unit: Column) -> Column:
        full = (F.size(state["out"]) > 0) & ((state["filled"] + unit["size"] > budget) | (F.coalesce(unit["head"], F.lit(False)) & (state["filled"] >= budget // 2)))
        number = state["packet"] + F.when(full, 1).otherwise(0)
        filled = F.when(full, unit["size"]).otherwise(state["filled"] + unit["size"])
        return F.struct(filled.cast("long").alias("filled"), number.cast("long").alias("packet"), F.concat(state["out"], F.array(number.cast("long"))).alias("out"))

    folded = rows.select(*keys, "items", F.aggregate("items", start, step, lambda s: s["out"]).alias("numbers"))
    each = folded.select(*keys, F.explode(F.arrays_zip(F.transform("items", lambda x: x["id"]).alias("id"), F.col("numbers").alias("packet"))).alias("e"))
    return each.select(*keys, F.col("e.id").alias("id"), F.col("e.packet").alias("packet"))


def coverage(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected_count, given_count, problem of keys that are not covered exactly once: 'missing', 'unknown', 'repeated'."""
    a = expected.groupBy(*keys).agg(F.count("*").alias("expected_count"))
    b = given.groupBy(*keys).agg(F.count("*").alias("given_count"))
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("expected_count", F.lit(0)).cast("long").alias("expected_count"), F.coalesce("given_count", F.lit(0)).cast("long").alias("given_count"))
    problem = F.when(F.col("given_count") == 0, "missing").when(F.col("expected_count") == 0, "unknown").when((F.col("given_count") > 1) | (F.col("expected_count") > 1), "repeated")
    return both.withColumn("problem", problem).where("problem is not null")


def fragment_gaps(units: DataFrame) -> DataFrame:
    """doc_id, id, position, problem of fragments that are empty, overlap their block's last fragment or leave a gap behind it."""
    each = units.select("doc_id", "id", F.posexplode("fragments").alias("position", "f")).select("doc_id", "id", "position", "f.block_id", F.col("f.source_char_start").alias("a"), F.col("f.source_char_end").alias("b"))
    window = Window.partitionBy("doc_id", "block_id").orderBy("a", "b", "id", "position")
    problem = F.when(F.col("a") >= F.col("b"), "empty").when(F.col("a") < F.lag("b").over(window), "overlap")
    return each.withColumn("problem", problem).where("problem is not null").select("doc_id", "id", F.col("position").cast("long").alias("position"), "problem")
