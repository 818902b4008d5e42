"""Queries over flows, pages, selected items and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import text
from quirespark.operators import layout, page_graphics, reading, selection, store
from quirespark.plans.fold_sql import SQL as FOLDS
from quirespark.plans.fold_sql import VISIBLE
from quirespark.plans.page_plans import BOX, LINES_SQL, PAGE, lines
from quirespark.plans.record_plans import GATES_SQL, gate_summary
from quirespark.plans.unit_plans import UNITS_SQL, line_breaks, paginated, translation_rows, unit_rows
from quirespark.sources.tables import spread, table


def unit_flows(spark: SparkSession, folder: str) -> DataFrame:
    made = reading.unit_flows(unit_rows(spark, folder, "role", "fragments"), translation_rows(spark, folder, "chinese_text"))
    return made.withColumn("source_pages", F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ","))


FLOWS_SQL = """
with u as (select distinct doc_id, id unit_id, role, fragments from semantic_unit), t as (select distinct doc_id, unit_id, chinese_text from translation where chinese_text is not null),
s as (select *, case role when 'title' then 17600 when 'heading' then 13200 when 'figure-caption' then 10120 when 'table-caption' then 10120 when 'footnote' then 10120 when 'note' then 10000 else 11000 end z from u join t using (doc_id, unit_id))
select doc_id, unit_id, role, case when role in ('title', 'abstract', 'keywords') then cast(1 as bigint) else 2 end column_count, cast(z as bigint) size_mpt, cast(z * 140 // 100 as bigint) leading_mpt, array_to_string(list_sort(list_distinct(list_transform(fragments, lambda f: f.page_number))), ',') source_pages, length(chinese_text) target_length from s
"""


def page_budgets(spark: SparkSession, folder: str) -> DataFrame:
    return reading.page_budget(unit_rows(spark, folder, "fragments"))


BUDGETS_SQL = "select doc_id, greatest(1, count(distinct p)) budget from (select doc_id, unnest(list_transform(fragments, lambda f: f.page_number)) p from semantic_unit) group by 1"


def _flows(spark: SparkSession, folder: str) -> DataFrame:
    """Flows of all renderings, their lines as they break in their column."""
    flows = reading.unit_flows(unit_rows(spark, folder, "role", "reading_order", "fragments"), translation_rows(spark, folder, "chinese_text"))
    order = unit_rows(spark, folder, "reading_order").withColumnRenamed("id", "unit_id")
    texts = spread(translation_rows(spark, folder, "chinese_text").where("chinese_text is not null"), "doc_id", "unit_id")
    broken = layout.line_breaks(texts, "chinese_text", 250_000).select("doc_id", "unit_id", F.size("lines").cast("long").alias("lines"))
    joined = flows.join(order, ["doc_id", "unit_id"]).join(broken, ["doc_id", "unit_id"])
    return joined.select("doc_id", "reading_order", F.col("unit_id").alias("id"), F.col("unit_id").alias("unit"), "role", F.col("column_count").alias("columns"), "lines", F.col("leading_mpt").alias("line_height"))


def reading_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Renderings in one and two columns, 60 000 free at the foot of the last page."""
    return reading.reading_pages(_flows(spark, folder), "doc_id", "reading_order", reserve=60_000)


def reading_traces(spark: SparkSession, folder: str) -> DataFrame:
    return reading.page_trace(reading_pages(spark, folder), page_budgets(spark, folder))


def layout_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Set pages held against flows of which every unit of an even order has one line more and those of order 3 are gone."""
    flows = unit_rows(spark, folder, "reading_order", "source_text").withColumn("lines", (F.ceil(F.length("source_text") / 27) + F.when(F.col("reading_order") % 2 == 0, 1).otherwise(0)).cast("long")).where("reading_order <> 3 and lines > 0")
    return reading.layout_problems(paginated(spark, folder), flows, "doc_id")


PROBLEMS_SQL = f"""
with p as ({FOLDS["paginated"].replace("with recursive", "with recursive", 1)}), s as (select doc_id, id, max(line_end) reached from p group by 1, 2),
f as (select doc_id, id, cast(ceil(length(source_text) / 27.0) as bigint) + case when reading_order % 2 = 0 then 1 else 0 end n from {UNITS_SQL} where reading_order <> 3)
select doc_id, id, case when reached is null then 'missing' when n is null then 'unknown' else 'end' end problem from (select * from f where n > 0) full join s using (doc_id, id) where reached is null or n is null or reached <> n
"""


def band_heights(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as bands and halves as their frames: the height of each page's fuller half, 2 000 between lines."""
    own = lines(spark, folder, *BOX).select(*PAGE, (F.col("x0") + F.col("x1") >= 595_276).alias("frame"), (F.col("y1") - F.col("y0")).alias("height"), F.lit(2000).alias("gap"))
    return reading.band_heights(own, PAGE, "frame", 4000)


HEIGHTS_SQL = f"select doc_id, page_number, max(h) + 8000 height from (select doc_id, page_number, x0 + x1 >= 595276 f, cast(sum(y1 - y0 + 2000) as bigint) h from {LINES_SQL} group by 1, 2, 3) group by 1, 2"


def page_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """Each set page with the page of the source that stands beside it; pages beyond the source have none."""
    pages = paginated(spark, folder).select("doc_id", "page").distinct()
    source = lines(spark, folder).select("doc_id", F.col("page_number").cast("long").alias("source_page")).distinct()
    return pages.join(source, (pages.doc_id == source.doc_id) & (pages.page == source.source_page), "left").select(pages.doc_id, "page", "source_page", F.when(F.col("source_page").isNull(), "continuation").otherwise("native").alias("kind"))


MAPPINGS_SQL = f"with p as ({FOLDS['paginated']}), g as (select distinct doc_id, page from p), s as (select distinct doc_id, cast(page_number as bigint) source_page from text_line) select g.doc_id, g.page, s.source_page, case when s.source_page is null then 'continuation' else 'native' end kind from g left join s on s.doc_id = g.doc_id and s.source_page = g.page"


def line_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """The stretch of its rendering that each broken line stands for."""
    own = translation_rows(spark, folder, "chinese_text").where("chinese_text is not null")
    made = layout.line_breaks(spread(own, "doc_id", "unit_id"), "chinese_text", 300_000)
    ranges = made.select("doc_id", "unit_id", F.posexplode(reading.line_ranges(F.col("chinese_text"), F.col("lines"))).alias("line", "r"))
    return ranges.select("doc_id", "unit_id", F.col("line").cast("long").alias("line"), F.col("r.start").alias("line_start"), F.col("r.end").alias("line_end"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of renderings as candidates: those of captions are notes of their figure."""
    units = unit_rows(spark, folder, "role", "reading_order").withColumnRenamed("id", "unit_id")
    each = translation_rows(spark, folder, "terminology").select("doc_id", "unit_id", F.posexplode("terminology").alias("k", "t")).join(units, ["doc_id", "unit_id"])
    kind = F.when(F.col("reading_order") % 4 == 0, "figure").otherwise("teaching")
    return each.select("doc_id", F.concat_ws("#", "unit_id", F.col("k").cast("string")).alias("key"), kind.alias("kind"), F.when(kind == "figure", F.col("unit_id")).alias("figure_id"), F.length("t.source").cast("long").alias("priority"), (F.length("t.target") > 4).alias("essential"), text.visible_characters(F.col("t.target")).alias("size"))


CANDIDATES = f"""
c as (select doc_id, unit_id || '#' || k "key", case when o % 4 = 0 then 'figure' else 'teaching' end kind, case when o % 4 = 0 then unit_id end figure_id, length(x.source) priority, length(x.target) > 4 essential, {VISIBLE.format("x.target")} size
  from (select t.doc_id, unit_id, reading_order o, generate_subscripts(terminology, 1) - 1 k, unnest(terminology) x from (select distinct doc_id, unit_id, terminology from translation) t join (select distinct doc_id, id, reading_order from semantic_unit) u on u.doc_id = t.doc_id and u.id = t.unit_id))
"""


def promoted_items(spark: SparkSession, folder: str) -> DataFrame:
    return selection.promoted(_candidates(spark, folder)).select("doc_id", "key", "core", "place")


PROMOTED_SQL = f"""
with {CANDIDATES}, m as (select *, essential or (kind = 'figure' and row_number() over (partition by doc_id, kind, figure_id order by "key") = 1)
  or (kind = 'teaching' and row_number() over (partition by doc_id, kind order by priority desc, "key") = 1 and not bool_or(essential) over (partition by doc_id, kind)) core from c)
select doc_id, "key", core, case when not core then row_number() over (partition by doc_id, core order by case when kind = 'figure' then 0 else 1 end, priority desc, "key") end place from m
"""


def item_shares(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates and emphasised terms of a document as items against its visible characters."""
    own = translation_rows(spark, folder, "chinese_text", "terminology")
    totals = own.groupBy("doc_id").agg(F.sum(text.visible_characters(F.coalesce("chinese_text", F.lit("")))).alias("denominator"))
    marks = own.select("doc_id", F.explode("terminology").alias("t")).select("doc_id", F.lit("highlight").alias("kind"), text.visible_characters(F.col("t.target")).alias("size"))
    return selection.items_by_kind(marks.unionByName(_candidates(spark, folder).select("doc_id", "kind", "size")), totals)


SHARES_SQL = f"""
with {CANDIDATES}, t as (select distinct doc_id, unit_id, chinese_text, terminology from translation), d as (select doc_id, cast(sum({VISIBLE.format("coalesce(chinese_text, '')")}) as bigint) n from t group by 1),
i as (select doc_id, 'highlight' kind, {VISIBLE.format("x.target")} size from (select doc_id, unnest(terminology) x from t) union all select doc_id, kind, size from c),
s as (select doc_id, count(*) items, cast(sum(case when kind = 'highlight' then size else 0 end) as bigint) h, cast(sum(case when kind <> 'highlight' then size else 0 end) as bigint) k from i group by 1)
select doc_id, coalesce(items, 0) items, case when n = 0 then 0 else (coalesce(h, 0) * 10000 + n // 2) // n end highlight_basis_points, case when n = 0 then 0 else (coalesce(k, 0) * 10000 + n // 2) // n end teaching_basis_points from d left join s using (doc_id)
"""


def gate_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The gates of each source's documents, those behind a failed one skipped."""
    return store.chained_gates(gate_summary(spark, folder), "source", {"counted": None, "has_text": "counted", "language": None, "in_time": "language"})


CHAIN_SQL = f"""
with g as ({GATES_SQL.strip()}), p as (select source, bool_and(case when gate = 'counted' then passed end) a, bool_and(case when gate = 'has_text' then passed end) b, bool_and(case when gate = 'language' then passed end) c, bool_and(case when gate = 'in_time' then passed end) d from g group by 1)
select source, unnest(['counted', 'has_text', 'language', 'in_time']) gate, unnest([case when a then 'passed' else 'failed' end, case when not a then 'skipped' when b then 'passed' else 'failed' end, case when c then 'passed' else 'failed' end, case when not c then 'skipped' when d then 'passed' else 'failed' end]) status from p
"""


def graphic_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, captions and lines of pages on which every line outside the body is underlined and every seventh framed."""
    own = lines(spark, folder, "text", *BOX, "max_font_size_mpt", "font_names", "coverage_eligible", "exclusion_kind", "body_eligible")
    box = [F.col(c) for c in BOX]
    rules = own.where("not body_eligible").select(*PAGE, F.concat(F.lit("u-"), "id").alias("id"), F.lit("rect").alias("kind"), F.lit(True).alias("filled"), F.lit(False).alias("stroked"), box[0].alias("x0"), (box[1] - 1000).alias("y0"), box[2].alias("x1"), (box[1] - 500).alias("y1"))
    art = own.where(F.col("y0") % 7 == 0).select(*PAGE, F.concat(F.lit("i-"), "id").alias("id"), F.lit("image").alias("kind"), F.lit(False).alias("filled"), F.lit(False).alias("stroked"), *[(c + d).alias(n) for n, c, d in zip(BOX, box, (-2000, -2000, 2000, 2000), strict=True)])
    given = own.select(*PAGE, "id", "text", F.col("max_font_size_mpt").alias("size"), F.col("font_names").alias("fonts"), F.col("coverage_eligible").alias("covers"), F.col("exclusion_kind").alias("excluded"), *BOX)
    return page_graphics.page_blocks(rules.unionByName(art), given).withColumn("line_ids", F.array_join("line_ids", " "))


QUERIES = {f.__name__: f for f in (unit_flows, page_budgets, reading_pages, reading_traces, layout_problems, band_heights, page_mappings, line_bindings, promoted_items, item_shares, gate_chain, graphic_blocks)}
SQL = {
    "unit_flows": FLOWS_SQL, "page_budgets": BUDGETS_SQL, "layout_problems": PROBLEMS_SQL, "band_heights": HEIGHTS_SQL, "page_mappings": MAPPINGS_SQL, "promoted_items": PROMOTED_SQL, "item_shares": SHARES_SQL, "gate_chain": CHAIN_SQL,
}
