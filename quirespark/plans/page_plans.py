"""Queries over characters, lines and boxes of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions.geometry import box, fit_scale, overlaps, scaled, union_box
from quirespark.operators import bands, extraction, intervals, layout, records, roles, selection, topology, units
from quirespark.operators.latest import latest
from quirespark.sources.tables import cut, table

PAGE = ["doc_id", "page_number"]
LINES_SQL = "(select * from text_line qualify row_number() over (partition by doc_id, id order by loaded_at desc) = 1)"
CHARS_SQL = "(select distinct doc_id, page_number, id, text, x0, y0, x1, y1, font_name, font_size_mpt, upright from page_char)"


def lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """text_line, each line by its latest delivery."""
    wanted = dict.fromkeys([*PAGE, "id", "loaded_at", *columns])
    return latest(table(spark, folder, "text_line").select(*wanted), ["doc_id", "id"], ["loaded_at"]).drop("loaded_at")


def chars(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """page_char, each glyph once."""
    return table(spark, folder, "page_char").select(*dict.fromkeys([*PAGE, "id", *columns])).distinct()


BOX = ("x0", "y0", "x1", "y1")


def repeated_marginals(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.repeated_marginals(lines(spark, folder, "text", "y0", "y1", "max_font_size_mpt", "fill_colors"))


REPEATED_SQL = rf"""
with l as (select * from {LINES_SQL} where text is not null),
s as (select *, regexp_replace(lower(trim(regexp_replace(text, '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))), '[0-9]+', '#', 'g') sig from l),
t as (select doc_id, count(distinct page_number) n, count(distinct case when page_number % 2 = 1 then page_number end) o, count(distinct case when page_number % 2 = 0 then page_number end) e from {LINES_SQL} group by 1),
r as (select doc_id, sig, count(distinct page_number) n, count(distinct case when page_number % 2 = 1 then page_number end) o, count(distinct case when page_number % 2 = 0 then page_number end) e from s group by 1, 2),
rep as (select r.doc_id, r.sig from r join t using (doc_id) where r.n >= greatest(2, ceil(t.n * 6 / 10.0)) or (t.n >= 4 and ((t.o >= 2 and r.o >= greatest(2, ceil(t.o * 6 / 10.0))) or (t.e >= 2 and r.e >= greatest(2, ceil(t.e * 6 / 10.0)))))),
u as (select doc_id, floor(median(max_font_size_mpt)) usual from s group by 1),
p as (select s.doc_id, s.id, case
  when s.y0 <= 101026 and regexp_matches(trim(regexp_replace(s.text, '\s+', ' ', 'g')), '^(?i:(?:page\s+)?(?:\d+|[ivxlcdm]+)(?:\s+of\s+(?:\d+|[ivxlcdm]+))?)$') then 'page-number'
  when rep.sig is null then null
  when s.y1 >= 841890 - 101026 then 'repeated-header'
  when s.y0 <= 101026 then 'repeated-footer'
  when s.max_font_size_mpt >= usual * 3 // 2 then 'watermark'
  when coalesce(list_avg(list_transform(flatten(list_filter(s.fill_colors, lambda c: c is not null)), lambda x: try_cast(x as double))), 0) >= 600000 then 'watermark' end kind
  from s join t using (doc_id) join u using (doc_id) left join rep on rep.doc_id = s.doc_id and rep.sig = s.sig where t.n >= 2)
select doc_id, id, kind from p where kind is not null
"""


def interval_union(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.interval_union(lines(spark, folder, "y0", "y1"), PAGE, "y0", "y1")


UNION_SQL = f"""
with d as (select distinct doc_id, page_number, y0, y1 from {LINES_SQL} where y0 < y1),
m as (select *, max(y1) over (partition by doc_id, page_number order by y0, y1 rows between unbounded preceding and 1 preceding) reach from d),
i as (select *, sum(case when reach is null or y0 > reach then 1 else 0 end) over (partition by doc_id, page_number order by y0, y1 rows unbounded preceding) island from m)
select doc_id, page_number, min(y0) y0, max(y1) y1 from i group by doc_id, page_number, island
"""


def axis_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.gaps(lines(spark, folder, "y0", "y1"), PAGE, "y0", "y1", 5000)


GAPS_SQL = f"select * from (select doc_id, page_number, y1 gap_start, lead(y0) over (partition by doc_id, page_number order by y0) gap_end from ({UNION_SQL})) where gap_end - gap_start >= 5000"


def gutter_persistence(spark: SparkSession, folder: str) -> DataFrame:
    """Of each page's middle strip of 20 000, how much of the occupied height is free."""
    boxes = lines(spark, folder, *BOX)
    mid = F.call_function("div", F.min("x0") + F.max("x1"), F.lit(2).cast("long"))
    gutters = boxes.groupBy(*PAGE).agg((mid - 10_000).alias("gutter_left"), (mid + 10_000).alias("gutter_right"), F.min("y0").alias("y_bottom"), F.max("y1").alias("y_top"))
    return intervals.persistence(boxes, gutters, PAGE)


PERSISTENCE_SQL = f"""
with b as (select * from {LINES_SQL}),
g as (select doc_id, page_number, (min(x0) + max(x1)) // 2 - 10000 gl, (min(x0) + max(x1)) // 2 + 10000 gr from b group by 1, 2),
c as (select b.doc_id, b.page_number, gl, gr, y0, y1, x0 < gr and x1 > gl across from b join g using (doc_id, page_number) where y0 < y1),
u as (select * from (select doc_id, page_number, y0, y1, 'all' k from c union all select doc_id, page_number, y0, y1, 'across' from c where across)),
m as (select *, max(y1) over (partition by doc_id, page_number, k order by y0, y1 rows between unbounded preceding and 1 preceding) reach from u),
s as (select doc_id, page_number, k, sum(case when reach is null or y0 > reach then y1 - y0 else greatest(0, y1 - reach) end) len from m group by 1, 2, 3)
select g.doc_id, g.page_number, gl gutter_left, gr gutter_right, cast(case when coalesce(a.len, 0) = 0 then 0 else greatest(0, least(1000000, (a.len - coalesce(x.len, 0)) * 1000000 // a.len)) end as bigint) ppm
from g left join s a on a.doc_id = g.doc_id and a.page_number = g.page_number and a.k = 'all' left join s x on x.doc_id = g.doc_id and x.page_number = g.page_number and x.k = 'across'
"""


def elementary_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.elementary(lines(spark, folder, "x0", "x1"), PAGE, "x0", "x1")


ELEMENTARY_SQL = f"""
with r as (select doc_id, page_number, x0, x1 from {LINES_SQL} where x0 < x1),
p as (select doc_id, page_number, x0 p from r union select doc_id, page_number, x1 from r),
e as (select doc_id, page_number, p a, lead(p) over (partition by doc_id, page_number order by p) b from p)
select e.doc_id, e.page_number, a x0, b x1, count(*) covers from e join r on r.doc_id = e.doc_id and r.page_number = e.page_number and r.x0 <= a and r.x1 >= b where b is not null group by 1, 2, 3, 4
"""


def containment_smallest(spark: SparkSession, folder: str) -> DataFrame:
    """The line that each glyph lies in, to a tolerance of 1000."""
    inner, outer = chars(spark, folder, *BOX), lines(spark, folder, *BOX)
    return extraction.smallest_container(inner, outer, PAGE, tolerance=1000).select(*PAGE, "id", "container_id")


CONTAINMENT_SQL = f"""
with c as {CHARS_SQL.replace('distinct doc_id, page_number, id, text, x0, y0, x1, y1, font_name, font_size_mpt, upright', 'distinct doc_id, page_number, id, x0, y0, x1, y1')}, l as (select * from {LINES_SQL}),
m as (select c.doc_id, c.page_number, c.id, min(row((l.x1 - l.x0) * (l.y1 - l.y0), l.id)) b from c join l on l.doc_id = c.doc_id and l.page_number = c.page_number
  and c.x0 >= l.x0 - 1000 and c.y0 >= l.y0 - 1000 and c.x1 <= l.x1 + 1000 and c.y1 <= l.y1 + 1000 group by 1, 2, 3)
select c.doc_id, c.page_number, c.id, b[2] container_id from c left join m using (doc_id, page_number, id)
"""


def box_meetings(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that lie within 7 000 of one another."""
    return extraction.meeting(lines(spark, folder, *BOX), PAGE, tolerance=7000)


MEETING_SQL = f"""
with l as (select * from {LINES_SQL})
select a.doc_id, a.page_number, a.id, b.id other from l a join l b on a.doc_id = b.doc_id and a.page_number = b.page_number and a.id < b.id
  and a.x0 <= b.x1 + 7000 and b.x0 <= a.x1 + 7000 and a.y0 <= b.y1 + 7000 and b.y0 <= a.y1 + 7000
"""


def line_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Pages on which two lines, set with 4 000 of leading on all sides, share an area, with how many pairs do: the open test."""
    own = lines(spark, folder, *BOX).select(*PAGE, "id", *[(F.col(c) + d).alias(c) for c, d in zip(BOX, (-4000, -4000, 4000, 4000), strict=True)])
    met = extraction.meeting(own, PAGE)
    b = own.select(*PAGE, F.col("id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in BOX])
    both = met.join(own, [*PAGE, "id"]).join(b, [*PAGE, "other"]).where(overlaps(box(), box("o_")))
    return both.groupBy(*PAGE).agg(F.count("*").alias("pairs"))


LINE_OVERLAPS_SQL = f"""
with l as (select * from {LINES_SQL})
select a.doc_id, a.page_number, count(*) pairs from l a join l b on a.doc_id = b.doc_id and a.page_number = b.page_number and a.id < b.id
  and a.x0 < b.x1 + 8000 and b.x0 < a.x1 + 8000 and a.y0 < b.y1 + 8000 and b.y0 < a.y1 + 8000 group by 1, 2
"""


def reading_order_edges(spark: SparkSession, folder: str) -> DataFrame:
    own = lines(spark, folder, *BOX)
    return units.reading_order(own, ["doc_id"], ["page_number", F.desc("y1"), F.desc("y0"), "x0", "x1", "id"]).select("doc_id", "id", "position", "successor")


ORDER_SQL = f"""
select doc_id, id, row_number() over w - 1 as position, lead(id) over w as successor from {LINES_SQL}
window w as (partition by doc_id order by page_number, y1 desc, y0 desc, x0, x1, id)
"""


def character_order(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.ordered_characters(chars(spark, folder, "text", *BOX)).select(*PAGE, "id", "ordinal", "made_id")


CHARACTER_ORDER_SQL = """
with c as (select distinct doc_id, page_number, id, text, x0, y0, x1, y1 from page_char),
o as (select *, row_number() over (partition by doc_id, page_number order by y1 desc, x0, y0, x1, text, id) ordinal from c)
select doc_id, page_number, id, ordinal, printf('p%04d-char-%06d', page_number, ordinal) made_id from o
"""


def line_text_from_characters(spark: SparkSession, folder: str) -> DataFrame:
    """Text of each line made again from its glyphs and the gaps between them, and whether it is the given text."""
    own = lines(spark, folder, "text", "character_ids").select(*PAGE, F.col("id").alias("line_id"), F.col("text").alias("given"), "character_ids")
    made = extraction.glyph_texts(own, table(spark, folder, "page_char"))
    return made.select("doc_id", "line_id", "text", (F.col("text") == F.col("given")).alias("same"))


LINE_TEXT_SQL = f"""
with l as (select doc_id, page_number, id line_id, text given, unnest(character_ids) id from {LINES_SQL}),
p as (select l.*, c.text t, c.x0, c.y0, c.x1, c.font_size_mpt f from l join (select distinct doc_id, page_number, id, text, x0, y0, x1, font_size_mpt from page_char) c using (doc_id, page_number, id)),
g as (select *, x0 - lag(x1) over w gap, least(f, lag(f) over w) small from p window w as (partition by doc_id, page_number, line_id, given order by x0, y0, id)),
m as (select doc_id, page_number, line_id, given, trim(string_agg(case when gap > greatest(800, 3 * small // 20) then ' ' else '' end || t, '' order by x0, y0, id), ' ') as made from g group by 1, 2, 3, 4)
select doc_id, line_id, made as text, made = given as same from m where length(made) > 0
"""


def line_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.line_clusters(chars(spark, folder, *BOX, "font_size_mpt"))


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    made = extraction.text_lines(chars(spark, folder, "text", *BOX, "font_size_mpt", "font_name"))
    return made.select(*PAGE, "id", "text", *BOX, "max_font_size_mpt")


def body_sizes(spark: SparkSession, folder: str) -> DataFrame:
    own = lines(spark, folder, "text", "max_font_size_mpt")
    return layout.body_size(own.select("doc_id", F.col("max_font_size_mpt").alias("size_mpt"), F.length("text").cast("long").alias("characters")))


BODY_SQL = f"""
with s as (select doc_id, max_font_size_mpt z, cast(length(text) as bigint) n from {LINES_SQL} where max_font_size_mpt > 0 and length(text) > 0),
c as (select doc_id, median(z) centre from s group by 1), o as (select s.*, centre, abs(z - centre) dev from s join c using (doc_id)),
r as (select doc_id, greatest(500.0, max(centre) * 0.15, median(dev) * 3.0) reach from o group by 1),
w as (select doc_id, z, sum(n) n, max(dev) dev from o join r using (doc_id) where dev <= reach group by 1, 2)
select doc_id, z body_size from w qualify row_number() over (partition by doc_id order by n desc, dev, z) = 1
"""


def font_usage(spark: SparkSession, folder: str) -> DataFrame:
    return layout.font_usage(chars(spark, folder, "text", "font_name", "font_size_mpt"), ["font_name", "font_size_mpt"], "text")


FONT_SQL = f"select font_name, font_size_mpt, count(*) runs, cast(sum(length(text)) as bigint) characters from {CHARS_SQL} group by 1, 2"


def page_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The scale that fits each page's printed area, with its margins, onto half of the page size."""
    size = lines(spark, folder, *BOX).groupBy(*PAGE).agg((F.max("x1") + F.min("x0")).alias("width"), (F.max("y1") + 20_000).alias("height"))
    scale = fit_scale(F.col("width"), F.col("height"), 297_638, 420_945)
    return size.withColumn("scale_ppm", scale).select(*PAGE, "scale_ppm", scaled(F.col("width"), F.col("scale_ppm")).alias("width"), scaled(F.col("height"), F.col("scale_ppm")).alias("height"))


FIT_SQL = f"""
with p as (select doc_id, page_number, max(x1) + min(x0) w, max(y1) + 20000 h from {LINES_SQL} group by 1, 2),
s as (select *, least(1000000, 297638 * cast(1000000 as bigint) // w, 420945 * cast(1000000 as bigint) // h) scale_ppm from p)
select doc_id, page_number, scale_ppm, (w * scale_ppm + 500000) // 1000000 width, (h * scale_ppm + 500000) // 1000000 height from s
"""


def column_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Each line's share in the width of its page's lines, in millionths that add up exactly."""
    own = lines(spark, folder, "x0", "x1").withColumn("w", F.col("x1") - F.col("x0"))
    return selection.apportioned(own, PAGE, "id", "w")


SHARES_SQL = f"""
with s as (select doc_id, page_number, id, greatest(0, coalesce(x1 - x0, 0)) w, sum(greatest(0, coalesce(x1 - x0, 0))) over (partition by doc_id, page_number) a from {LINES_SQL}),
f as (select *, cast(w * 1000000 // a as bigint) f, cast(w * 1000000 % a as bigint) r from s where a > 0)
select doc_id, page_number, id, cast(f + case when row_number() over (partition by doc_id, page_number order by r desc, id) <= 1000000 - sum(f) over (partition by doc_id, page_number) then 1 else 0 end as bigint) as share from f
"""


def vertical_cuts(spark: SparkSession, folder: str) -> DataFrame:
    return topology.vertical_cut(lines(spark, folder, *BOX), 6000)


def recursive_cuts(spark: SparkSession, folder: str) -> DataFrame:
    return topology.recursive_cut(lines(spark, folder, *BOX), 6000, 10_000)


def occupied_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The body lines of each page as boxes."""
    own = lines(spark, folder, "text", *BOX, "max_font_size_mpt", "body_eligible").where("body_eligible")
    return own.select(*PAGE, "id", F.lit("line").alias("kind"), F.col("max_font_size_mpt").alias("size"), "text", *BOX)


def page_bands(spark: SparkSession, folder: str) -> DataFrame:
    return bands.document_bands(occupied_boxes(spark, folder)).withColumn("members", F.array_join("members", " "))


def column_anchors(spark: SparkSession, folder: str) -> DataFrame:
    found = topology.column_anchors(lines(spark, folder, "x0"), PAGE, 2000, 20_000)
    return found.select(*PAGE, F.array_join(F.transform("anchors", lambda a: a.cast("string")), ",").alias("anchors"))


def title_lines(spark: SparkSession, folder: str) -> DataFrame:
    return topology.title_lines(lines(spark, folder, "y1", "max_font_size_mpt", "body_eligible"))


TITLE_SQL = f"""
with l as (select * from {LINES_SQL} where page_number = 1 and body_eligible), t as (select doc_id, max(max_font_size_mpt) largest from l group by 1),
b as (select l.*, largest from l join t using (doc_id) where max_font_size_mpt * 10 >= largest * 9), e as (select doc_id, max(y1) edge from b where max_font_size_mpt = largest group by 1)
select doc_id, id from b join e using (doc_id) where edge - y1 <= 4 * largest
"""


def _one_column(own: DataFrame) -> DataFrame:
    """Each page as one band of one column."""
    return own.groupBy(*PAGE).agg(F.lit(1).alias("band"), F.lit(1).alias("column"), F.lit(1).alias("columns"), *union_box())


def _role_lines(spark: SparkSession, folder: str) -> DataFrame:
    own = lines(spark, folder, "text", *BOX, "max_font_size_mpt", "font_names", "body_eligible", "exclusion_kind", "container_kind", "container_id", "confidence_ppm")
    bold = F.exists("font_names", lambda f: F.lower(f).contains("bold"))
    return own.select(*PAGE, "id", "text", *BOX, F.col("max_font_size_mpt").alias("size"), bold.alias("bold"), F.col("body_eligible").alias("eligible"), F.col("exclusion_kind").alias("exclusion"), F.col("container_kind").alias("container"), "container_id", F.col("confidence_ppm").alias("confidence"))


def line_roles(spark: SparkSession, folder: str) -> DataFrame:
    """The role of each line, pages taken as one column."""
    own = _role_lines(spark, folder)
    return roles.page_blocks(own, _one_column(own)).select(*PAGE, F.explode("line_ids").alias("id"), "role")


def merged_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of lines of one role, pages taken as one column."""
    own = _role_lines(spark, folder)
    return roles.page_blocks(own, _one_column(own)).select(*PAGE, "block", "role", "text", F.size("line_ids").cast("long").alias("lines"), *BOX)


def source_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks in the columns of their pages, with the roles that closing sections give them."""
    found = roles.page_blocks(_role_lines(spark, folder), bands.document_bands(occupied_boxes(spark, folder)))
    return roles.closing_sections(found, [*PAGE[1:], "block"]).withColumn("line_ids", F.array_join("line_ids", " "))


def source_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of the blocks that are translated, joined over breaks of column and page."""
    places = cut(bands.document_bands(occupied_boxes(spark, folder)))
    blocks = roles.closing_sections(roles.page_blocks(_role_lines(spark, folder), places), [*PAGE[1:], "block"]).where("required")
    named = units.located(blocks, places).withColumn("id", F.format_string("p%04d-block-%05d", "page_number", "block"))
    made = units.located_units(named, ["doc_id"], ["page_number", "block"])
    return made.select("doc_id", "unit", "text", F.size("blocks").cast("long").alias("blocks"), "confidence_ppm", "needs_review")


def character_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Glyphs that a line names but that are no upright ones of a plain character on its page, and lines that share a place."""
    own = lines(spark, folder, "character_ids").select("doc_id", F.col("id").alias("line_id"), F.explode("character_ids").alias("id"))
    plain = chars(spark, folder, "text", "upright").where(F.col("upright") & F.col("text").rlike(r"^[\x21-\x7e]$"))
    missing = records.orphans(own, plain, ["doc_id", "id"]).groupBy("doc_id").agg(F.count("*").alias("missing"))
    shared = records.repeated_keys(own.select("doc_id", "line_id", F.substring_index("id", "-", -1).alias("place")).distinct(), ["doc_id", "place"]).groupBy("doc_id").agg(F.count("*").alias("shared"))
    both = missing.join(shared, "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


AUDIT_SQL = rf"""
with o as (select doc_id, id line_id, unnest(character_ids) cid from {LINES_SQL}), p as (select distinct doc_id, id from page_char where upright and regexp_matches(text, '^[\x21-\x7e]$')),
m as (select doc_id, count(*) n from o where not exists (select 1 from p where p.doc_id = o.doc_id and p.id = o.cid) group by 1),
s as (select doc_id, count(*) n from (select doc_id, q from (select distinct doc_id, line_id, string_split(cid, '-')[-1] q from o) group by 1, 2 having count(*) > 1) group by 1)
select doc_id, coalesce(m.n, 0) missing, coalesce(s.n, 0) shared from m full join s using (doc_id)
"""


def repeated_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return records.repeated_keys(table(spark, folder, "text_line"), ["doc_id", "id"])


DELIVERIES_SQL = "select doc_id, id, count(*) n from text_line group by 1, 2 having count(*) > 1"

QUERIES = {f.__name__: f for f in (repeated_marginals, interval_union, axis_gaps, gutter_persistence, elementary_intervals, containment_smallest, box_meetings, line_overlaps, reading_order_edges, character_order, line_text_from_characters, line_clusters, text_lines, body_sizes, font_usage, page_fit, column_shares, vertical_cuts, recursive_cuts, page_bands, column_anchors, title_lines, line_roles, merged_blocks, source_blocks, source_units, character_audit, repeated_deliveries)}
SQL = {
    "repeated_marginals": REPEATED_SQL, "interval_union": UNION_SQL, "axis_gaps": GAPS_SQL, "gutter_persistence": PERSISTENCE_SQL, "elementary_intervals": ELEMENTARY_SQL,
    "containment_smallest": CONTAINMENT_SQL, "box_meetings": MEETING_SQL, "line_overlaps": LINE_OVERLAPS_SQL, "reading_order_edges": ORDER_SQL, "character_order": CHARACTER_ORDER_SQL,
    "line_text_from_characters": LINE_TEXT_SQL, "body_sizes": BODY_SQL, "font_usage": FONT_SQL, "page_fit": FIT_SQL, "column_shares": SHARES_SQL, "title_lines": TITLE_SQL, "character_audit": AUDIT_SQL, "repeated_deliveries": DELIVERIES_SQL,
}
