"""Queries over boxes, sets, drafts and limits: the checks that hold derived rows against what they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import text
from quirespark.functions.geometry import bottom_left, box, distance, shared_length, turned, union_box
from quirespark.operators import assembly, extraction, intervals, layout, review, selection, topology
from quirespark.plans.page_plans import BOX, LINES_SQL, PAGE, chars, lines
from quirespark.plans.unit_plans import LEXICON_SQL, SPACES, UNITS_SQL, translation_rows, unit_rows
from quirespark.sources import documents
from quirespark.sources.tables import table


def field_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts of each term in the bounded forms that records keep: given, folded, and as a label."""
    own = table(spark, folder, "glossary").select("term_id", *[text.compact(F.col(c), m, fold=f).alias(n) for n, c, m, f in (("english", "source", 240, False), ("folded", "source", 240, True), ("chinese", "target", 240, False), ("label", "topic", 160, True))])
    return own.withColumn("line", text.content_line(F.col("english"), F.col("chinese")))


FIELDS_SQL = rf"""
with g as (select term_id, trim(regexp_replace(nfc_normalize(source), '{SPACES}+', ' ', 'g')) s, trim(regexp_replace(nfc_normalize(target), '{SPACES}+', ' ', 'g')) t, trim(regexp_replace(nfc_normalize(topic), '{SPACES}+', ' ', 'g')) l from glossary),
f as (select term_id, case when length(s) between 1 and 240 then s end english, case when length(s) between 1 and 240 then replace(replace(lower(s), 'µ', 'μ'), 'ß', 'ss') end folded, case when length(t) between 1 and 240 then t end chinese, case when length(l) between 1 and 160 then replace(replace(lower(l), 'µ', 'μ'), 'ß', 'ss') end label from g)
select *, english || ' — ' || chinese as line from f
"""


def clean_marker_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Hash and length of each document without ligatures and glyph placeholders."""
    made = text.marker_text(F.concat(F.col("text"), F.lit(" (cid:12) 7 (CID:3)x ﬁ")))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.length(made).cast("long").alias("size"), F.sha2(made, 256).alias("hash")).distinct()


CLEAN_SQL = r"""
with t as (select doc_id, replace(replace(replace(replace(replace(text || ' (cid:12) 7 (CID:3)x ﬁ', 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl') t from documents where text is not null),
c as (select doc_id, regexp_replace(regexp_replace(t, '(?i)\(cid:\d+\)\s*\d+', '', 'g'), '(?i)\(cid:\d+\)', '', 'g') t from t)
select distinct doc_id, length(t) size, sha256(t) hash from c
"""


def turned_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Each line's box measured from the page's lower edge and as it stands after a quarter turn for each page number."""
    own = lines(spark, folder, *BOX)
    width, height = F.lit(595_276).cast("long"), F.lit(841_890).cast("long")
    up = bottom_left(box(), height)
    shown = turned(up, (F.col("page_number") % 4) * 90, width, height)
    return own.select("doc_id", "id", *[c.alias(n) for n, c in zip(BOX, shown, strict=True)])


TURNED_SQL = f"""
with l as (select doc_id, id, page_number % 4 q, x0, 841890 - y1 y0, x1, 841890 - y0 y1 from {LINES_SQL})
select doc_id, id, case q when 0 then x0 when 1 then y0 when 2 then 595276 - x1 else 841890 - y1 end x0, case q when 0 then y0 when 1 then 595276 - x1 when 2 then 841890 - y1 else x0 end y0,
  case q when 0 then x1 when 1 then y1 when 2 then 595276 - x0 else 841890 - y0 end x1, case q when 0 then y1 when 1 then 595276 - x0 when 2 then 841890 - y0 else x1 end y1 from l
"""


def neighbour_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """How far each line is from the next one below it, and how much of their widths they share."""
    from pyspark.sql import Window

    down = Window.partitionBy(*PAGE).orderBy(F.desc("y1"), "x0", "id")
    own = lines(spark, folder, *BOX).select("doc_id", "id", *BOX, *[F.lead(c).over(down).alias(f"n_{c}") for c in BOX]).where("n_x0 is not null")
    a, b = box(), box("n_")
    return own.select("doc_id", "id", distance(a[1], a[3], b[1], b[3]).cast("long").alias("away"), shared_length(a[0], a[2], b[0], b[2]).cast("long").alias("shared"))


NEIGHBOURS_SQL = f"""
with n as (select *, lead(x0) over w nx0, lead(y0) over w ny0, lead(x1) over w nx1, lead(y1) over w ny1 from {LINES_SQL} window w as (partition by doc_id, page_number order by y1 desc, x0, id))
select doc_id, id, greatest(0, greatest(y0, ny0) - least(y1, ny1)) away, greatest(0, least(x1, nx1) - greatest(x0, nx0)) shared from n where nx0 is not null
"""


def page_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest box around the lines of each page."""
    return lines(spark, folder, *BOX).groupBy(*PAGE).agg(*union_box())


PAGE_BOXES_SQL = f"select doc_id, page_number, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from {LINES_SQL} group by 1, 2"


def term_clashes(spark: SparkSession, folder: str) -> DataFrame:
    """Units in which the quotes of two of the glossary's terms overlap."""
    from quirespark.plans.unit_plans import term_spans

    spans = term_spans(spark, folder).select("doc_id", F.col("id").alias("unit_id"), F.col("first_at").alias("span_start"), (F.col("first_at") + F.length("term")).alias("span_end"))
    return selection.overlapping_spans(spans, ["doc_id", "unit_id"])


def overlapping_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of terms of one unit that the next quote begins within."""
    from quirespark.plans.unit_plans import term_spans

    spans = term_spans(spark, folder).select("doc_id", F.col("id").alias("unit_id"), F.col("first_at").alias("span_start"), (F.col("first_at") + F.length("term")).cast("long").alias("span_end"))
    return intervals.overlapping_neighbours(spans.distinct(), ["doc_id", "unit_id"], "span_start", "span_end")


def scanned_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose printed area would hide a scan: taken as an image, it covers nine tenths of what its lines lie in."""
    own = lines(spark, folder, "text", *BOX)
    pages = own.groupBy(*PAGE).agg(*union_box())
    images = own.where("page_number % 3 > 0").groupBy(*PAGE).agg(*union_box())
    return extraction.scanned_pages(images, own, pages)


SCANNED_SQL = f"select doc_id, page_number from {LINES_SQL} where page_number % 3 > 0 group by 1, 2 having count(*) >= 5 and sum(length(text)) >= 200"


def mentioned_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and tables that the units of a document mention, with the one unit that a caption of that number is in; numbers
    that more than one unit captions have no target."""
    units = unit_rows(spark, folder, "role", "source_text").where("source_text is not null")
    found = extraction.mentions(units.where("role not like '%caption'"), ["doc_id", "id"], "source_text")
    captions = extraction.mentions(units.where(F.col("role").like("%caption") & extraction.referenced(F.col("source_text"))).select("doc_id", "id", F.substring("source_text", 1, 12).alias("source_text")), ["doc_id", "id"], "source_text")
    targets = extraction.unambiguous(captions.withColumnRenamed("id", "target_id"), ["doc_id", "kind", "number"], "target_id")
    return found.join(targets, ["doc_id", "kind", "number"], "left")


def _mentions_sql(where: str, column: str = "source_text") -> str:
    pattern = r"(?:\b(?:Fig(?:ure)?|Tab(?:le)?)\.?\s*|[图表]\s*)\d+[A-Za-z]?"
    return rf"(select distinct doc_id, id, case when regexp_matches(m, '^(?i:tab|表)') then 'table' else 'figure' end kind, lower(regexp_extract(m, '(\d+[A-Za-z]?)$', 1)) number from (select doc_id, id, unnest(regexp_extract_all({column}, '{pattern}')) m from {UNITS_SQL} where {where}))"


MENTIONS_SQL = f"""
with c as {_mentions_sql("role like '%caption'", "substr(source_text, 1, 12)")}, t as (select doc_id, kind, number, min(id) target_id from c group by 1, 2, 3 having count(distinct id) = 1)
select m.doc_id, m.id, m.kind, m.number, target_id from {_mentions_sql("role not like '%caption'")} m left join t using (doc_id, kind, number)
"""


def glyph_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Glyphs on each page against those that its lines name, and whether the two are near enough."""
    observed = chars(spark, folder).groupBy(*PAGE).agg(F.count("*").alias("observed"))
    expected = lines(spark, folder, "character_ids").groupBy(*PAGE).agg(F.sum(F.size("character_ids")).alias("expected"))
    return assembly.count_bounds(observed, expected, PAGE)


GLYPHS_SQL = f"""
with o as (select doc_id, page_number, count(*) n from (select distinct doc_id, page_number, id from page_char) group by 1, 2), e as (select doc_id, page_number, cast(sum(len(character_ids)) as bigint) n from {LINES_SQL} group by 1, 2),
j as (select doc_id, page_number, coalesce(o.n, 0) observed, coalesce(e.n, 0) expected from o full join e using (doc_id, page_number))
select *, observed * 100 >= expected * 90 and observed * 100 <= expected * 110 and abs(observed - expected) <= 20 good from j
"""


def occupied_space(spark: SparkSession, folder: str) -> DataFrame:
    """What takes up space on each page: body lines, captions' lines as graphics, and rules drawn under every third line."""
    own = lines(spark, folder, *BOX, "body_eligible", "container_kind")
    graphics_ = own.where("not body_eligible").select(*PAGE, F.concat(F.lit("g-"), "id").alias("id"), *BOX)
    rules = own.where("(x1 - x0) > 150000").select(*PAGE, F.concat(F.lit("r-"), "id").alias("id"), "x0", (F.col("y0") - 1000).alias("y0"), "x1", F.col("y0").alias("y1"))
    widths = own.select(*PAGE).distinct().withColumn("width", F.lit(595_276))
    return topology.occupied(own, graphics_, rules, widths).groupBy(*PAGE, "origin").agg(F.count("*").alias("n"), F.sum(F.col("x1") - F.col("x0")).alias("wide"))


OCCUPIED_SQL = f"""
with l as (select * from {LINES_SQL}), g as (select doc_id, page_number, x0, y0, x1, y1 from l where not body_eligible),
r as (select doc_id, page_number, id, x0, y0 - 1000 y0, x1, y0 y1 from l where x1 - x0 > 150000 and (x1 - x0) * 2 >= 595276),
k as (select * from r where not exists (select 1 from g where g.doc_id = r.doc_id and g.page_number = r.page_number and r.x0 >= g.x0 and r.y0 >= g.y0 and r.x1 <= g.x1 and r.y1 <= g.y1)),
a as (select doc_id, page_number, 'line' origin, x1 - x0 w from l where body_eligible union all select doc_id, page_number, 'graphic', x1 - x0 from g union all select doc_id, page_number, 'rule', x1 - x0 from k)
select doc_id, page_number, origin, count(*) n, cast(sum(w) as bigint) wide from a group by 1, 2, 3
"""


def line_thirds(spark: SparkSession, folder: str) -> DataFrame:
    """The third of its page (by occupied height, from the top) that each line shares most of its height with."""
    own = lines(spark, folder, "y0", "y1")
    height = own.groupBy(*PAGE).agg(F.min("y0").alias("low"), F.max("y1").alias("high"))
    step = F.call_function("div", F.col("high") - F.col("low"), F.lit(3).cast("long"))
    bands = height.withColumn("step", step).select(*PAGE, F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("band_id"), (F.col("high") - (k + 1) * F.col("step")).alias("y0"), (F.col("high") - k * F.col("step")).alias("y1")) for k in range(3)])).alias("b")).select(*PAGE, "b.*")
    return topology.assigned(own, bands, PAGE).select("doc_id", "id", "band_id")


THIRDS_SQL = f"""
with l as (select * from {LINES_SQL}), h as (select doc_id, page_number, max(y1) high, (max(y1) - min(y0)) // 3 s from l group by 1, 2),
b as (select doc_id, page_number, k, high - (k + 1) * s by0, high - k * s by1 from h, (select unnest([0, 1, 2]) k)),
m as (select l.doc_id, l.page_number, l.id, min(row(-greatest(0, least(y1, by1) - greatest(y0, by0)), abs(y0 + y1 - by0 - by1), k)) m from l join b using (doc_id, page_number) group by 1, 2, 3)
select doc_id, id, cast(m[3] as bigint) band_id from m
"""


def drafted_units(spark: SparkSession, folder: str) -> DataFrame:
    """What keeps a draft out: renderings as drafts, each with its first term as the quote and the place of that term among
    its like as the occurrence."""
    units = unit_rows(spark, folder, "source_text").select("doc_id", F.col("id").alias("unit_id"), "source_text")
    drafts = table(spark, folder, "translation").select("doc_id", "unit_id", F.col("chinese_text").alias("target_text"), F.get("terminology", F.lit(0))["source"].alias("quote"), (F.length("unit_id") % 6).alias("occurrence"))
    good, problems = assembly.assembled(units, drafts)
    return problems.unionByName(good.where("quote is not null").select("doc_id", "unit_id", F.concat(F.lit("at "), F.col("quote_start").cast("string")).alias("problem")))


DRAFTS_SQL = f"""
with recursive u as (select distinct doc_id, id unit_id, source_text from semantic_unit), d as (select doc_id, unit_id, chinese_text, terminology[1].source q, length(unit_id) % 6 n from translation),
c as (select doc_id, unit_id, count(*) k from d group by 1, 2),
p as (select doc_id, unit_id, case when k is null then 'missing' when source_text is null then 'unknown' when k > 1 then 'repeated' end problem from u full join c using (doc_id, unit_id)),
s as (select d.doc_id, d.unit_id, q, n, source_text from d join c using (doc_id, unit_id) join u using (doc_id, unit_id) where k = 1 and source_text is not null and q is not null),
f as (select doc_id, unit_id, q, n, source_text, 0 i, strpos(source_text, q) a from s
  union all select doc_id, unit_id, q, n, source_text, i + 1, case when strpos(substr(source_text, a + 1), q) > 0 then a + strpos(substr(source_text, a + 1), q) else 0 end from f where i < n and a > 0),
e as (select s.doc_id, s.unit_id, max(case when f.i = f.n and f.a > 0 then f.a end) a from s join f using (doc_id, unit_id) group by 1, 2)
select * from p where problem is not null union all select doc_id, unit_id, case when a is null then 'quote' else 'at ' || (a - 1) end from e
"""


def unresolved_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Losses of words that no waiver names; waivers are given for every loss of units whose number is even."""
    from quirespark.plans.unit_plans import lexicon_losses

    own = review.issue_hashes(lexicon_losses(spark, folder).select("doc_id", "unit_id", F.col("lost").alias("category"), F.array("lost").alias("source_markers"), F.array().cast("array<string>").alias("target_markers")))
    waived = own.where(F.length("unit_id") % 2 == 0).select("doc_id", "issue_hash")
    return review.unresolved(own, waived).select("doc_id", "unit_id", "category", "issue_hash")


UNRESOLVED_SQL = f"""
select doc_id, unit_id, lost category, sha256('{{"category":' || to_json(lost) || ',"source_markers":[' || to_json(lost) || '],"target_markers":[],"unit_id":' || to_json(unit_id) || '}}') issue_hash from ({LEXICON_SQL}) where length(unit_id) % 2 <> 0
"""


def ambiguity_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A key for each term that the glossary renders in more than one way: its facts and its renderings in any order."""
    own = table(spark, folder, "glossary").where("source is not null and target is not null").groupBy(F.lower(F.trim("source")).alias("term")).agg(F.collect_list("target").alias("meanings"), F.min("topic").alias("topic"))
    return review.ambiguity_key(own.withColumn("meanings", F.concat("meanings", F.array(F.lit("other")))), "meanings", "term", "topic").select("term", "ambiguity_key")


AMBIGUITY_SQL = r"""
with g as (select lower(trim(source)) term, list(target) m, min(topic) topic from glossary where source is not null and target is not null group by 1),
k as (select term, list_sort(list_distinct(list_transform(list_append(m, 'other'), lambda x: lower(trim(x))))) m, lower(trim(regexp_replace(term, '\s+', ' ', 'g'))) a, lower(trim(regexp_replace(topic, '\s+', ' ', 'g'))) b from g)
select term, case when len(m) >= 2 and length(a) between 1 and 240 and length(b) between 1 and 240 then sha256('{"fact0_":' || to_json(a) || ',"fact1_":' || to_json(b) || ',"meanings_":' || to_json(m) || '}') end ambiguity_key from k
"""


def review_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents pass if none of their spans is out of range or order; spans that end short are resolved."""
    from quirespark.plans.unit_plans import span_problems

    issues = span_problems(spark, folder).select("doc_id", F.when(F.col("problem") == "none", "warning").otherwise("hard_error").alias("severity"), (F.col("problem") == "end").alias("resolved"))
    return review.review_gate(unit_rows(spark, folder), issues.unionByName(table(spark, folder, "translation").where("chinese_text is null").select("doc_id", F.lit("hard_error").alias("severity"), F.lit(None).cast("boolean").alias("resolved"))))


def frozen_terms(spark: SparkSession, folder: str) -> DataFrame:
    """One hash of the terms of each document, whatever their order and repetition."""
    each = translation_rows(spark, folder, "terminology").select("doc_id", F.explode("terminology").alias("t")).select("doc_id", "t.source", "t.target")
    return assembly.frozen(each, "doc_id", ["target", "source"])


FROZEN_SQL = """
with t as (select distinct doc_id, unit_id, terminology from translation), e as (select doc_id, unnest(terminology) x from t), h as (select distinct doc_id, sha256('{"source":' || to_json(x.source) || ',"target":' || to_json(x.target) || '}') h from e)
select doc_id, count(*) n, sha256(string_agg(h, '' order by h)) set_hash from h group by 1
"""


def repeated_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Values that more than one term of a topic has where each must be unique."""
    own = table(spark, folder, "glossary").where("topic is not null")
    return assembly.repeated_candidates(own, "topic", ["source", "target"])


REPEATED_TERMS_SQL = "select topic, field, value, count(*) n from (select topic, 'source' field, lower(source) as value from glossary union all select topic, 'target', lower(target) from glossary) where topic is not null and value is not null group by 1, 2, 3 having count(*) > 1"


def limits_passed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents over the limits of units, characters and headings."""
    own = unit_rows(spark, folder, "role", "source_text")
    return assembly.over_limits(own, ["doc_id"], {"units": (F.lit(1), 10), "characters": (F.length("source_text"), 3000), "headings": (F.when(F.col("role") == "heading", 1).otherwise(0), 2)})


LIMITS_SQL = f"""
with s as (select doc_id, count(*) u, cast(sum(length(source_text)) as bigint) c, cast(sum(case when role = 'heading' then 1 else 0 end) as bigint) h from {UNITS_SQL} group by 1),
l as (select doc_id, unnest(['units', 'characters', 'headings']) as "limit", unnest([u, c, h]) observed, unnest([cast(10 as bigint), 3000, 2]) maximum from s)
select * from l where observed > maximum
"""


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Renderings with a label spliced in behind each of their terms."""
    own = translation_rows(spark, folder, "chinese_text", "terminology").where("chinese_text is not null")
    marks = F.transform("terminology", lambda t: F.struct(t["target_end"].alias("at"), F.concat(F.lit("["), t["source"], F.lit("]")).alias("label")))
    made = assembly.inserted(own.withColumn("marks", marks), "chinese_text", "marks")
    return made.where("size(terminology) > 0").select("doc_id", "unit_id", "composite")


LABELLED_SQL = """
with recursive t as (select distinct doc_id, unit_id, chinese_text c, terminology m from translation where chinese_text is not null and len(terminology) > 0),
k as (select doc_id, unit_id, c, list_sort(list_transform(m, lambda x: struct_pack(a := least(x.target_end, length(c)), l := '[' || x.source || ']'))) m from t),
f as (select doc_id, unit_id, c, m, 0 i, cast(0 as bigint) d, '' o from k union all
  select doc_id, unit_id, c, m, i + 1, m[i + 1].a, o || substr(c, d + 1, m[i + 1].a - d) || m[i + 1].l from f where i < len(m))
select doc_id, unit_id, o || substr(c, d + 1) composite from f where i = len(m)
"""


def wrong_page_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose printed area, as the crop box, doesn't lie in a page of the usual size with margins, or is turned oddly."""
    own = lines(spark, folder, *BOX).groupBy(*PAGE).agg(*union_box())
    pages = own.select(*PAGE, *[F.col(c).alias(f"c_{c}") for c in BOX], *[F.lit(v).cast("long").alias(f"m_{c}") for c, v in zip(BOX, (60_000, 90_000, 540_000, 780_000), strict=True)], ((F.col("page_number") % 5) * 45).alias("rotation"))
    return assembly.page_box_problems(pages).select(*PAGE, "problem")


PAGE_PROBLEMS_SQL = f"""
with p as (select doc_id, page_number, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from {LINES_SQL} group by 1, 2)
select * from (select doc_id, page_number, case when not (x0 < x1 and y0 < y1) then 'empty' when not (x0 >= 60000 and y0 >= 90000 and x1 <= 540000 and y1 <= 780000) then 'outside' when (page_number % 5) * 45 % 90 <> 0 then 'rotation' end problem from p) where problem is not null
"""


def tail_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of a document's units against those of its annotation index, laid together from their ends."""
    planned = unit_rows(spark, folder, "reading_order", "role")
    drawn = table(spark, folder, "annotation_index").where("target_text is not null").select("doc_id", "unit_id", F.col("unit_order").alias("reading_order"), F.col("unit_role").alias("role")).distinct()
    return assembly.aligned_tails(planned, drawn, "doc_id", "reading_order", "role")


TAILS_SQL = f"""
with p as (select doc_id, role, row_number() over (partition by doc_id order by reading_order desc) k from {UNITS_SQL}),
d as (select doc_id, r, row_number() over (partition by doc_id order by unit_order desc) k from (select distinct doc_id, unit_id, unit_order, unit_role r from annotation_index where target_text is not null))
select p.doc_id, p.k from_end, p.role planned, d.r drawn from p left join d using (doc_id, k) where p.role is distinct from d.r
"""


def strict_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of events as strict JSON; every eleventh text is broken in one of four ways."""
    props = F.when(F.col("event_id") % 44 == 0, "{").when(F.col("event_id") % 44 == 11, '{"k": 1, "k": 2}').when(F.col("event_id") % 44 == 22, '{"k": NaN}').when(F.col("event_id") % 44 == 33, "[1]").otherwise(F.col("props"))
    own = documents.strict_json(table(spark, folder, "events").withColumn("given", props), "given", "k long")
    return own.groupBy("bad", F.when(~F.col("bad"), F.col("value.k")).alias("k")).agg(F.count("*").alias("n"))


STRICT_SQL = "select event_id % 11 = 0 or props is null bad, case when event_id % 11 <> 0 then cast(json_extract_string(props, '$.k') as bigint) end k, count(*) n from events group by 1, 2"


def canonical_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of each term's one JSON text; texts in normal form C."""
    own = documents.normal_strings(table(spark, folder, "glossary").select("term_id", "source", "target", "topic"))
    return own.select("term_id", documents.canonical_hash("topic", "term_id", "source", "target").alias("hash"))


CANONICAL_SQL = """
select term_id, sha256('{"source":' || coalesce(to_json(nfc_normalize(source)), 'null') || ',"target":' || coalesce(to_json(nfc_normalize(target)), 'null') || ',"term_id":' || term_id || ',"topic":' || coalesce(to_json(nfc_normalize(topic)), 'null') || '}') hash from glossary
"""


def vertical_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Underlines of all glyphs, merged to rules where they touch."""
    under = chars(spark, folder, *BOX).select(*PAGE, "id", "x0", F.col("y0"), "x1", (F.col("y0") + 500).alias("y1"))
    return extraction.merged_rules(under, PAGE, touch=6000, least=20_000).select(*PAGE, *BOX)


RULES_SQL = """
with v as (select distinct doc_id, page_number, id, x0, y0, x1, y0 + 500 y1, (y0 + y0 + 500) // 2 y from page_char where x1 > x0),
a as (select *, sum(f) over (partition by doc_id, page_number order by y, x0, id rows unbounded preceding) lv from (select *, case when y - lag(y) over (partition by doc_id, page_number order by y, x0, id) > 250 then 1 else 0 end f from v)),
r as (select *, max(x1) over (partition by doc_id, page_number, lv order by x0, x1 rows between unbounded preceding and 1 preceding) reach from a),
p as (select *, sum(case when x0 > reach + 6000 then 1 else 0 end) over (partition by doc_id, page_number, lv order by x0, x1 rows unbounded preceding) part from r)
select doc_id, page_number, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from p group by doc_id, page_number, lv, part having max(x1) - min(x0) >= 20000
"""


def line_components(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of lines that lie within 7 000 of one another, directly or over others, by their least id."""
    found = extraction.box_components(lines(spark, folder, *BOX), PAGE, tolerance=7000)
    return found.groupBy(*PAGE, "component").agg(F.count("*").alias("members"))


COMPONENTS_SQL = f"""
with recursive l as (select * from {LINES_SQL}),
e as (select a.doc_id, a.page_number, a.id a, b.id b from l a join l b on a.doc_id = b.doc_id and a.page_number = b.page_number and a.x0 <= b.x1 + 7000 and b.x0 <= a.x1 + 7000 and a.y0 <= b.y1 + 7000 and b.y0 <= a.y1 + 7000),
r as (select doc_id, page_number, a, b from e union select r.doc_id, r.page_number, r.a, e.b from r join e on e.doc_id = r.doc_id and e.page_number = r.page_number and e.a = r.b),
c as (select doc_id, page_number, a, min(b) component from r group by 1, 2, 3)
select doc_id, page_number, component, count(*) members from c group by 1, 2, 3
"""


def nearest_body_lines(spark: SparkSession, folder: str) -> DataFrame:
    """For each line outside the body the nearest body line above or below it that shares some of its width."""
    own = lines(spark, folder, *BOX, "body_eligible")
    return extraction.nearest_box(own.where("not body_eligible"), own.where("body_eligible"), PAGE)


NEAREST_SQL = f"""
with l as (select * from {LINES_SQL}),
p as (select a.doc_id, a.page_number, a.id caption_id, greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) away, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) shared, b.id region from l a join l b on a.doc_id = b.doc_id and a.page_number = b.page_number and not a.body_eligible and b.body_eligible),
m as (select doc_id, page_number, caption_id, min(row(away, -shared, region)) m from p where away <= 50000 and shared > 0 group by 1, 2, 3)
select doc_id, page_number, caption_id, m[3] region_id, m[1] away from m
"""


def grapheme_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many clusters of characters each rendering has; marks, selectors and joiners stay with what they follow."""
    own = translation_rows(spark, folder, "chinese_text").where("chinese_text is not null")
    given = F.concat("chinese_text", F.lit("é❤️\U0001f1e8\U0001f1f3"))
    return own.select("doc_id", "unit_id", F.size(layout.grapheme_clusters(given)).cast("long").alias("clusters"))


GRAPHEMES_SQL = "select distinct doc_id, unit_id, length(regexp_replace(chinese_text, '[\\x{300}-\\x{36f}\\p{Mc}\\p{Me}\\x{200d}\\x{fe00}-\\x{fe0f}\\x{64b}-\\x{652}\\x{93c}\\x{94d}\\x{951}-\\x{954}\\x{e38}-\\x{e3a}\\x{e48}-\\x{e4b}]', '', 'g')) + 3 clusters from translation where chinese_text is not null"


def cut_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of which an end would lie inside a cluster, once a mark follows every term."""
    own = translation_rows(spark, folder, "chinese_text", "terminology").where("chinese_text is not null").select("doc_id", "unit_id", "chinese_text", F.posexplode("terminology").alias("k", "t"))
    spans = own.select("doc_id", "unit_id", F.col("k").cast("long").alias("k"), F.concat(F.expr("substring(chinese_text, 1, t.target_end)"), F.lit("́"), F.expr("substring(chinese_text, t.target_end + 1)")).alias("marked"), F.col("t.target_start").alias("a"), F.col("t.target_end").alias("b"))
    return assembly.split_graphemes(spans, "marked", "a", "b").select("doc_id", "unit_id", "k", "a", "b")


CUT_SQL = """
with t as (select distinct doc_id, unit_id, terminology from translation where chinese_text is not null)
select doc_id, unit_id, cast(generate_subscripts(terminology, 1) - 1 as bigint) k, unnest(terminology).target_start a, unnest(terminology).target_end b from t
"""

QUERIES = {f.__name__: f for f in (field_forms, clean_marker_texts, turned_boxes, neighbour_gaps, page_boxes, term_clashes, overlapping_terms, scanned_pages, mentioned_targets, glyph_counts, occupied_space, line_thirds, drafted_units, unresolved_losses, ambiguity_keys, review_gates, frozen_terms, repeated_terms, limits_passed, labelled_texts, wrong_page_boxes, tail_differences, strict_properties, canonical_rows, vertical_rules, line_components, nearest_body_lines, grapheme_sizes, cut_clusters)}
SQL = {
    "field_forms": FIELDS_SQL, "clean_marker_texts": CLEAN_SQL, "turned_boxes": TURNED_SQL, "neighbour_gaps": NEIGHBOURS_SQL, "page_boxes": PAGE_BOXES_SQL, "scanned_pages": SCANNED_SQL, "mentioned_targets": MENTIONS_SQL,
    "glyph_counts": GLYPHS_SQL, "occupied_space": OCCUPIED_SQL, "line_thirds": THIRDS_SQL, "drafted_units": DRAFTS_SQL, "ambiguity_keys": AMBIGUITY_SQL, "frozen_terms": FROZEN_SQL, "repeated_terms": REPEATED_TERMS_SQL,
    "limits_passed": LIMITS_SQL, "labelled_texts": LABELLED_SQL, "wrong_page_boxes": PAGE_PROBLEMS_SQL, "tail_differences": TAILS_SQL, "strict_properties": STRICT_SQL, "canonical_rows": CANONICAL_SQL, "vertical_rules": RULES_SQL,
    "line_components": COMPONENTS_SQL, "grapheme_sizes": GRAPHEMES_SQL, "nearest_body_lines": NEAREST_SQL, "unresolved_losses": UNRESOLVED_SQL, "cut_clusters": CUT_SQL,
}
