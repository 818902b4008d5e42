"""Queries over semantic units, their renderings, terms and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import markers, text
from quirespark.functions.geometry import mpt
from quirespark.operators import intervals, layout, records, review, selection, topology, units
from quirespark.sources.tables import spread, table

SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PAIRS_SQL = "(select distinct u.doc_id, u.id unit_id, u.source_text, t.chinese_text target_text from semantic_unit u join translation t on t.doc_id = u.doc_id and t.unit_id = u.id)"
UNITS_SQL = "(select distinct doc_id, id, role, reading_order, source_text, confidence_ppm from semantic_unit)"


def unit_rows(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "semantic_unit").select("doc_id", "id", *columns).distinct()


def translation_rows(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """translation, each unit once (rows delivered twice are equal)."""
    return table(spark, folder, "translation").select("doc_id", "unit_id", *columns).dropDuplicates(["doc_id", "unit_id"])


def pair_rows(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, unit_id, source_text, target_text of the units that have a rendering."""
    own = unit_rows(spark, folder, "source_text").withColumnRenamed("id", "unit_id")
    other = table(spark, folder, "translation").select("doc_id", "unit_id", F.col("chinese_text").alias("target_text"))
    return own.join(other, ["doc_id", "unit_id"]).distinct()


def compact_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as one line, with its hash; null where that is empty, too long or holds a control character."""
    own = table(spark, folder, "documents").select("doc_id", text.compact(F.col("text"), 240).alias("line"))
    return own.select("doc_id", "line", F.sha2("line", 256).alias("hash"))


COMPACT_SQL = rf"""
with c as (select doc_id, trim(regexp_replace(nfc_normalize(text), '{SPACES}+', ' ', 'g')) as s from documents),
v as (select doc_id, case when length(s) between 1 and 240 and not regexp_matches(s, '[\x{{00}}-\x{{1f}}\x{{7f}}-\x{{9f}}]') then s end as line from c)
select doc_id, line, sha256(line) hash from v
"""


def visible_characters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.visible_characters(F.col("text")).alias("visible"))


VISIBLE_SQL = rf"select doc_id, length(regexp_replace(text, '[\p{{P}}]|{SPACES}', '', 'g')) visible from documents"


def language_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Characters, letters and the share of ASCII letters of each source, and the first check that it fails."""
    t = F.col("text")
    sums = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("pages"), *[F.sum(f(t)).alias(n) for n, f in (("solid", text.solid_characters), ("letters", text.letters), ("ascii", text.ascii_letters))])
    share = text.floor_share(F.col("ascii"), F.col("letters"))
    failed = records.first_failure({"TOO_FEW_CHARACTERS": F.col("solid") >= 40 * F.col("pages"), "TOO_FEW_LETTERS": F.col("letters") >= 20 * F.col("pages"), "NOT_ENGLISH": share >= 500_000})
    return sums.select("source", "pages", "solid", "letters", share.alias("ascii_ppm"), failed.alias("failed"))


LANGUAGE_SQL = rf"""
with s as (select source, count(*) pages, cast(sum(length(regexp_replace(text, '{SPACES}', '', 'g'))) as bigint) solid, cast(sum(length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))) as bigint) as letters,
  cast(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) as bigint) a from documents group by 1),
p as (select *, case when letters = 0 then 0 else a * 1000000 // letters end ppm from s)
select source, pages, solid, letters, ppm ascii_ppm, case when not coalesce(solid >= 40 * pages, false) then 'TOO_FEW_CHARACTERS' when not coalesce(letters >= 20 * pages, false) then 'TOO_FEW_LETTERS' when not coalesce(ppm >= 500000, false) then 'NOT_ENGLISH' end failed from p
"""


def token_sets(spark: SparkSession, folder: str) -> DataFrame:
    own = unit_rows(spark, folder, "source_text")
    words = text.tokens(F.col("source_text"))
    return own.select("doc_id", "id", F.size(words).cast("long").alias("n"), F.array_join(words, "|").alias("tokens"))


TOKENS_SQL = rf"""
with t as (select doc_id, id, list_sort(list_distinct(regexp_extract_all(lower(source_text), '[\p{{L}}\p{{N}}]+(?:[-''][\p{{L}}\p{{N}}]+)*'))) w from {UNITS_SQL})
select doc_id, id, cast(len(w) as bigint) n, array_to_string(w, '|') tokens from t
"""


def heading_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of one document that are compatible contexts: equal, or two thirds of the smaller one's words in common.

    Two such headings share one of the smaller one's first words, as many as a third and one more, so they meet on a document's
    words and not on the document.
    """
    own = unit_rows(spark, folder, "source_text", "role").where("role = 'heading'").select("doc_id", "id", text.tokens(F.col("source_text")).alias("w"))
    size = F.size("w")
    first = F.when(size > 0, F.slice("w", F.lit(1), size - F.ceil(size * 2 / 3).cast("int") + 1)).otherwise(F.array(F.lit("")))
    rare = own.select("doc_id", F.col("id").alias("a"), F.explode(first).alias("word"))
    every = own.select("doc_id", F.col("id").alias("b"), F.explode(F.when(size > 0, F.col("w")).otherwise(F.array(F.lit("")))).alias("word"))
    met = rare.join(every, ["doc_id", "word"]).where("a <> b").select("doc_id", F.least("a", "b").alias("id"), F.greatest("a", "b").alias("other")).distinct()
    both = met.join(own, ["doc_id", "id"]).join(own.select("doc_id", F.col("id").alias("other"), F.col("w").alias("v")), ["doc_id", "other"])
    return both.where(text.token_overlap(F.col("w"), F.col("v"))).select("doc_id", "id", "other")


OVERLAPS_SQL = rf"""
with h as (select doc_id, id, list_distinct(regexp_extract_all(lower(source_text), '[\p{{L}}\p{{N}}]+(?:[-''][\p{{L}}\p{{N}}]+)*')) w from {UNITS_SQL} where role = 'heading')
select a.doc_id, a.id, b.id other from h a join h b on a.doc_id = b.doc_id and a.id < b.id
where list_sort(a.w) = list_sort(b.w) or (least(len(a.w), len(b.w)) >= 2 and len(list_intersect(a.w, b.w)) * 3 >= least(len(a.w), len(b.w)) * 2)
"""


def topic_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The tags that the glossary's terms give to each topic and first letter: last words, null if they are more than 8."""
    own = table(spark, folder, "glossary").where("source is not null").withColumn("tag", F.substring_index(F.trim(F.lower("source")), " ", -1))
    kept = own.groupBy("topic", F.substring("tag", 1, 1).alias("letter")).agg(F.collect_list("tag").alias("tags"))
    return kept.select("topic", "letter", F.array_join(text.tag_set(F.col("tags")), "|").alias("tags"), F.size(F.array_distinct("tags")).cast("long").alias("n"))


TAGS_SQL = r"""
with g as (select topic, string_split(trim(lower(source)), ' ')[-1] tag from glossary where source is not null), t as (select topic, substr(tag, 1, 1) letter, list_sort(list_distinct(list(tag))) t from g group by 1, 2)
select topic, letter, case when len(t) <= 8 then array_to_string(t, '|') end tags, len(t) n from t
"""


def number_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of each unit in one form, each once, without those of citations and identifiers."""
    return unit_rows(spark, folder, "source_text").select("doc_id", "id", F.array_join(markers.marker_column("number")(F.col("source_text")), "|").alias("numbers"))


#: The SQL engine lacks look-arounds: the character before a match is matched with it instead.
NUMBERS_SQL = rf"""
with u as (select doc_id, id, source_text t from {UNITS_SQL}),
d as (select *, list_transform(regexp_extract_all(' ' || t || ' ', '[^A-Za-z0-9]((?:1\d|20)\d0)s[^A-Za-z0-9]', 1), lambda x: x || 's') dec, regexp_replace(' ' || t || ' ', '([^A-Za-z0-9])(?:1\d|20)\d0s([^A-Za-z0-9])', '\1   \2', 'g') t1 from u),
c as (select *, regexp_replace(t1, '\[[0-9,;\s–—-]+\]|\([A-Z][^()]{{0,80}}?(?:19|20)\d{{2}}[a-z]?[^()]*\)', ' ', 'g') t2 from d),
i as (select *, regexp_replace(t2, '(?i)([^A-Za-z0-9])[A-Za-z][A-Za-z0-9]*-\s*\d+(?:[\s,，、和及]*(?:(?:and|or)\b[\s,，、]*)?-\s*\d+)+', '\1 ', 'g') t3 from c),
k as (select *, regexp_replace(t3, '([^A-Za-z0-9])(?:[A-Za-z][A-Za-z0-9]*(?:[-/]\s*[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*)*[-/]\s*[A-Za-z]*\d[A-Za-z0-9]*(?:[-/]\s*[A-Za-z0-9]+)*|[A-Za-z]+\d[A-Za-z0-9]*(?:[-/]\s*[A-Za-z0-9]+)+)', '\1 ', 'g') t4 from i),
n as (select *, regexp_extract_all(t4, '[^A-Za-z0-9_.]((?:[+−]|-)?(?:\d+(?:,\d{{3}})*(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?)', 1) m from k)
select doc_id, id, array_to_string(list_sort(list_distinct(list_concat(dec, list_transform(m, lambda x: regexp_replace(replace(replace(x, ',', ''), '−', '-'), '^([+-]?)\.', '\10.'))))), '|') numbers from n
"""


def reference_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and tables that each unit and its rendering refer to, and whether they are the same ones."""
    own = pair_rows(spark, folder)
    a, b = markers.figure_tables(F.col("source_text")), markers.figure_tables(F.col("target_text"))
    return own.select("doc_id", "unit_id", F.array_join(a, "|").alias("source_refs"), F.array_join(b, "|").alias("target_refs"), (a == b).alias("same"))


def _refs(column: str) -> str:
    one = "(case when regexp_matches(x, '(?i)^(?:table|表)') then 'table:' else 'figure:' end) || lower(regexp_extract(x, '([0-9]+[A-Za-z]?)$', 1))"
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({column}, '(?i)(?:(?:Fig(?:ure)?|Table)\\.?\\s*[0-9]+[A-Za-z]?|[图表]\\s*[0-9]+[A-Za-z]?)'), lambda x: {one})))"


REFERENCES_SQL = f"with r as (select doc_id, unit_id, {_refs('source_text')} a, {_refs('target_text')} b from {PAIRS_SQL}) select doc_id, unit_id, array_to_string(a, '|') source_refs, array_to_string(b, '|') target_refs, a = b same from r"

LEXICON = {**markers.DIRECTION, **markers.NEGATION, **markers.DEGREE, **markers.LOGIC}


def lexicon_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of words that a unit holds and its rendering does not."""
    own = pair_rows(spark, folder).where("target_text is not null")
    find = markers.classes(LEXICON)
    lost = F.array_except(find(F.col("source_text")), find(F.col("target_text")))
    return own.select("doc_id", "unit_id", F.explode(lost).alias("lost"))


#: Patterns with look-arounds as the SQL engine can say them, on a text in which what they exclude is taken out before.
_PLAIN = {
    r"\bnot\b(?!\s+only\b)": r"\bnot\b", r"可能(?!性)": "可能", r"而(?=[A-Za-zͰ-Ͽ])|而(?!且|后|今)(?=[㐀-鿿])": "而[A-Za-zͰ-Ͽ㐀-鿿]",
    r"与(?:[^。！？.!?]|(?<=\d)\.(?=\d)){0,120}相比": "与[^。！？.!?]{0,120}相比",
    r"(?<!比)较(?=[^。！？.!?]{0,20}(?:增加|减少|升高|降低|高|低|多|少|大|小))": "较[^。！？.!?]{0,20}(?:增加|减少|升高|降低|高|低|多|少|大|小)",
}


def _lexicon_sql() -> str:
    clean = r"regexp_replace(regexp_replace({}, '(?i)\bnot\s+only\b|可能性|而且|而后|而今|比较', '#', 'g'), '(\d)\.(\d)', '\1,\2', 'g')"
    parts = []
    for name, pattern in LEXICON.items():
        for given, form in _PLAIN.items():
            pattern = pattern.replace(given, form)
        parts.append(f"select doc_id, unit_id, '{name}' lost from p where regexp_matches(s, '(?i)(?:{pattern})') and not regexp_matches(t, '(?i)(?:{pattern})')")
    return f"with p as (select doc_id, unit_id, {clean.format('source_text')} s, {clean.format('target_text')} t from {PAIRS_SQL} where target_text is not null) " + " union all ".join(parts)


LEXICON_SQL = _lexicon_sql()


def mechanical_check(spark: SparkSession, folder: str) -> DataFrame:
    """All eleven categories; the lookarounds have no counterpart in the SQL engine, so literal cases test them."""
    found = review.issue_hashes(review.mechanical_check(spread(pair_rows(spark, folder), "doc_id", "unit_id")))
    return found.select("doc_id", "unit_id", "category", F.array_join("source_markers", "|").alias("source_markers"), F.array_join("target_markers", "|").alias("target_markers"), "issue_hash")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    own = unit_rows(spark, folder, "source_text")
    return own.select("doc_id", "id", F.explode(markers.citations(F.col("source_text"))).alias("citation"))


CITATIONS_SQL = rf"""
select distinct doc_id, id, translate(regexp_replace(c, '\s+', '', 'g'), '—（），；', '–(),;') citation
from (select doc_id, id, unnest(regexp_extract_all(source_text, '\[[0-9,;\s–—-]+\]|\([A-Z][^()]{{0,80}}?(?:19|20)\d{{2}}[a-z]?[^()]*\)|（[A-Z][^（）]{{0,80}}?(?:19|20)\d{{2}}[a-z]?[^（）]*）')) c from {UNITS_SQL})
"""


def term_spans(spark: SparkSession, folder: str) -> DataFrame:
    """First and second place of the document's topical terms in each unit (0-based; null where there is none).

    Units meet only the terms whose last word (letters and digits of any script) they hold as a word.
    """
    own = unit_rows(spark, folder, "source_text")
    terms = table(spark, folder, "glossary").select(F.lower(F.trim("source")).alias("term")).distinct()
    terms = terms.withColumn("word", F.element_at(F.regexp_extract_all("term", F.lit(TERM_WORD), F.lit(0)), -1)).where("word is not null")
    words = own.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("source_text"), F.lit(TERM_WORD), F.lit(0)))))
    met = words.join(terms, "word").withColumn("low", F.lower("source_text"))
    placed = met.select("doc_id", "id", "term", text.nth_position(F.col("low"), F.col("term")).alias("first_at"), text.nth_position(F.col("low"), F.col("term"), 1).alias("second_at"))
    return placed.where("first_at is not null")


TERM_WORD = r"[\p{L}\p{N}]+"
TERMS_SQL = rf"""
with t as (select distinct lower(trim(source)) term, regexp_extract_all(lower(trim(source)), '{TERM_WORD}')[-1] word from glossary), u as (select doc_id, id, lower(source_text) s from {UNITS_SQL}),
m as (select u.*, term, strpos(s, term) a from u join t on strpos(s, term) > 0 and word is not null and list_contains(regexp_extract_all(s, '{TERM_WORD}'), word))
select doc_id, id, term, a - 1 first_at, case when strpos(substr(s, a + 1), term) > 0 then a + strpos(substr(s, a + 1), term) - 1 end second_at from m
"""


def running_offsets(spark: SparkSession, folder: str) -> DataFrame:
    own = unit_rows(spark, folder, "reading_order", "source_text")
    return units.running_offsets(own, ["doc_id"], ["reading_order", "id"], "source_text").select("doc_id", "id", "char_start", "char_end")


OFFSETS_SQL = f"select doc_id, id, cast(e - coalesce(length(source_text), 0) as bigint) char_start, cast(e as bigint) char_end from (select *, sum(coalesce(length(source_text), 0)) over (partition by doc_id order by reading_order, id rows unbounded preceding) e from {UNITS_SQL})"


def section_states(spark: SparkSession, folder: str) -> DataFrame:
    """Number of headings so far, whether the last one speaks of results, and whether any has."""
    own = unit_rows(spark, folder, "reading_order", "role", "source_text")
    opens = F.col("source_text").rlike("(?i)results")
    return units.section_states(own, ["doc_id"], ["reading_order", "id"], F.coalesce(F.col("role") == "heading", F.lit(False)), opens).select("doc_id", "id", "section", "within", "past")


SECTIONS_SQL = f"""
with f as (select *, case when role = 'heading' then coalesce(regexp_matches(source_text, '(?i)results'), false) end flag from {UNITS_SQL})
select doc_id, id, cast(sum(case when role = 'heading' then 1 else 0 end) over w as bigint) as section, coalesce(last_value(flag ignore nulls) over w, false) as within, coalesce(max(flag) over w, false) as past
from f window w as (partition by doc_id order by reading_order, id rows unbounded preceding)
"""


def packets(spark: SparkSession, folder: str) -> DataFrame:
    own = unit_rows(spark, folder, "reading_order", "role", "source_text")
    return units.packets(own, ["doc_id"], ["reading_order"], 1000)


PACKETS_SQL = f"""
with recursive u as (select doc_id, id, coalesce(length(source_text), 0) n, coalesce(role = 'heading', false) h, row_number() over (partition by doc_id order by reading_order, id) k from {UNITS_SQL}),
p as (select doc_id, id, k, n filled, 0 packet from u where k = 1
  union all select u.doc_id, u.id, u.k, case when f then u.n else filled + u.n end, packet + case when f then 1 else 0 end
  from (select u.*, p.filled, p.packet, (p.filled + u.n > 1000 or (u.h and p.filled >= 500)) f from p join u on u.doc_id = p.doc_id and u.k = p.k + 1) u)
select doc_id, id, cast(packet as bigint) packet from p
"""


def coverage_audit(spark: SparkSession, folder: str) -> DataFrame:
    expected = table(spark, folder, "semantic_unit").select("doc_id", F.col("id").alias("unit_id"))
    return units.coverage(expected, table(spark, folder, "translation"), ["doc_id", "unit_id"])


COVERAGE_SQL = """
with a as (select doc_id, id unit_id, count(*) n from semantic_unit group by 1, 2), b as (select doc_id, unit_id, count(*) n from translation group by 1, 2),
j as (select doc_id, unit_id, coalesce(a.n, 0) expected_count, coalesce(b.n, 0) given_count from a full join b using (doc_id, unit_id))
select *, case when given_count = 0 then 'missing' when expected_count = 0 then 'unknown' else 'repeated' end problem from j where given_count <> 1 or expected_count <> 1
"""


def span_problems(spark: SparkSession, folder: str) -> DataFrame:
    return review.span_problems(translation_rows(spark, folder, "chinese_text", "spans"), unit_rows(spark, folder, "source_text"))


SPANS_SQL = """
with t as (select * from translation qualify row_number() over (partition by doc_id, unit_id) = 1), u as (select distinct doc_id, id unit_id, length(source_text) s from semantic_unit where source_text is not null),
o as (select doc_id, unit_id, s, length(chinese_text) c, spans, len(spans) n from t join u using (doc_id, unit_id) where chinese_text is not null),
e as (select doc_id, unit_id, s, c, n, generate_subscripts(spans, 1) - 1 as position, unnest(spans) x from o),
l as (select *, coalesce(lag(x.source_end) over w, 0) ps, coalesce(lag(x.target_end) over w, 0) pt from e window w as (partition by doc_id, unit_id order by position)),
p as (select doc_id, unit_id, position, case when not (x.source_start < x.source_end and x.target_start < x.target_end and x.source_end <= s and x.target_end <= c and x.source_start >= 0 and x.target_start >= 0) then 'range'
  when x.source_start <> ps or x.target_start <> pt then 'order' when position = n - 1 and (x.source_end <> s or x.target_end <> c) then 'end' end problem from l
  union all select doc_id, unit_id, null, 'none' from o where coalesce(n, 0) = 0)
select doc_id, unit_id, cast(position as bigint) as position, problem from p where problem is not null
"""


def term_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Terms whose quotes don't stand where they should: those of the renderings, written as in a heading, held against the
    delivered targets."""
    given = table(spark, folder, "annotation_index").select("doc_id", "unit_id", F.col("target_text").alias("chinese_text")).distinct()
    return review.term_problems(translation_rows(spark, folder, "terminology").withColumn("terminology", F.transform("terminology", lambda t: t.withField("source", F.concat(F.upper(t["source"].substr(1, 1)), t["source"].substr(2, 1_000_000))))).join(given, ["doc_id", "unit_id"]), unit_rows(spark, folder, "source_text"))


TERM_PROBLEMS_SQL = """
with t as (select doc_id, unit_id, terminology from translation qualify row_number() over (partition by doc_id, unit_id) = 1), u as (select distinct doc_id, id unit_id, source_text from semantic_unit), a as (select distinct doc_id, unit_id, target_text chinese_text from annotation_index),
e as (select doc_id, unit_id, chinese_text, source_text, generate_subscripts(terminology, 1) - 1 as position, unnest(terminology) x from t join u using (doc_id, unit_id) join a using (doc_id, unit_id) where len(terminology) > 0)
select doc_id, unit_id, cast(position as bigint) as position from e where not coalesce(substr(source_text, x.source_start + 1, x.source_end - x.source_start) = upper(x.source[1]) || x.source[2:] and substr(chinese_text, x.target_start + 1, x.target_end - x.target_start) = x.target, false)
"""


def first_terms(spark: SparkSession, folder: str) -> DataFrame:
    order = unit_rows(spark, folder, "reading_order").select("doc_id", F.col("id").alias("unit_id"), F.col("reading_order").alias("unit_order"))
    return review.first_terms(translation_rows(spark, folder, "terminology"), order)


FIRST_TERMS_SQL = """
with t as (select distinct doc_id, unit_id, terminology from translation), o as (select distinct doc_id, id unit_id, reading_order o from semantic_unit),
e as (select doc_id, unit_id, o, unnest(terminology) x from t join o using (doc_id, unit_id))
select doc_id, lower(x.source) term, x.source as source, x.target as target, unit_id, x.source_start as source_start from e qualify row_number() over (partition by doc_id, lower(x.source) order by o, x.source_start, unit_id, x.source, x.target) = 1
"""


def fragment_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments that don't follow on, their page taken as one block."""
    by_page = F.transform("fragments", lambda f: f.withField("block_id", f["page_number"].cast("string")))
    return units.fragment_gaps(unit_rows(spark, folder, "fragments").withColumn("fragments", by_page))


FRAGMENTS_SQL = """
with u as (select distinct doc_id, id, fragments from semantic_unit), e as (select doc_id, id, generate_subscripts(fragments, 1) - 1 as position, unnest(fragments) f from u),
l as (select doc_id, id, position, f.source_char_start a, f.source_char_end b, lag(f.source_char_end) over (partition by doc_id, f.page_number order by f.source_char_start, f.source_char_end, id, position) p from e)
select doc_id, id, cast(position as bigint) as position, case when a >= b then 'empty' when a < p then 'overlap' else 'gap' end problem from l where a >= b or a <> coalesce(p, 0)
"""


def needs_review(spark: SparkSession, folder: str) -> DataFrame:
    return topology.confidence_gate(unit_rows(spark, folder, "confidence_ppm"), "doc_id", "confidence_ppm")


REVIEW_SQL = f"select doc_id, max(coalesce(confidence_ppm < 800000, true)) needs_review from {UNITS_SQL} group by 1"


def merged_units(spark: SparkSession, folder: str) -> DataFrame:
    """Body units that go on in the next unit, joined, as across a break of page."""
    own = unit_rows(spark, folder, "reading_order", "role", "source_text", "confidence_ppm").withColumnRenamed("source_text", "text")
    made = units.merged_units(own.where("text is not null"), ["doc_id"], ["reading_order", "id"], F.lit(True), F.lit(False))
    return made.select("doc_id", "unit", F.sha2("text", 256).alias("hash"), F.size("blocks").cast("long").alias("blocks"), "confidence_ppm", "needs_review")


def role_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of units of one role in reading order: first and last position."""
    own = unit_rows(spark, folder, "reading_order", "role")
    found = intervals.runs(own, ["doc_id"], ["reading_order", "id"], "role")
    return found.groupBy("doc_id", "run").agg(F.max("role").alias("role"), F.min("reading_order").alias("first_order"), F.max("reading_order").alias("last_order"), F.count("*").alias("n"))


RUNS_SQL = f"""
with c as (select *, case when role is not distinct from lag(role) over w and row_number() over w > 1 then 0 else 1 end ch from {UNITS_SQL} window w as (partition by doc_id order by reading_order, id)),
r as (select *, sum(ch) over (partition by doc_id order by reading_order, id rows unbounded preceding) run from c)
select doc_id, cast(run as bigint) run, max(role) as role, min(reading_order) first_order, max(reading_order) last_order, count(*) n from r group by doc_id, run
"""


def filled_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of units (2 in the body, unknown for headings), filled from their neighbours."""
    level = F.when(F.col("role") == "body", 2).when(F.col("role") == "heading", F.lit(None)).otherwise(1)
    own = unit_rows(spark, folder, "reading_order", "role").withColumn("level", level)
    return intervals.filled_labels(own, ["doc_id"], ["reading_order", "id"], "level", "reading_order", 1).select("doc_id", "id", F.col("level_filled").cast("long").alias("level"))


FILLED_SQL = f"""
with l as (select *, case when role = 'body' then 2 when role = 'heading' then null else 1 end lv from {UNITS_SQL}),
k as (select *, case when lv is not null then reading_order end kn from l),
n as (select *, last_value(lv ignore nulls) over b as lt, first_value(lv ignore nulls) over a as rt, reading_order - last_value(kn ignore nulls) over b as tl, first_value(kn ignore nulls) over a - reading_order as tr from k
  window b as (partition by doc_id order by reading_order, id rows between unbounded preceding and 1 preceding), a as (partition by doc_id order by reading_order, id rows between 1 following and unbounded following))
select doc_id, id, cast(coalesce(lv, case when lt = rt and lt > 1 then lt end, case when coalesce(tl, 2) <= coalesce(tr, 2) then case when tl <= 1 then lt end else case when tr <= 1 then rt end end, 1) as bigint) as level from n
"""


def emphasis(spark: SparkSession, folder: str) -> DataFrame:
    """Terms chosen for emphasis: importance by length, near 6 % of the visible characters of each document."""
    own = translation_rows(spark, folder, "chinese_text", "terminology")
    order = unit_rows(spark, folder, "reading_order").select("doc_id", F.col("id").alias("unit_id"), F.col("reading_order").alias("unit_order"))
    totals = own.groupBy("doc_id").agg(F.sum(text.visible_characters(F.coalesce("chinese_text", F.lit("")))).alias("denominator"))
    each = own.select("doc_id", "unit_id", F.posexplode("terminology").alias("i", "t")).join(order, ["doc_id", "unit_id"])
    size = text.visible_characters(F.col("t.target"))
    candidates = each.select("doc_id", "unit_id", "unit_order", F.concat_ws("#", "unit_id", F.col("i").cast("string")).alias("candidate_id"), F.least(F.lit(3), size).alias("importance"), F.col("t.target_start").alias("target_start"), F.col("t.target_end").alias("target_end"), size.alias("size"))
    return selection.emphasis_share(selection.emphasis(candidates, totals), candidates, totals)


def prefix_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The longest start of each document that fits 2000 characters."""
    own = unit_rows(spark, folder, "reading_order", "source_text").withColumn("cost", F.length("source_text"))
    return selection.prefix_within(own, ["doc_id"], ["reading_order", "id"], "cost", 2000).select("doc_id", "id", "spent")


PREFIX_SQL = f"select * from (select doc_id, id, cast(sum(coalesce(length(source_text), 0)) over (partition by doc_id order by reading_order, id rows unbounded preceding) as bigint) spent from {UNITS_SQL}) where spent <= 2000"


def first_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a term of the glossary is labelled in a unit: where it stands first in its document."""
    found = term_spans(spark, folder).join(unit_rows(spark, folder, "reading_order"), ["doc_id", "id"])
    return selection.first_of(found, ["doc_id", "term"], ["reading_order", "first_at", "id"]).select("doc_id", "id", "term", "is_first")


LABELS_SQL = f"with s as ({TERMS_SQL}) select s.doc_id, s.id, term, row_number() over (partition by s.doc_id, term order by reading_order, first_at, s.id) = 1 is_first from s join {UNITS_SQL} u on u.doc_id = s.doc_id and u.id = s.id"


def rounded_widths(spark: SparkSession, folder: str) -> DataFrame:
    """Advances of the units of a document set one after the other, 5.37 a character, without drift."""
    exact = unit_rows(spark, folder, "reading_order", "source_text").withColumn("w", (F.length("source_text").cast("decimal(18,2)") * F.lit("5.37").cast("decimal(6,2)")))
    return layout.rounded_widths(exact.where("w is not null"), ["doc_id"], ["reading_order", "id"], "w").select("doc_id", "id", "x", "advance")


WIDTHS_SQL = f"""
with e as (select doc_id, id, reading_order, cast(ceil(sum(cast(length(source_text) as decimal(18,2)) * cast(5.37 as decimal(6,2))) over (partition by doc_id order by reading_order, id rows unbounded preceding)) as bigint) e from {UNITS_SQL} where source_text is not null)
select doc_id, id, coalesce(lag(e) over w, 0) x, e - coalesce(lag(e) over w, 0) advance from e window w as (partition by doc_id order by reading_order, id)
"""


def line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    own = spread(table(spark, folder, "translation").select("doc_id", "unit_id", "chinese_text"), "doc_id", "unit_id").dropDuplicates(["doc_id", "unit_id"]).where("chinese_text is not null")
    return layout.line_breaks(own, "chinese_text", 300_000).select("doc_id", "unit_id", F.size("lines").cast("long").alias("n"), F.sha2(F.array_join("lines", "\n"), 256).alias("hash"))


def paginated(spark: SparkSession, folder: str) -> DataFrame:
    """Units set one after the other on pages, 27 characters a line."""
    own = unit_rows(spark, folder, "reading_order", "role", "source_text").withColumn("lines", F.ceil(F.length("source_text") / 27).cast("long"))
    return layout.paginated(own.select("doc_id", "reading_order", "id", "role", "lines", F.lit(15_400).alias("line_height")), "doc_id", "reading_order", 600_000, 6_000)


def font_runs(spark: SparkSession, folder: str) -> DataFrame:
    own = translation_rows(spark, folder, "chinese_text").where("chinese_text is not null")
    runs = layout.font_runs(own, ["doc_id", "unit_id"], "chinese_text", {"latin": r"[\x00-\x{24f}]", "han": r"[\x{2000}-\x{9fff}\x{ff00}-\x{ffef}]"})
    return runs.groupBy("face").agg(F.count("*").alias("runs"), F.sum(F.length("run_text")).cast("long").alias("characters"))


def printed_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Retail prices of parts read as points and given in thousandths: decimal rounding of halves."""
    return table(spark, folder, "part").select("p_partkey", mpt(F.col("p_retailprice")).alias("size_mpt"))


SIZES_SQL = "select p_partkey, cast(round(cast(p_retailprice as decimal(38,6)) * 1000, 0) as bigint) size_mpt from part"

QUERIES = {f.__name__: f for f in (compact_texts, visible_characters, language_gates, token_sets, heading_overlaps, topic_tags, number_markers, reference_markers, lexicon_losses, mechanical_check, citations, term_spans, running_offsets, section_states, packets, coverage_audit, span_problems, term_problems, first_terms, fragment_gaps, needs_review, merged_units, role_runs, filled_roles, emphasis, prefix_budget, first_labels, rounded_widths, line_breaks, paginated, font_runs, printed_sizes)}
SQL = {
    "compact_texts": COMPACT_SQL, "visible_characters": VISIBLE_SQL, "language_gates": LANGUAGE_SQL, "token_sets": TOKENS_SQL, "heading_overlaps": OVERLAPS_SQL, "topic_tags": TAGS_SQL, "number_markers": NUMBERS_SQL,
    "reference_markers": REFERENCES_SQL, "lexicon_losses": LEXICON_SQL, "citations": CITATIONS_SQL, "term_spans": TERMS_SQL, "running_offsets": OFFSETS_SQL, "section_states": SECTIONS_SQL, "packets": PACKETS_SQL,
    "coverage_audit": COVERAGE_SQL, "span_problems": SPANS_SQL, "term_problems": TERM_PROBLEMS_SQL, "first_terms": FIRST_TERMS_SQL, "fragment_gaps": FRAGMENTS_SQL, "needs_review": REVIEW_SQL, "role_runs": RUNS_SQL,
    "filled_roles": FILLED_SQL, "prefix_budget": PREFIX_SQL, "first_labels": LABELS_SQL, "rounded_widths": WIDTHS_SQL, "printed_sizes": SIZES_SQL,
}
