"""SQL for the queries whose operators carry a state from row to row: windows where that is enough, else recursive queries."""

from __future__ import annotations

from quirespark.plans.page_plans import LINES_SQL
from quirespark.plans.record_plans import RECORDS_SQL  # noqa: F401  (the log's SQL stands there)
from quirespark.plans.unit_plans import SPANS_SQL, TERMS_SQL, UNITS_SQL

SQL: dict[str, str] = {}

SQL["vertical_cuts"] = f"""
with b as (select * from {LINES_SQL}), d as (select distinct doc_id, page_number, x0, x1 from b where x0 < x1),
m as (select *, max(x1) over (partition by doc_id, page_number order by x0, x1 rows between unbounded preceding and 1 preceding) r from d),
i as (select *, sum(case when r is null or x0 > r then 1 else 0 end) over (partition by doc_id, page_number order by x0, x1 rows unbounded preceding) k from m),
u as (select doc_id, page_number, k, min(x0) x0, max(x1) x1 from i group by 1, 2, 3),
g as (select * from (select doc_id, page_number, x1 gl, lead(x0) over (partition by doc_id, page_number order by x0) gr from u) where gr - gl >= 6000),
c as (select g.doc_id, g.page_number, gl, gr, y0, y1, b.x0 < gr and b.x1 > gl across from b join g using (doc_id, page_number) where y0 < y1),
a as (select doc_id, page_number, gl, gr, y0, y1, 'all' w from c union all select doc_id, page_number, gl, gr, y0, y1, 'across' from c where across),
n as (select *, max(y1) over (partition by doc_id, page_number, gl, w order by y0, y1 rows between unbounded preceding and 1 preceding) r from a),
s as (select doc_id, page_number, gl, sum(case when w = 'all' then len else 0 end) occ, sum(case when w = 'across' then len else 0 end) blk from (select *, case when r is null or y0 > r then y1 - y0 else greatest(0, y1 - r) end len from n) group by 1, 2, 3),
p as (select doc_id, page_number, min(cast(greatest(0, least(1000000, (occ - blk) * 1000000 // occ)) as bigint)) score, list(gl) lefts from s group by 1, 2),
z as (select b.*, p.score, len(list_filter(coalesce(lefts, []), lambda v: v < (b.x0 + b.x1) // 2)) region from b left join p using (doc_id, page_number))
select doc_id, page_number, region, coalesce(min(score), 650000) score, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, count(*) boxes from z group by 1, 2, 3
"""

ANCHORS = f"""
v as (select doc_id, page_number, x0 from {LINES_SQL} where x0 is not null),
f as (select *, case when x0 - lag(x0) over (partition by doc_id, page_number order by x0) > 2000 then 1 else 0 end f from v),
c as (select *, sum(f) over (partition by doc_id, page_number order by x0 rows unbounded preceding) k from f), e as (select doc_id, page_number, k, min(x0) edge from c group by 1, 2, 3),
a as (select doc_id, page_number, list_reduce(list_transform(list(edge order by edge), lambda x: [x]), lambda t, x: case when x[1] - t[-1] >= 20000 then list_concat(t, x) else t end) anchors from e group by 1, 2)
"""
SQL["column_anchors"] = f"with {ANCHORS} select doc_id, page_number, array_to_string(anchors, ',') anchors from a"
SQL["nearest_anchors"] = f"with {ANCHORS} select l.doc_id, l.id, cast(list_sort(list_transform(generate_series(1, len(anchors)), lambda i: row(abs(l.x0 - anchors[i]), i)))[1][2] - 1 as bigint) anchor from {LINES_SQL} l join a using (doc_id, page_number)"

SQL["font_runs"] = r"""
with t as (select distinct doc_id, unit_id, chinese_text from translation where chinese_text is not null),
c as (select doc_id, unit_id, generate_subscripts(g, 1) i, unnest(g) c from (select *, regexp_extract_all(chinese_text, '(?s).[\x{300}-\x{36f}\x{fe00}-\x{fe0f}\x{200d}\p{M}]*') g from t)),
f as (select *, case when regexp_matches(c, '^[\x00-\x{24f}]') then 'latin' when regexp_matches(c, '^[\x{2000}-\x{9fff}\x{ff00}-\x{ffef}]') then 'han' end face from c),
n as (select *, case when i > 1 and face is not distinct from lag(face) over (partition by doc_id, unit_id order by i) then 0 else 1 end fresh from f)
select face, cast(sum(fresh) as bigint) runs, cast(sum(length(c)) as bigint) characters from n group by 1
"""

SQL["ledger_hashes"] = """
with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id, event_type) - 1 as seq, '{"at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '","event_id":' || event_id || ',"event_type":"' || event_type || '"}' body from events where user_id is not null),
h as (select user_id, seq, sha256(body) state_hash, cast(null as varchar) previous_hash from e where seq = 0 union all select e.user_id, e.seq, sha256(h.state_hash || e.body), h.state_hash from h join e on e.user_id = h.user_id and e.seq = h.seq + 1)
select * from h
"""

VISIBLE = r"length(regexp_replace({}, '[\p{{P}}\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g'))"
SQL["emphasis"] = f"""
with recursive t as (select distinct doc_id, unit_id, chinese_text, terminology from translation), d as (select doc_id, cast(sum({VISIBLE.format("coalesce(chinese_text, '')")}) as bigint) den from t group by 1),
e as (select doc_id, unit_id, generate_subscripts(terminology, 1) - 1 i, unnest(terminology) x from t),
c as (select e.doc_id, e.unit_id || '#' || i cid, u.reading_order o, x.target_start a, x.target_end b, {VISIBLE.format("x.target")} size from e join (select distinct doc_id, id, reading_order from semantic_unit) u on u.doc_id = e.doc_id and u.id = e.unit_id where x.target_start < x.target_end),
k as (select c.*, den, row_number() over (partition by c.doc_id order by -least(3, size), o, a, b, cid) n from c join d using (doc_id) where den > 0 and size > 0),
f as (select doc_id, cast(0 as bigint) n, cast(0 as bigint) taken, [{{'o': cast(-1 as bigint), 'a': cast(0 as bigint), 'b': cast(0 as bigint)}}] chosen from (select distinct doc_id from k)
  union all select doc_id, n, case when take then taken + size else taken end, case when take then list_append(chosen, {{'o': o, 'a': a, 'b': b}}) else chosen end
  from (select k.doc_id, k.n, f.taken, f.chosen, k.size, k.o, k.a, k.b, len(list_filter(f.chosen, lambda s: s.o = k.o and s.a < k.b and k.a < s.b)) = 0 and (f.taken + k.size) * 10000 <= den * 1000 and abs((f.taken + k.size) * 10000 - den * 600) < abs(f.taken * 10000 - den * 600) take
    from f join k on k.doc_id = f.doc_id and k.n = f.n + 1))
select d.doc_id, coalesce(h, 0) highlighted, case when den = 0 then 0 else (coalesce(h, 0) * 10000 + den // 2) // den end basis_points from d left join (select doc_id, max(taken) h from f group by 1) using (doc_id)
"""

SQL["paginated"] = f"""
with recursive u as (select doc_id, id, role = 'heading' h, row_number() over w k, cast(ceil(length(source_text) / 27.0) as bigint) n from {UNITS_SQL} where length(source_text) > 0 window w as (partition by doc_id order by reading_order, id)),
v as (select *, lead(n) over w n1, lead(n, 2) over w n2 from u window w as (partition by doc_id order by k)),
q as (select *, n * 15400 + case when n1 is null then 0 else 6000 + least(2, n1) * 15400 + case when n1 < 2 and n2 is not null then 6000 + 15400 else 0 end end need from v),
s as (select doc_id, id, k, h, n, need, 0 done, 0 part, 1 page, 0 top from q where k = 1),
r as (select doc_id, id, k, n, done, part, page, top, least(n - done, (600000 - top) // 15400) fit from s
  union all select doc_id, id, k, n, done, part, page, top, least(n - done, (600000 - top) // 15400) from (
    select r.doc_id, q.id, q.k, q.n, case when r.done + greatest(r.fit, 0) < r.n then r.done + greatest(r.fit, 0) else 0 end done, case when r.done + greatest(r.fit, 0) < r.n then r.part + case when r.fit > 0 then 1 else 0 end else 0 end part,
      case when r.done + greatest(r.fit, 0) < r.n then r.page + 1 when q.h and r.top2 > 0 and q.need <= 600000 and 600000 < r.top2 + q.need then r.page + 1 else r.page end page,
      case when r.done + greatest(r.fit, 0) < r.n then 0 when q.h and r.top2 > 0 and q.need <= 600000 and 600000 < r.top2 + q.need then 0 else r.top2 end top
    from (select *, (top + greatest(fit, 0) * 15400) + case when top + greatest(fit, 0) * 15400 > 0 then 6000 else 0 end top2 from r) r join q on q.doc_id = r.doc_id and q.k = case when r.done + greatest(r.fit, 0) < r.n then r.k else r.k + 1 end))
select doc_id, id, cast(part as bigint) part, cast(page as bigint) page, cast(done as bigint) line_start, done + fit line_end from r where fit > 0
"""

SQL["merged_units"] = rf"""
with b as (select doc_id, id, reading_order, role, source_text t, confidence_ppm from {UNITS_SQL} where source_text is not null),
l as (select *, lag(role) over w lr, rtrim(lag(t) over w, ' ') a, ltrim(t, ' ') c from b where role not like '%caption' window w as (partition by doc_id order by reading_order, id)),
v as (select *, case when lr is null or lr <> 'body' or role <> 'body' then 'separate' when a = '' or c = '' then 'review'
  when regexp_matches(a, '[.!?]["''’”)\]]*$') or regexp_matches(c, '^(?:[-•*▪◦–]\s|\(?[0-9a-zA-Z]{{1,3}}[.)]\s)') or regexp_matches(c, '^["''‘“]') then 'separate'
  when a like '%-' then case when regexp_matches(c, '^\p{{Ll}}') then 'merge' else 'review' end
  when regexp_matches(c, '^\p{{Ll}}') or regexp_matches(a, '(?i)\b(?:and|or|nor)\s*$') or regexp_matches(c, '^\([a-z][^()\n]{{0,80}}\)\s*[,;]') or regexp_matches(c, '^(?:[A-Z][a-z]?\d*){{2,}}\b') then 'merge' else 'review' end verdict from l),
n as (select *, sum(case when verdict = 'merge' then 0 else 1 end) over (partition by doc_id order by reading_order, id rows unbounded preceding) unit from v),
j as (select *, lag(t) over w p, lead(t) over w nx from n window w as (partition by doc_id, unit order by reading_order, id)),
m as (select doc_id, unit, string_agg(case when p is null then '' when p like '%-' then '' else ' ' end || case when nx is not null and t like '%-' then t[:-2] else t end, '' order by reading_order, id) made, count(*) k, min(confidence_ppm) confidence_ppm, bool_or(verdict = 'review') needs_review from j group by 1, 2
  union all select doc_id, -row_number() over (partition by doc_id order by reading_order, id), t, 1, confidence_ppm, false from b where role like '%caption')
select doc_id, cast(unit as bigint) unit, sha256(made) hash, k blocks, confidence_ppm, needs_review from m
"""

# one column a page: every line in order with the parts of the paper that are open before it
_LINES = f"""
l as (select *, trim(text, ' ') t, list_contains(list_transform(font_names, lambda f: contains(lower(f), 'bold')), true) bold, exclusion_kind is null and container_kind is null free from {LINES_SQL} where x0 < x1 and y0 < y1 and length(trim(text, ' ')) > 0),
m as (select doc_id, page_number, cast(floor(median(max_font_size_mpt)) as bigint) typical from l where body_eligible and max_font_size_mpt > 0 group by 1, 2),
g as (select doc_id, max(max_font_size_mpt) largest from l where free and page_number = 1 group by 1), h as (select l.doc_id, max(y1) top from l join g using (doc_id) where free and page_number = 1 and max_font_size_mpt = largest group by 1),
n as (select l.*, coalesce(typical, 10000) typical, coalesce(page_number = 1 and free and largest > 0 and max_font_size_mpt * 10 >= largest * 9 and abs(top - y1) <= largest * 5 // 2, false) is_title, lead(t) over w coming, row_number() over w k,
  regexp_matches(t, '(?i)^\\s*(?:\\d+(?:\\.\\d+)*\\.|[IVXLCDM]+[.)])\\s+\\S') num, regexp_matches(t, '(?i)^\\s*abstract\\s*$') ab, regexp_matches(t, '(?i)^\\s*abstract\\s*[:—-]\\s*\\S') ai, regexp_matches(t, '(?i)^\\s*(?:key\\s*words?|keywords?)\\s*[:—-]') kw,
  regexp_matches(t, '(?i)^\\s*references\\s*$') re, regexp_matches(t, '(?i)^\\s*(?:doi\\s*:|\\d{{4}}-\\d{{3}}[\\dXx]/|©\\s*\\d{{4}}\\b)') me,
  regexp_matches(t, '^\\s*[∗*†‡]\\s*$') or regexp_matches(t, '(?i)^\\s*(?:✉\\s*)?corresponding\\s+authors?\\b') or regexp_matches(t, '(?i)^\\s*\\d+\\s+all\\s+authors\\s+contributed\\b') fo
  from l left join m using (doc_id, page_number) left join g using (doc_id) left join h using (doc_id) window w as (partition by doc_id, page_number order by y1 desc, x0, id)),
p as (select *, max(case when is_title then y1 end) over (partition by doc_id, page_number) title_top, bool_or(is_title) over (partition by doc_id, page_number) has_title,
  coalesce(regexp_matches(t, '(?i)^\\s*(?:department|faculty|school|institute|centre|center|laboratory|university|hospital)\\b') or (regexp_matches(t, '(?i)^\\s*[a-z](?:\\s*,\\s*[a-z])*\\s*$') and regexp_matches(coming, '(?i)^\\s*(?:department|faculty|school|institute|centre|center|laboratory|university|hospital)\\b')), false) af from n),
s as (select doc_id, page_number, 0 k, cast(null as varchar) id, cast(null as varchar) role, bool_or(has_title) front, false title, false abstract, false affil, false foot, cast(null as varchar) prole, cast(0 as bigint) px0, cast(0 as bigint) py0, cast(0 as bigint) psize from p group by 1, 2
  union all select doc_id, page_number, k, id, role, case when role in ('heading', 'keywords') or (role = 'abstract' and ai) then false else front end, title or is_title,
    case when ab and role = 'heading' then true when ai and role = 'abstract' then true when role in ('heading', 'keywords') then false else abstract end,
    case when (ab and role = 'heading') or (ai and role = 'abstract') then false when role = 'affiliation' then true else affil end,
    case when role = 'footnote' and free then true when role = 'bibliographic-metadata' and free and me and not (title_top is not null and y0 >= title_top) and not (front and not title) then false else foot end,
    case when free then role else prole end, case when free then x0 else px0 end, case when free then y0 else py0 end, case when free then max_font_size_mpt else psize end
  from (select p.*, s.front, s.title, s.abstract, s.affil, s.foot, s.prole, s.px0, s.py0, s.psize, case
    when exclusion_kind is not null then case exclusion_kind when 'repeated-header' then 'header' when 'repeated-footer' then 'footer' else case when exclusion_kind in ('page-number', 'watermark', 'header', 'footer', 'footnote', 'endnote', 'acknowledgements', 'equation', 'variable', 'code', 'chemical-formula', 'pure-data', 'reference-entry') then exclusion_kind else 'bibliographic-metadata' end end
    when container_kind is not null then case container_kind when 'figure' then 'figure-text' else 'table-cell' end
    when is_title then 'title' when p.page_number = 1 and ((title_top is not null and y0 >= title_top) or (s.front and not s.title)) then 'bibliographic-metadata' when p.page_number = 1 and me then 'bibliographic-metadata'
    when p.page_number = 1 and (s.foot or (not s.front and fo)) then 'footnote' when ab then 'heading' when ai then 'abstract' when kw then 'keywords'
    when s.prole = 'heading' and not num and not re and bold and max_font_size_mpt >= typical * 9 // 10 and s.py0 - y1 between 0 and greatest(5000, greatest(s.psize, max_font_size_mpt)) and abs(s.px0 - x0) <= greatest(2000, greatest(s.psize, max_font_size_mpt) // 2) then 'heading'
    when num or (bold and max_font_size_mpt >= typical * 11 // 10) then 'heading' when s.abstract then 'abstract' when not (s.title and s.front) then 'body' when s.affil or af then 'affiliation' else 'author' end role
    from s join p on p.doc_id = s.doc_id and p.page_number = s.page_number and p.k = s.k + 1)),
r as (select p.doc_id, p.page_number, p.id, p.k, s.role, p.t, p.x0, p.y0, p.x1, p.y1, p.max_font_size_mpt size, p.container_id target, p.num, p.container_kind ck, min(p.x0) over (partition by p.doc_id, p.page_number) left0 from s join p using (doc_id, page_number, k))
"""
SQL["line_roles"] = f"with recursive {_LINES} select doc_id, page_number, id, role from r"
SQL["merged_blocks"] = f"""
with recursive {_LINES},
q as (select *, case when ck is not null and role in ('figure-text', 'table-cell') then target end tg from r),
b as (select doc_id, page_number, k, cast(1 as bigint) block, role, y0 low, x0 edge, size from q where k = 1
  union all select doc_id, page_number, k, block + case when j then 0 else 1 end, role, case when j then least(low, y0) else y0 end, case when j then least(edge, x0) else x0 end, case when j then greatest(bsize, size) else size end
  from (select q.*, b.block, b.low, b.edge, b.size bsize, b.role = q.role and q.role in ('title', 'author', 'affiliation', 'heading', 'abstract', 'body', 'keywords') and b.low - q.y1 between -1000 and greatest(5000, greatest(b.size, q.size) * 3 // 2)
    and (q.role <> 'heading' or (not q.num and abs(b.edge - q.x0) <= greatest(2000, greatest(b.size, q.size) // 2))) and (q.role <> 'body' or q.x0 - q.left0 <= 10000) j
    from b join q on q.doc_id = b.doc_id and q.page_number = b.page_number and q.k = b.k + 1))
select b.doc_id, b.page_number, block, max(b.role) as role, string_agg(q.t, ' ' order by b.k) as text, count(*) lines, min(q.x0) x0, min(q.y0) y0, max(q.x1) x1, max(q.y1) y1 from b join q using (doc_id, page_number, k) group by 1, 2, 3
"""
SQL["line_clusters"] = """
with recursive g as (select distinct doc_id, page_number, id, (y0 + y1) // 2 m, font_size_mpt s, y1, x0 from page_char where x0 is not null and y0 is not null and y1 is not null and font_size_mpt is not null),
k as (select *, row_number() over (partition by doc_id, page_number order by y1 desc, x0, id) n from g),
r as (select doc_id, page_number, id, n, cast(0 as bigint) cluster, [{'m': m, 's': s}] firsts from k where n = 1
  union all select doc_id, page_number, id, n, coalesce(hit, len(firsts) + 1) - 1, case when hit is null then list_append(firsts, {'m': m, 's': s}) else firsts end
  from (select k.doc_id, k.page_number, k.id, k.n, k.m, k.s, r.firsts, list_filter(generate_series(1, len(r.firsts)), lambda i: abs(k.m - r.firsts[i].m) <= greatest(2000, least(k.s, r.firsts[i].s) // 4))[1] hit from r join k on k.doc_id = r.doc_id and k.page_number = r.page_number and k.n = r.n + 1))
select doc_id, page_number, id, cluster from r
"""

# no glyph of the tables is small enough to be a mark of another line, so clusters and gaps make the lines
SQL["text_lines"] = f"""
with k as ({SQL["line_clusters"]}), c as (select distinct doc_id, page_number, id, text, x0, y0, x1, y1, font_size_mpt from page_char where text is not null),
g as (select c.*, cluster, x0 - lag(x1) over w gap, lag(font_size_mpt) over w before from c join k using (doc_id, page_number, id) window w as (partition by doc_id, page_number, cluster order by x0, y0, id)),
s as (select *, sum(case when gap > greatest(6000, before, font_size_mpt) then 1 else 0 end) over (partition by doc_id, page_number, cluster order by x0, y0, id rows unbounded preceding) seg from g),
p as (select *, row_number() over (partition by doc_id, page_number, cluster, seg order by x0, y0, id) n from s),
l as (select doc_id, page_number, trim(string_agg(case when n > 1 and gap > greatest(800, 3 * least(before, font_size_mpt) // 20) then ' ' else '' end || text, '' order by n)) as text, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, max(font_size_mpt) max_font_size_mpt, list(id order by n) ids from p group by doc_id, page_number, cluster, seg)
select doc_id, page_number, printf('p%04d-line-%05d', page_number, row_number() over (partition by doc_id, page_number order by y1 desc, x0, ids)) id, text, x0, y0, x1, y1, max_font_size_mpt from l where length(text) > 0
"""

_TERMS = TERMS_SQL.strip()
SQL["overlapping_terms"] = f"select * from (select *, lead(span_start) over (partition by doc_id, unit_id order by span_start, span_end) next_start from (select distinct doc_id, id unit_id, first_at span_start, first_at + length(term) span_end from ({_TERMS}))) where next_start < span_end"
SQL["term_clashes"] = f"select distinct doc_id, unit_id from ({SQL['overlapping_terms']})"
SQL["review_gates"] = f"""
with i as (select doc_id, problem <> 'none' hard, problem = 'end' done from ({SPANS_SQL.strip()}) union all select doc_id, true, false from translation where chinese_text is null),
n as (select doc_id, count(*) n from i where hard and not done group by 1)
select doc_id, coalesce(n, 0) = 0 passed, coalesce(n, 0) hard_errors from (select distinct doc_id from semantic_unit) left join n using (doc_id)
"""
