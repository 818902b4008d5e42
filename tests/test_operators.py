"""Literal cases of single operators, and rows with nulls, ties, repetitions and nothing at all."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quirespark.functions import geometry, markers, text
from quirespark.operators import extraction, intervals, layout, records, review, selection, topology, units
from quirespark.operators.latest import latest
from quirespark.sources import documents


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def value(spark, column, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(column).first()[0]


def test_union_of_touching_intervals(spark):
    frame = spark.createDataFrame([("d", 10, 20), ("d", 20, 30), ("d", 50, 70), ("d", 50, 70), ("d", 5, 5), ("d", None, 9)], "doc_id string, a long, b long")
    assert rows(intervals.interval_union(frame, ["doc_id"], "a", "b")) == [("d", 10, 30), ("d", 50, 70)]
    assert rows(intervals.gaps(frame, ["doc_id"], "a", "b", 20)) == [("d", 30, 50)]
    assert rows(intervals.interval_union(frame.limit(0), ["doc_id"], "a", "b")) == []


def test_two_columns_have_one_persistent_gutter(spark):
    boxes = [("d", 1, f"b{i}", x, y, x + 80_000, y + 10_000) for i, (x, y) in enumerate([(20_000, 0), (130_000, 0), (20_000, 20_000), (130_000, 20_000)])]
    frame = spark.createDataFrame(boxes, "doc_id string, page_number int, id string, x0 long, y0 long, x1 long, y1 long")
    gutters = intervals.gaps(frame, ["doc_id", "page_number"], "x0", "x1", 10_000)
    assert rows(gutters) == [("d", 1, 100_000, 130_000)]
    cut = topology.vertical_cut(frame, 10_000)
    assert [(r.region, r.score, r.boxes) for r in cut.orderBy("region").collect()] == [(0, 1_000_000, 2), (1, 1_000_000, 2)]


def test_recursive_cut_goes_down_then_across(spark):
    boxes = [("d", 1, "title", 0, 90, 100, 100), ("d", 1, "left", 0, 0, 40, 80), ("d", 1, "right", 60, 0, 100, 80)]
    frame = spark.createDataFrame(boxes, "doc_id string, page_number int, id string, x0 long, y0 long, x1 long, y1 long")
    assert {r.id: r.path for r in topology.recursive_cut(frame, 10, 5).collect()} == {"title": "/y1", "left": "/y0/x0", "right": "/y0/x1"}


@pytest.mark.parametrize("order", [0, 1])
def test_elementary_parts_count_covers(spark, order):
    data = [("k", 0, 10), ("k", 5, 15), ("k", 20, 30)]
    frame = spark.createDataFrame(data[::-1] if order else data, "k string, a long, b long")
    assert rows(intervals.elementary(frame, ["k"], "a", "b")) == [("k", 0, 5, 1), ("k", 10, 15, 1), ("k", 20, 30, 1), ("k", 5, 10, 2)]


def test_body_size_is_the_weighted_mode_near_the_median(spark):
    sizes = [(10000, 80), (10200, 420), (9900, 100), (40000, 50000)]
    frame = spark.createDataFrame([("d", s, n) for s, n in sizes] + [("e", None, 5), ("e", 9, 0)], "doc_id string, size_mpt long, characters long")
    assert rows(layout.body_size(frame)) == [("d", 10200)]


@pytest.mark.parametrize(("sizes", "taken"), [([11, 6], ["c1"]), ([4, 4], ["c0"])])
def test_emphasis_moves_towards_six_percent(spark, sizes, taken):
    frame = spark.createDataFrame([("d", f"c{i}", 1, 0, "u", i * 20, i * 20 + n, n) for i, n in enumerate(sizes)], "doc_id string, candidate_id string, importance long, unit_order long, unit_id string, target_start long, target_end long, size long")
    totals = spark.createDataFrame([("d", 100), ("empty", 0)], "doc_id string, denominator long")
    found = selection.emphasis(frame, totals)
    assert [r.candidate_id for r in found.collect()] == taken
    shares = {r.doc_id: r.basis_points for r in selection.emphasis_share(found, frame, totals).collect()}
    assert shares == {"d": sum(sizes[int(c[1])] for c in taken) * 100, "empty": 0}


def test_longest_feasible_prefix_needs_few_trials(spark):
    frame = spark.createDataFrame([("d", i) for i in range(32)], "doc_id string, k long")
    assert rows(selection.longest_feasible(frame, ["doc_id"], "k", lambda g: len(g), 5)) == [("d", 5)]
    assert rows(selection.longest_feasible(frame, ["doc_id"], "k", lambda g: len(g), 40)) == [("d", 32)]


def test_shares_add_up(spark):
    frame = spark.createDataFrame([("d", "a", 1), ("d", "b", 1), ("d", "c", 1), ("z", "a", 0), ("d", "n", None)], "doc_id string, p string, w long")
    found = {r.p: r.share for r in selection.apportioned(frame, ["doc_id"], "p", "w").collect()}
    assert found == {"a": 333_334, "b": 333_333, "c": 333_333, "n": 0}


CASES = [
    ("number", "It rose to 1,250 units and .5 in the 1980s.", ["0.5", "1250", "1980s"]),
    ("number", "20世纪80年代有3例", ["1980s", "3"]),
    ("number", "二十世纪八十年代", ["1980s"]),
    ("range", "from 10–20 and two to five", ["10:20", "2:5"]),
    ("range", "从10到20", ["10:20"]),
    ("range", "从10 mm增加到20 mm，由3提高至7", ["10:20", "3:7"]),
    ("range", "速率可从0.3 mm·a−1加速至12.4 mm·a−1。", ["0.3:12.4"]),
    ("range", "sites A-1, -2 and -3", []),
    ("number", "sites A-1, -2 and -3 of 7", ["7"]),
    ("number", "in the 1980s (Smith 2020) and HE 12 / 3", ["1980s"]),
    ("inequality", "not exceed- ing 5", ["<=:5"]),
    ("inequality", "at least 5 and p < .05", ["<:0.05", ">=:5"]),
    ("inequality", "不少于5，不超过7", ["<=:7", ">=:5"]),
    ("unit", "5 mg at 20 ℃ and 3 um", ["mg", "°C", "μm"]),
    ("statistic", "mean = 4.2, p < .05", ["mean:=:4.2", "p:<:0.05"]),
    ("direction", "It increased while others were lower.", ["increase", "lower"]),
    ("negation", "It did not only rise; 没有变化", ["negation"]),
    ("negation", "not only this", []),
    ("degree", "约5人可能", ["approximate", "possibility"]),
    ("logic", "However, because of it 因此", ["contrast", "reason", "result"]),
    ("citation", "as shown [1, 2] （Smith，2020）", ["(Smith,2020)", "[1,2]"]),
    ("figure-table", "Fig. 2 and Table 3a, 图4", ["figure:2", "figure:4", "table:3a"]),
]


@pytest.mark.parametrize(("category", "given", "expected"), CASES)
def test_markers(spark, category, given, expected):
    assert value(spark, markers.marker_column(category)(F.col("t")), t=given) == expected
    native = {"citation": markers.citations, "figure-table": markers.figure_tables, **{n: markers.classes(getattr(markers, n.upper())) for n in ("direction", "negation", "degree", "logic")}}
    if category in native:
        assert value(spark, native[category](F.col("t")), t=given) == expected


def test_mechanical_check_and_waivers(spark):
    pairs = spark.createDataFrame([("d", "u1", "It rose by 5 mg.", "上升了5 mg。"), ("d", "u2", "It rose by 5 mg.", "上升了6 mg。"), ("d", "u3", None, None), ("d", "u4", "five cases", "5例")], "doc_id string, unit_id string, source_text string, target_text string")
    issues = review.issue_hashes(review.mechanical_check(pairs))
    found = {(r.unit_id, r.category) for r in issues.collect()}
    assert ("u2", "number") in found
    assert not any(u in ("u1", "u3", "u4") for u, c in found if c == "number")
    waived = issues.where("unit_id = 'u2'")
    assert {r.unit_id for r in review.unresolved(issues, waived).collect()} == {u for u, _ in found} - {"u2"}


def test_text_functions(spark):
    assert value(spark, text.compact(F.col("t"), 20, fold=True), t="  Á  Straße\n") == "á strasse"
    assert value(spark, text.compact(F.col("t"), 3), t="four") is None
    assert value(spark, text.compact(F.col("t"), 9), t="a\x07b") is None
    assert value(spark, text.line_signature(F.col("t")), t="Page 12  of 30") == "page # of #"
    assert value(spark, text.marker_text(F.col("t")), t="eﬀect (cid:12) 9 (cid:3)x") == "effect  x"
    assert value(spark, text.nth_position(F.col("t"), F.lit("aa"), 1), t="aaa") == 1
    assert value(spark, text.nth_position(F.col("t"), F.lit("aa"), 2), t="aaa") is None
    assert value(spark, text.nth_position(F.col("t"), F.lit("")), t="aaa") is None
    assert value(spark, text.visible_characters(F.col("t")), t="a，b c。") == 3
    assert value(spark, text.joined_fragments(F.array(F.lit("con-"), F.lit("tinues"), F.lit("here")))) == "continues here"
    assert value(spark, text.rounded_share(F.lit(1), F.lit(3))) == 3333
    assert value(spark, text.rounded_share(F.lit(1), F.lit(0))) == 0
    assert value(spark, text.chinese_integer(F.col("t")), t="二十三") == 23
    assert value(spark, text.chinese_integer(F.col("t")), t="十") == 10
    assert value(spark, text.tokens(F.col("t")), t="Well-known don't WELL-KNOWN") == ["don't", "well-known"]
    assert value(spark, text.content_line(F.col("t"), F.lit("膜")), t="film ") == "film — 膜"


def test_geometry(spark):
    a = tuple(F.lit(x) for x in (0, 0, 10, 10))
    b = tuple(F.lit(x) for x in (10, 0, 20, 10))
    assert value(spark, geometry.meets(a, b)) and not value(spark, geometry.overlaps(a, b))
    assert value(spark, geometry.contains(a, tuple(F.lit(x) for x in (-1, 0, 10, 10)), 1))
    assert value(spark, geometry.mpt(F.lit("1.0005").cast("decimal(10,4)"))) == 1001
    turned = geometry.turned(tuple(F.lit(x) for x in (1, 2, 3, 5)), F.lit(90), F.lit(100), F.lit(200))
    assert [value(spark, c) for c in turned] == [2, 97, 5, 99]


def test_repeated_heads_feet_and_numbers(spark):
    data = []
    for page in (1, 2, 3):
        data += [("d", page, f"h{page}", f"Head {page}", 800_000, 810_000, 9000, None), ("d", page, f"f{page}", "Foot", 50_000, 60_000, 9000, None), ("d", page, f"n{page}", str(page), 20_000, 30_000, 9000, None), ("d", page, f"w{page}", "DRAFT", 400_000, 440_000, 40_000, None), ("d", page, f"t{page}", f"Text of page {'abc'[page - 1]}", 500_000, 510_000, 10_000, None)]
    data.append(("one", 1, "x", "Head", 800_000, 810_000, 9000, None))
    frame = spark.createDataFrame(data, "doc_id string, page_number int, id string, text string, y0 long, y1 long, max_font_size_mpt long, fill_colors array<array<string>>")
    found = {r.id: r.kind for r in extraction.repeated_marginals(frame).collect()}
    assert found == {**{f"h{p}": "repeated-header" for p in (1, 2, 3)}, **{f"f{p}": "repeated-footer" for p in (1, 2, 3)}, **{f"n{p}": "page-number" for p in (1, 2, 3)}, **{f"w{p}": "watermark" for p in (1, 2, 3)}}
    assert rows(extraction.repeated_marginals(frame.limit(0))) == []


def test_lines_from_characters_split_columns(spark):
    glyphs = [("d", 1, f"c{i}", c, x, 100, x + 5_000, 10_100, "F", 10_000) for i, (c, x) in enumerate([("a", 0), ("b", 5_000), ("c", 13_000), ("z", 60_000)])]
    frame = spark.createDataFrame(glyphs, "doc_id string, page_number int, id string, text string, x0 long, y0 long, x1 long, y1 long, font_name string, font_size_mpt long")
    assert [(r.id, r.text) for r in extraction.text_lines(frame).orderBy("id").collect()] == [("p0001-line-00001", "ab c"), ("p0001-line-00002", "z")]


def test_components_and_rules(spark):
    kind = "doc_id string, page_number int, id string, x0 long, y0 long, x1 long, y1 long"
    boxes = spark.createDataFrame([("d", 1, "a", 0, 0, 10, 10), ("d", 1, "b", 10, 10, 20, 20), ("d", 1, "c", 50, 50, 60, 60)], kind)
    assert {r.id: r.component for r in extraction.box_components(boxes, ["doc_id", "page_number"]).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert rows(extraction.meeting(boxes, ["doc_id", "page_number"])) == [("d", 1, "a", "b")]
    rules = spark.createDataFrame([("d", 1, "a", 0, 100, 30_000, 200), ("d", 1, "b", 30_500, 120, 60_000, 220), ("d", 1, "c", 0, 9_000, 1_000, 9_100)], kind)
    assert [(r.x0, r.x1) for r in extraction.merged_rules(rules, ["doc_id", "page_number"]).collect()] == [(0, 60_000)]


def test_mentions_and_targets(spark):
    frame = spark.createDataFrame([("d", "See Fig. 2, Table 3a and 图4; Fig. 2 again")], "doc_id string, text string")
    assert rows(extraction.mentions(frame, ["doc_id"], "text")) == [("d", "figure", "2"), ("d", "figure", "4"), ("d", "table", "3a")]
    targets = spark.createDataFrame([("figure", "1", "x"), ("figure", "1", "y"), ("figure", "2", "z"), ("figure", "2", "z")], "kind string, number string, target string")
    assert rows(extraction.unambiguous(targets, ["kind", "number"], "target")) == [("figure", "2", "z")]


def test_units_merge_across_breaks(spark):
    blocks = [("d", 1, "b1", "body", "This goes on in the next col-", 900), ("d", 2, "c", "figure-caption", "Fig. 1.", 800), ("d", 3, "b2", "body", "umn of text.", 700), ("d", 4, "b3", "body", "New paragraph", 600)]
    frame = spark.createDataFrame(blocks, "doc_id string, k int, id string, role string, text string, confidence_ppm long")
    made = units.merged_units(frame, ["doc_id"], ["k"], F.lit(True), F.lit(False))
    assert {r.text: (r.blocks, r.confidence_ppm) for r in made.collect()} == {"This goes on in the next column of text.": (["b1", "b2"], 700), "Fig. 1.": (["c"], 800), "New paragraph": (["b3"], 600)}


def test_packets_close_at_budget_and_headings(spark):
    data = [("d", k, f"u{k}", role, "x" * n) for k, (role, n) in enumerate([("body", 600), ("body", 300), ("heading", 20), ("body", 600), ("body", 2000), ("body", None or 1)])]
    frame = spark.createDataFrame(data, "doc_id string, k int, id string, role string, source_text string")
    assert [r.packet for r in units.packets(frame, ["doc_id"], ["k"], 1000).orderBy("id").collect()] == [0, 0, 1, 1, 2, 3]


def test_line_breaking_keeps_tokens(spark):
    lines = layout.broken("结果为37.5 mg（见图1）。Long words stay", 40_000, 10_000)
    assert all(layout.default_width(x, 10_000) <= 40_000 for x in lines)
    assert not any(x[0] in layout.NOT_FIRST for x in lines)
    assert "".join(lines).replace(" ", "") == "结果为37.5mg（见图1）。Longwordsstay"
    assert layout.broken(None, 1, 1) is None and layout.broken("  \n ", 10, 1) == []
    assert layout.clusters("é👩‍🔬🇫🇷") == ["é", "👩‍🔬", "🇫🇷"]


def test_pages_keep_headings_with_text(spark):
    flows = spark.createDataFrame([("d", 0, "a", "body", 8, 10), ("d", 1, "h", "heading", 1, 10), ("d", 2, "b", "body", 4, 10)], "doc_id string, k int, id string, role string, lines long, line_height long")
    assert rows(layout.paginated(flows, "doc_id", "k", 100, 0)) == [("d", "a", 0, 1, 0, 8), ("d", "b", 0, 2, 0, 4), ("d", "h", 0, 2, 0, 1)]


def test_ledger_hashes_equal_a_loop(spark):
    data = [("j", 1, "a"), ("j", 2, None), ("j", 3, "c"), ("k", 1, "a")]
    frame = spark.createDataFrame(data, "job string, n long, stage string")
    expected, before = {}, {}
    for job, n, stage in data:
        body = json.dumps({"n": n, "stage": stage}, separators=(",", ":"))
        before[job] = hashlib.sha256((before.get(job, "") + body).encode()).hexdigest()
        expected[job, n] = before[job]
    assert {(r.job, r.n): r.state_hash for r in records.ledger(frame, "job", ["n"], ["n", "stage"]).collect()} == expected


def test_latest_takes_one_row_of_ties_and_nulls(spark):
    frame = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", None, "z"), (None, 5, "n")], "k string, at long, v string")
    assert rows(latest(frame, ["k"], ["at"])) == [("k", 1, "b"), (None, 5, "n")]


def test_records_are_replayed(spark):
    events = [("a", 1, 1, "add", "x"), ("a", 2, 2, "revoke", "x"), ("b", 1, 3, "add", "y"), ("b", 2, 4, "delete", "y"), ("c", 1, 5, "add", "z"), ("c", 3, 6, "restore", "w"), (None, 1, 7, "add", "q"), ("d", 1, 8, "nonsense", "q")]
    frame = spark.createDataFrame(events, "id string, at long, n long, action string, v string")
    found = records.current_records(frame, ["id"], ["at", "n"]).select("id", "status", "version", "created_at", "confirmed_at", "v")
    assert rows(found) == [("a", "revoked", 2, 1, 2, "x"), ("c", "active", 2, 1, 3, "w")]


def test_exact_context_scores_full(spark):
    fields = {"expression": "e", "domain": "d", "fingerprint": "f", "collocation": "c", "pos": "p", "syntax": "s", "target": "t"}
    columns = {f"{side}_{k}": v for side in "rc" for k, v in fields.items()}
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.array(F.lit("x")).alias("r_tags"), F.array(F.lit("x")).alias("c_tags"))
    best = records.scored(frame).first()
    assert (best.score, best.needs_review, best.needs_adaptation) == (10_000, False, False)
    worst = records.scored(frame.withColumn("c_pos", F.lit(None).cast("string"))).first()
    assert (worst.score, worst.needs_review, worst.needs_adaptation) == (9_500, True, True)


def test_sources_and_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, '{"k": 1}'), (2, '{"k": 1, "k": 2}'), (3, "[1]"), (4, None), (5, '{"k": NaN}')], "id long, t string")
    assert {r.id: r.bad for r in documents.strict_json(frame, "t", "k long").select("id", "bad").collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
    first = documents.write_once(frame, str(tmp_path / "once"))
    assert first == documents.content_hash(frame.orderBy(F.desc("id")).repartition(3))
    with pytest.raises(Exception, match="exists"):
        documents.write_once(frame, str(tmp_path / "once"))
    path = str(tmp_path / "merge")
    assert documents.write_or_verify(frame, path, ["id"]).count() == 0
    changed = spark.createDataFrame([(1, "other"), (9, "new"), (3, "[1]")], "id long, t string")
    assert [r.id for r in documents.write_or_verify(changed, path, ["id"]).collect()] == [1]
    assert spark.read.parquet(path).count() == 6
    (tmp_path / "doc.jsonl").write_text("".join(json.dumps({"doc_id": "d", "page_number": p, "id": f"c{p}", "text": "x", "x0": 0, "y0": 0, "x1": 1, "y1": 1}) + "\n" for p in (1, 60)))
    spark.dataSource.register(documents.PageObjects)
    pages = spark.read.format("page_objects").option("paths", json.dumps([str(tmp_path / "doc.jsonl")])).load()
    assert sorted(r.page_number for r in pages.collect()) == [1, 60]
    assert [r.size > 0 for r in documents.bounded_files(spark, str(tmp_path / "doc.jsonl")).collect()] == [True]
    assert documents.bounded_files(spark, str(tmp_path / "doc.jsonl"), 3).count() == 0
