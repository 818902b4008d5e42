"""Drafts, frozen sets, limits, insertions and boxes."""

from pyspark.sql import functions as F

from quirespark.operators import assembly


def test_drafts_are_located_or_refused(spark):
    units = spark.createDataFrame([("d", "a", "one two one"), ("d", "b", "x"), ("d", "c", "y"), ("d", "e", "z")], "doc_id string, unit_id string, source_text string")
    drafts = spark.createDataFrame([("d", "a", "一", "one", 1), ("d", "c", "二", "no", None), ("d", "q", "三", None, None), ("d", "e", "四", None, None), ("d", "e", "五", None, None)], "doc_id string, unit_id string, target_text string, quote string, occurrence int")
    good, bad = assembly.assembled(units, drafts)
    assert [(r.unit_id, r.quote_start) for r in good.collect()] == [("a", 8)]
    assert {(r.unit_id, r.problem) for r in bad.collect()} == {("b", "missing"), ("q", "unknown"), ("e", "repeated"), ("c", "quote")}


def test_a_frozen_set_has_one_hash(spark):
    rows = spark.createDataFrame([("d", "a", 1), ("d", "b", None), ("d", "a", 1)], "doc_id string, k string, v int")
    first = assembly.frozen(rows, "doc_id", ["k", "v"]).first()
    again = assembly.frozen(rows.orderBy(F.desc("k")).distinct(), "doc_id", ["v", "k"]).first()
    assert first == again and first.n == 2
    assert assembly.frozen(rows.limit(0), "doc_id", ["k"]).collect() == []
    found = assembly.repeated_candidates(spark.createDataFrame([("d", "A", "x"), ("d", "a", "y")], "doc_id string, k string, e string"), "doc_id", ["k", "e"])
    assert [tuple(r) for r in found.collect()] == [("d", "k", "a", 2)]


def test_counts_and_limits(spark):
    a = spark.createDataFrame([("d", 95), ("e", 50)], "doc_id string, observed long")
    b = spark.createDataFrame([("d", 100), ("f", 10)], "doc_id string, expected long")
    assert {r.doc_id: r.good for r in assembly.count_bounds(a, b, ["doc_id"]).collect()} == {"d": True, "e": False, "f": False}
    rows = spark.createDataFrame([("d", "abc"), ("d", "de")], "doc_id string, t string")
    found = assembly.over_limits(rows, ["doc_id"], {"items": (F.lit(1), 2), "characters": (F.length("t"), 4)})
    assert [tuple(r) for r in found.collect()] == [("d", "characters", 5, 4)]


def test_insertions_and_clusters(spark):
    frame = spark.createDataFrame([("abcd", [(2, "[2]"), (2, "[1]"), (9, "[9]")]), ("x", [])], "t string, i array<struct<at: long, label: string>>")
    assert sorted(r.composite for r in assembly.inserted(frame, "t", "i").collect()) == ["ab[1][2]cd[9]", "x"]
    spans = spark.createDataFrame([("aéb", 0, 3), ("aéb", 0, 2), (None, 0, 1)], "t string, a int, b int")
    assert [(r.a, r.b) for r in assembly.split_graphemes(spans, "t", "a", "b").collect()] == [(0, 2)]


def test_boxes_and_tails(spark):
    kind = "id string, m_x0 long, m_y0 long, m_x1 long, m_y1 long, c_x0 long, c_y0 long, c_x1 long, c_y1 long, rotation int"
    pages = spark.createDataFrame([("ok", 0, 0, 9, 9, 1, 1, 8, 8, 90), ("out", 0, 0, 9, 9, 1, 1, 10, 8, 0), ("none", 0, 0, 0, 9, 1, 1, 2, 2, 0), ("turn", 0, 0, 9, 9, 1, 1, 8, 8, 45)], kind)
    assert {r.id: r.problem for r in assembly.page_box_problems(pages).collect()} == {"out": "outside", "none": "empty", "turn": "rotation"}
    planned = spark.createDataFrame([("p", 1, "b"), ("p", 2, "c")], "k string, n int, v string")
    drawn = spark.createDataFrame([("p", 1, "a"), ("p", 2, "x"), ("p", 3, "c")], "k string, n int, v string")
    assert [tuple(r) for r in assembly.aligned_tails(planned, drawn, "k", "n", "v").collect()] == [("p", 2, "b", "x")]
