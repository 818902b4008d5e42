"""Pages in columns, bindings of lines, promoted items, the store of corrections and gates."""

import random

import pytest
from pyspark.sql import functions as F

from quirespark.operators import reading, selection, store

SPACING = reading.Spacing(page_height=100, margin=0, gap=0)


def flow(name, lines, role="body", columns=1, unit=None, height=10):
    return {"id": name, "unit": unit or name, "role": role, "columns": columns, "lines": lines, "line_height": height}


def test_flows_fill_columns_and_pages():
    found = reading.solved([flow("a", 2), flow("b", 18, columns=2)], SPACING, 0)
    assert found == [("a", 0, 1, 1, 0, 0, 2, 0, 20, 2), ("b", 0, 1, 2, 0, 0, 8, 20, 80, 2), ("b", 1, 1, 2, 1, 8, 16, 20, 80, 2), ("b", 2, 2, 2, 0, 16, 18, 0, 20, 2)]
    assert reading.solved([flow("a", 1, height=200)], SPACING, 0) is None
    assert reading.solved([], SPACING, 0) == []


def test_headings_stay_with_two_lines_and_spanning_flows_begin_below():
    found = reading.solved([flow("a", 8), flow("h", 1, "heading"), flow("b", 4)], SPACING, 0)
    assert [(p[0], p[2], p[5], p[6]) for p in found] == [("a", 1, 0, 8), ("h", 2, 0, 1), ("b", 2, 0, 4)]
    found = reading.solved([flow("a", 3, columns=2), flow("t", 1), flow("b", 1, columns=2)], SPACING, 0)
    assert [(p[0], p[4], p[7]) for p in found] == [("a", 0, 0), ("t", 0, 30), ("b", 0, 40)]


def test_the_last_page_keeps_its_reserve():
    found = reading.solved([flow("a", 9)], SPACING, 30)
    assert [(p[2], p[5], p[6], p[9]) for p in found] == [(1, 0, 7, 2), (2, 7, 9, 2)] or max(p[2] for p in found) <= found[0][9]
    for p in found:
        assert p[2] < p[9] or p[7] + p[8] <= 70
    assert reading.solved([flow("a", 5)], SPACING, 30)[0][9] == 1


def test_set_pages_hold_every_line_once():
    random.seed(9)
    for _ in range(200):
        flows = [flow(str(k), random.randint(1, 12), random.choice(["body", "heading"]), random.choice([1, 2]), height=random.choice([7, 10])) for k in range(random.randint(1, 12))]
        spacing = reading.Spacing(page_height=100, margin=random.choice([0, 5]), gap=random.choice([0, 3]))
        found = reading.solved(flows, spacing, random.choice([0, 20]))
        if found is None:
            continue
        assert all(p[7] + p[8] <= spacing.page_height - spacing.margin for p in found)
        for f in flows:
            own = [p for p in found if p[0] == f["id"]]
            assert [p[5] for p in own] == [0, *(p[6] for p in own[:-1])] and own[-1][6] == f["lines"]
        places = sorted((p[2], p[3], p[4], p[7], p[7] + p[8]) for p in found)
        assert all(a[:3] != b[:3] or a[4] <= b[3] for a, b in zip(places, places[1:], strict=False))


def test_reading_rows_and_problems(spark):
    rows = [("d", 1, "a", "a", "body", 1, 3, 10), ("d", 2, "n", "n", "body", 1, None, 10), ("e", 1, "x", "x", "body", 3, 1, 10)]
    frame = spark.createDataFrame(rows, "doc_id string, k int, id string, unit string, role string, columns int, lines long, line_height long")
    parts = reading.reading_pages(frame, "doc_id", "k", SPACING)
    assert [(r.doc_id, r.id, r.line_end) for r in parts.collect()] == [("d", "a", 3)]
    problems = reading.layout_problems(parts.withColumn("line_start", F.lit(1)), frame.where("lines is not null"), "doc_id")
    assert {(r.doc_id, r.id, r.problem) for r in problems.collect()} == {("d", "a", "continuous"), ("e", "x", "missing")}
    assert reading.reading_pages(frame.limit(0), "doc_id", "k").collect() == []


def test_lines_are_bound_to_their_text(spark):
    assert reading.ranges_of(" ab  cd\n ef ", ["ab", "cd", "ef"]) == [(0, 5), (5, 9), (9, 12)]
    assert reading.ranges_of("ab x cd", ["ab", "cd"]) is None and reading.ranges_of("ab", ["ab", "c"]) is None
    assert reading.ranges_of(None, ["a"]) is None and reading.ranges_of("a", []) is None
    frame = spark.createDataFrame([("ab cd", ["ab", "cd"]), (None, None)], "t string, l array<string>")
    found = [r[0] for r in frame.select(reading.line_ranges(F.col("t"), F.col("l"))).collect()]
    assert [None if x is None else [(y.start, y.end) for y in x] for x in found] == [[(0, 3), (3, 5)], None]


def test_promoted_items(spark):
    rows = [("d", "f1", "figure", "F", 1, False), ("d", "f2", "figure", "F", 9, False), ("d", "t1", "teaching", None, 5, None), ("d", "t2", "teaching", None, 5, False), ("e", "t3", "teaching", None, 1, True), ("e", "t4", "teaching", None, 9, False)]
    frame = spark.createDataFrame(rows, "doc_id string, key string, kind string, figure_id string, priority int, essential boolean")
    assert {r.key: (r.core, r.place) for r in selection.promoted(frame).collect()} == {"f1": (True, None), "f2": (False, 1), "t1": (True, None), "t2": (False, 2), "t3": (True, None), "t4": (False, 1)}
    assert selection.promoted(frame.limit(0)).collect() == []


def test_the_store_replays_its_log(spark, tmp_path):
    own = store.CorrectionStore(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([("film", "physics", "f", "膜"), (" film ", "physics", "f", "膜"), ("probe", "physics", "f", "探针"), (None, "x", "f", "y"), ("a\x07", "x", "f", "y")], store.FIELDS)
    assert own.execute("list").count() == 0
    assert own.execute("add", rows, "2024-01-01 00:00:00") == 2
    assert own.execute("revoke", rows, "2024-01-02 00:00:00") == 2
    assert own.execute("list").count() == 0
    assert own.execute("restore", rows.where("expression = 'probe'"), "2024-01-03 00:00:00") == 1
    assert [(r.expression, r.version) for r in own.execute("list").collect()] == [("probe", 3)]
    assert own.execute("export", at=str(tmp_path / "out")) == 2
    assert own.problems().count() == 0
    assert own.execute("clear", at="2024-01-04 00:00:00") == 2
    assert own.current().count() == 0
    with pytest.raises(ValueError, match="unknown"):
        own.execute("drop")


def test_only_gated_rows_are_published(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "doc_id string, v int")
    gates = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", None), ("c", False)], "doc_id string, passed boolean")
    store.published(frame, gates, "doc_id", str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 1)]
    with pytest.raises(Exception, match="exists"):
        store.published(frame, gates, "doc_id", str(tmp_path / "out"))


def test_chained_gates(spark):
    frame = spark.createDataFrame([("x", "one", True), ("x", "two", False), ("x", "three", True), ("y", "one", None), ("y", "two", True)], "source string, gate string, passed boolean")
    found = {(r.source, r.gate): r.status for r in store.chained_gates(frame, "source", {"one": None, "two": "one", "three": "two", "four": None}).collect()}
    assert found == {("x", "one"): "passed", ("x", "two"): "failed", ("x", "three"): "skipped", ("x", "four"): "failed", ("y", "one"): "failed", ("y", "two"): "skipped", ("y", "three"): "skipped", ("y", "four"): "failed"}
