"""Lines made again from their glyphs: odd deliveries against the query's SQL, and how often glyphs are moved."""

import datetime

import duckdb

from quirespark.plans.page_plans import LINE_TEXT_SQL, line_text_from_characters

CHARS = "doc_id string, page_number int, id string, text string, x0 long, y0 long, x1 long, y1 long, font_name string, font_size_mpt long, upright boolean"
LINES = "doc_id string, page_number int, id string, text string, character_ids array<string>, loaded_at timestamp"


def tables(spark, folder):
    def glyph(name, text, x0, x1, **other):
        row = dict(doc_id="d", page_number=1, id=name, text=text, x0=x0, y0=0, x1=x1, y1=10, font_name="f", font_size_mpt=10_000, upright=True) | other
        return tuple(row.values())

    glyphs = [glyph("a", "a", 0, 5000), glyph("a", "a", 0, 5000, font_name="g"), glyph("b", "b", 5000, 9000), glyph("b", "b", 5000, 9000, y1=11), glyph("c", "c", 12_000, 15_000), glyph("c", "c", 12_000, 15_000)]
    glyphs += [glyph("n", "n", None, None), glyph("t", None, 16_000, 17_000), glyph("v", "v", 1, 2), glyph("v", "w", 1, 3, y0=1), glyph("a", "z", 0, 1, page_number=2), glyph(None, "x", 0, 1), glyph("s", " ", 0, 1), glyph("p", "p", 0, 1, doc_id=None)]
    at = lambda day: datetime.datetime(2024, 1, day)
    lines = [("d", 1, "l1", "ab c", ["c", "a", "b", "missing", None], at(2)), ("d", 1, "l1", "old", ["c"], at(1)), ("d", 1, "l2", "cn", ["n", "c", "t"], at(1)), ("d", 1, "l3", None, ["a", "v"], at(1)), ("d", 1, "l4", "aa", ["a", "a"], at(1))]
    lines += [("d", 1, "l5", "", [], at(1)), ("d", 1, "l6", "", None, at(1)), ("d", 1, "l7", " ", ["s"], at(1)), ("d", 3, "l8", "a", ["a"], at(1)), (None, 1, "l9", "p", ["p"], at(1)), ("d", 2, "l10", "z", ["a"], at(1))]
    spark.createDataFrame(glyphs, CHARS).write.parquet(f"{folder}/page_char.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{folder}/text_line.parquet")


def test_odd_deliveries_equal_the_sql(spark, tmp_path):
    tables(spark, tmp_path)
    con = duckdb.connect()
    for name in ("page_char", "text_line"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    found = {tuple(r) for r in line_text_from_characters(spark, str(tmp_path)).collect()}
    assert found == set(con.execute(LINE_TEXT_SQL).fetchall())
    assert ("d", "l1", "ab c", True) in found


def test_glyphs_are_moved_once(spark, tmp_path):
    tables(spark, tmp_path)
    plan = line_text_from_characters(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2  # latest lines, and lines and glyphs by page
