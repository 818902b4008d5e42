"""Lines, bands, roles and units of small pages."""

from pyspark.sql import functions as F

from quirespark.operators import affixes, bands, roles, units


def glyph(name, text, x, y, size=10_000, width=5_000, font="F"):
    return {"id": name, "text": text, "x0": x, "y0": y, "x1": x + width, "y1": y + size, "font_size_mpt": size, "font_name": font}


def texts(page):
    return [affixes.joined(p) for p in affixes.page_lines(page)]


def test_small_marks_join_their_host():
    assert texts([glyph("a", "x", 0, 0), glyph("b", "2", 5_200, 5_500, 6_000, 3_000)]) == ["x2"]
    assert texts([glyph("a", "H", 0, 0), glyph("b", "2", 5_100, -2_500, 6_000, 2_500), glyph("c", "O", 7_700, 0)]) == ["H2O"]
    assert texts([glyph("a", "k", 0, 0), glyph("b", "i", 5_100, -2_500, 6_000, 2_500)]) == ["ki"]
    assert texts([glyph("a", "x", 0, 0), glyph("b", "2", 15_000, 5_500, 6_000, 3_000)]) == ["2", "x"]
    assert texts([glyph("a", "x", 0, 0), glyph("b", "2", 5_200, 9_500, 10_000, 3_000)]) == ["2", "x"]
    assert texts([]) == []


def test_a_formula_is_parted_from_prose():
    word = [glyph(f"w{k}", c, 5_000 * k, 0) for k, c in enumerate("where")]
    row = [*word, glyph("x", "x", 27_000, 0, font="Math"), glyph("y", "y", 33_000, 0, font="Math")]
    assert texts(row) == ["where xy"]
    assert sorted(texts([*row, glyph("s", "=", 50_000, 8_000)])) == ["=", "where", "xy"]


def test_clusters_equal_first_fit():
    import random

    random.seed(8)
    for _ in range(100):
        page = affixes.by_height([glyph(str(k), "x", random.randint(0, 9) * 1000, random.randint(0, 40) * 700, random.choice([6_000, 10_000, 24_000])) for k in range(40)])
        firsts, expected = [], []
        for c in page:
            m, s = (c["y0"] + c["y1"]) // 2, c["font_size_mpt"]
            k = next((i for i, (a, b) in enumerate(firsts) if abs(m - a) <= max(2000, min(s, b) // 4)), len(firsts))
            firsts += [(m, s)] if k == len(firsts) else []
            expected.append(k)
        assert affixes.clusters(page) == expected


def box(name, x0, x1, y, text="t", size=10_000):
    return {"id": name, "kind": "line", "size": size, "text": text, "x0": x0, "x1": x1, "y0": y, "y1": y + 10_000}


def two_columns(n=6, shift=0):
    return [box(f"l{k}", 50_000 + shift, 280_000, 700_000 - 12_000 * k) for k in range(n)] + [box(f"r{k}", 310_000 + shift, 540_000, 700_000 - 12_000 * k) for k in range(n)]


def test_bands_of_a_mixed_page():
    found = bands.PageModel([box("t", 50_000, 540_000, 780_000), *two_columns()], 1).rows()
    assert [(r[0], r[1], r[2], r[3], r[9], r[11]) for r in found] == [(1, 1, 1, 50_000, 1, 920_000), (2, 2, 1, 50_000, 6, 970_000), (2, 2, 2, 310_000, 6, 970_000)]
    assert sum(r[7] for r in found[1:]) == 1_000_000 and found[1][8] == 1_000_000
    assert [r[11] for r in bands.PageModel([box("a", 50_000, 540_000, 700_000)], 2).rows()] == [650_000]
    four = [box(f"c{j}{k}", 50_000 + 125_000 * j, 150_000 + 125_000 * j, 700_000 - 12_000 * k) for j in range(4) for k in range(4)]
    assert min(r[12] for r in bands.PageModel(four, 2).rows()) == 300_000


def test_unsure_pages_take_the_documents_columns(spark):
    pages = [(p, b) for p in (1, 2, 3) for b in two_columns()] + [(4, b) for b in (box("a", 50_000, 280_000, 700_000), box("b", 50_000, 280_000, 688_000), box("c", 312_000, 540_000, 600_000), box("d", 312_000, 540_000, 588_000))]
    frame = spark.createDataFrame([("d", p, b["id"], b["kind"], b["size"], b["text"], b["x0"], b["y0"], b["x1"], b["y1"]) for p, b in pages], "doc_id string, page_number int, id string, kind string, size long, text string, x0 long, y0 long, x1 long, y1 long")
    first = bands.page_bands(frame)
    assert [(r.doc_id, r.template) for r in bands.document_template(first).collect()] == [("d", [50_000, 310_000])]
    assert bands.document_template(first.where("page_number = 1")).collect() == []
    both = bands.document_bands(frame)
    assert {r.page_number for r in both.collect()} == {1, 2, 3, 4}
    assert both.where("page_number < 4").exceptAll(first).count() == 0
    assert bands.document_bands(frame.limit(0)).collect() == []


def line(name, text, y, size=10_000, bold=False, x0=50_000, **more):
    return {"id": name, "text": text, "x0": x0, "y0": y, "x1": 500_000, "y1": y + 10_000, "size": size, "bold": bold, "eligible": True, "exclusion": None, "container": None, "container_id": None, "confidence": 1_000_000, "caption_id": None, "caption_kind": None, "target_id": None, **more}


PLACE = [{"band": 1, "column": 1, "x0": 50_000, "x1": 545_000, "y0": 0, "y1": 841_890}]


def found_roles(lines, page=1):
    return {i: u["role"] for u in roles.page_roles(lines, PLACE, page) for i in u["ids"]}


def test_roles_of_a_first_page():
    lines = [line("j", "Journal of Films", 790_000), line("t", "The title", 760_000, 20_000), line("a", "A. Person", 740_000), line("m", "a", 730_000), line("d", "Department of Films", 720_000), line("d2", "Some City", 710_000), line("ab", "Abstract", 690_000), line("s", "We grew films.", 680_000), line("k", "Keywords: film", 660_000), line("h", "1. Introduction", 640_000), line("b", "Films grow.", 620_000), line("c", "Corresponding author: A.", 100_000), line("c2", "a@b", 90_000), line("f", "doi: 10.1", 80_000), line("p", "7", 20_000, exclusion="page-number"), line("x", "v", 500_000, container="table", container_id="T")]
    assert found_roles(lines) == {"j": "bibliographic-metadata", "t": "title", "a": "author", "m": "affiliation", "d": "affiliation", "d2": "affiliation", "ab": "heading", "s": "abstract", "k": "keywords", "h": "heading", "b": "body", "c": "footnote", "c2": "footnote", "f": "bibliographic-metadata", "p": "page-number", "x": "table-cell"}


def test_headings_go_on_in_bold_and_captions_are_one_unit():
    lines = [line("h", "2. Films and", 700_000, bold=True), line("h2", "their probes", 688_000, bold=True), line("b", "Text.", 670_000), line("c1", "Figure 1. A", 600_000, caption_id="C", caption_kind="figure", target_id="G"), line("c2", "film.", 588_000, caption_id="C", caption_kind="figure", target_id="G")]
    assert found_roles(lines, 2) == {"h": "heading", "h2": "heading", "b": "body", "c1": "figure-caption", "c2": "figure-caption"}
    blocks = roles.merged(roles.page_roles(lines, PLACE, 2))
    assert [b["text"] for b in blocks] == ["2. Films and their probes", "Text.", "Figure 1. A film."]


def test_an_indent_parts_paragraphs():
    lines = [line("a", "One line", 700_000), line("b", "goes on.", 688_000), line("c", "Another begins", 676_000, x0=65_000), line("d", "far below", 600_000)]
    assert [b["text"] for b in roles.merged(roles.page_roles(lines, PLACE, 2))] == ["One line goes on.", "Another begins", "far below"]


def test_closing_sections(spark):
    data = [(1, "heading", "Acknowledgements"), (2, "body", "We thank."), (3, "heading", "4. Next"), (4, "body", "More."), (5, "heading", "References"), (6, "body", "[1] A."), (7, "heading", "Odd")]
    frame = spark.createDataFrame([("d", k, r, t, True) for k, r, t in data], "doc_id string, k int, role string, text string, required boolean")
    found = [(r.role, r.required) for r in roles.closing_sections(frame, ["k"]).orderBy("k").collect()]
    assert found == [("acknowledgements", False), ("acknowledgements", False), ("heading", True), ("body", True), ("heading", True), ("reference-entry", False), ("reference-entry", False)]


def test_units_join_over_columns_and_pages(spark):
    kind = "doc_id string, page_number int, block long, band long, column long, role string, text string, y0 long, y1 long, first_x0 long, confidence_ppm long"
    rows = [("d", 1, 1, 1, 1, "body", "It goes on in the", 100_000, 700_000, 50_000, 9), ("d", 1, 2, 1, 2, "body", "next column, and then over", 100_000, 700_000, 310_000, 8), ("d", 1, 3, 1, 2, "figure-caption", "Figure 1. x", 90_000, 99_000, 310_000, 9), ("d", 2, 1, 1, 1, "body", "the page.", 100_000, 700_000, 50_000, 7), ("d", 2, 2, 1, 2, "body", "indented text", 100_000, 700_000, 330_000, 9)]
    places = [("d", p, 1, c, 2, 50_000 + 260_000 * (c - 1), 100_000, 700_000) for p in (1, 2) for c in (1, 2)]
    bands_ = spark.createDataFrame(places, "doc_id string, page_number int, band long, column long, columns long, x0 long, y0 long, y1 long")
    blocks = units.located(spark.createDataFrame(rows, kind), bands_).withColumn("id", F.concat_ws("-", "page_number", "block"))
    made = units.located_units(blocks, ["doc_id"], ["page_number", "block"])
    assert {r.text for r in made.collect()} == {"It goes on in the next column, and then over the page.", "Figure 1. x", "indented text"}
