"""From characters to lines, and what repeats, contains and refers on pages.

Characters and lines are keyed by (doc_id, page_number, id). Deliveries made twice are taken out first with ``latest`` or
``distinct``; null boxes never match.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.geometry import area, box, contains, distance, lightness, meets, shared_length
from quirespark.functions.text import collapse, line_signature
from quirespark.operators import affixes
from quirespark.operators.grouped import by_group
from quirespark.sources.tables import spread

PAGE = ["doc_id", "page_number"]
# A page number alone on its line, and mentions of figures and tables.
PAGE_NUMBER = r"^(?i:(?:page\s+)?(?:\d+|[ivxlcdm]+)(?:\s+of\s+(?:\d+|[ivxlcdm]+))?)$"
MENTION = r"(?:\b(Fig(?:ure)?|Tab(?:le)?)\.?\s*|([图表])\s*)(\d+[A-Za-z]?)"


def ordered_characters(chars: DataFrame) -> DataFrame:
    """Characters with ``ordinal`` on their page, top down and left to right, and the id that this gives."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("y1"), "x0", "y0", "x1", "text", "id")
    numbered = chars.withColumn("ordinal", F.row_number().over(order).cast("long"))
    return numbered.withColumn("made_id", F.format_string("p%04d-char-%06d", "page_number", "ordinal"))


def line_clusters(chars: DataFrame) -> DataFrame:
    """doc_id, page_number, id, cluster: a character joins the first cluster whose first member's middle is near enough.

    The first fit depends on earlier clusters, so pages are swept one by one, over arrays of one page at a time.
    """

    def sweep(key: tuple, page: list[dict]) -> list[tuple]:
        ordered = affixes.by_height(page)
        return [(*key, c["id"], n) for c, n in zip(ordered, affixes.clusters(ordered), strict=True)]

    sound = chars.select(*PAGE, "id", "x0", "y0", "y1", "font_size_mpt").dropna(subset=["x0", "y0", "y1", "font_size_mpt"])
    return by_group(sound, PAGE, ["id", "x0", "y0", "y1", "font_size_mpt"], sweep, "doc_id string, page_number int, id string, cluster long")


def glyph_texts(lines: DataFrame, glyphs: DataFrame) -> DataFrame:
    """doc_id, page_number, line_id, given, text of each of ``lines`` (doc_id, page_number, line_id, given, character_ids), made
    again from ``glyphs`` (doc_id, page_number, id, text, x0, y0, x1, font_size_mpt) from the left, with blanks for wide gaps.

    Lines and glyphs are moved once, to the task of their page, and meet there: glyphs are the bulk of all rows, so neither a
    join by glyph nor a window by line may move them again. Equal glyphs count once, those with a different box or text each;
    nulls come last. Lines without any glyph's text give no row.
    """
    ids = lines.select(*PAGE, F.lit(False).alias("glyph"), "line_id", "given", "character_ids")
    both = ids.unionByName(glyphs.select(*PAGE, F.lit(True).alias("glyph"), "id", "text", "x0", "y0", "x1", "font_size_mpt"), allowMissingColumns=True)
    own = F.when(F.col("glyph"), F.array("id")).otherwise(F.col("character_ids"))
    each = spread(both.where("doc_id is not null and page_number is not null"), *PAGE).withColumn("id", F.explode(own)).where("id is not null")
    place = F.struct(F.isnull("x0").alias("nx"), "x0", F.isnull("y0").alias("ny"), "y0", "id", "x1", "font_size_mpt", "text")
    met = each.groupBy(*PAGE, "id").agg(F.collect_set(F.when(F.col("glyph"), place)).alias("places"), F.collect_list(F.when(~F.col("glyph"), F.struct("line_id", "given"))).alias("within"))
    placed = met.where((F.size("places") > 0) & (F.size("within") > 0)).select(*PAGE, F.inline("within"), "places").select(*PAGE, "line_id", "given", F.explode("places").alias("c"))
    made = placed.groupBy(*PAGE, "line_id", "given").agg(F.array_sort(F.collect_list("c")).alias("o"))

    def piece(c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("o", i - 1))
        wide = F.greatest(F.lit(800), F.call_function("div", 3 * F.least(before["font_size_mpt"], c["font_size_mpt"]), F.lit(20).cast("long")))
        return F.concat(F.when(c["x0"] - before["x1"] > wide, " ").otherwise(""), c["text"])

    return made.select(*PAGE, "line_id", "given", F.trim(F.array_join(F.transform("o", piece), "")).alias("text")).where(F.length("text") > 0)


def text_lines(chars: DataFrame) -> DataFrame:
    """Lines of pages from their characters, from the top: clusters, segments, formulae parted from prose, marks at their host.

    Characters with a null box, size or text are left out; a null font is a font of its own.
    """
    fields = ["id", "text", "x0", "y0", "x1", "y1", "font_size_mpt", "font_name"]

    def build(key: tuple, page: list[dict]) -> list[tuple]:
        out = []
        for k, line in enumerate(affixes.page_lines(page), 1):
            box_ = [f(c[n] for c in line) for n, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))]
            fonts = sorted({c["font_name"] for c in line if c["font_name"] is not None})
            out.append((*key, f"p{key[1]:04d}-line-{k:05d}", affixes.joined(line), *box_, max(c["font_size_mpt"] for c in line), fonts, [c["id"] for c in line]))
        return out

    schema = "doc_id string, page_number int, id string, text string, x0 long, y0 long, x1 long, y1 long, max_font_size_mpt long, font_names array<string>, character_ids array<string>"
    return by_group(chars.select(*PAGE, *fields).dropna(subset=fields[:-1]), PAGE, fields, build, schema)


def repeated_marginals(lines: DataFrame, pages: DataFrame | None = None, page_height: int = 841_890) -> DataFrame:
    """doc_id, id, kind of the lines that are page numbers, repeated headers or footers, or watermarks.

    A line repeats if its signature stands on 60 % of a document's pages (2 at least), or, from 4 pages on, on 60 % of its
    odd or even pages. ``pages`` (doc_id, page_number, page_y0, page_y1) gives the visible boxes, else all are 0 to
    ``page_height``. Documents of one page, null texts and null boxes give nothing.
    """
    if pages is None:
        pages = lines.select(*PAGE).distinct().withColumns({"page_y0": F.lit(0).cast("long"), "page_y1": F.lit(page_height).cast("long")})
    own = lines.where("text is not null").withColumn("signature", line_signature(F.col("text")))
    odd = F.when(F.col("page_number") % 2 == 1, F.col("page_number"))
    even = F.when(F.col("page_number") % 2 == 0, F.col("page_number"))
    counts = [F.countDistinct("page_number").alias("n"), F.countDistinct(odd).alias("odd"), F.countDistinct(even).alias("even")]
    total = pages.groupBy("doc_id").agg(*counts).select("doc_id", *[F.col(c).alias(f"all_{c}") for c in ("n", "odd", "even")])
    share = lambda c: F.greatest(F.lit(2), F.ceil(F.col(c) * 6 / 10))
    by_parity = lambda c: (F.col("all_n") >= 4) & (F.col(f"all_{c}") >= 2) & (F.col(c) >= share(f"all_{c}"))
    repeats = own.groupBy("doc_id", "signature").agg(*counts).join(total, "doc_id").where((F.col("n") >= share("all_n")) | by_parity("odd") | by_parity("even")).select("doc_id", "signature", F.lit(True).alias("repeats"))
    usual = own.groupBy("doc_id").agg(F.floor(F.median("max_font_size_mpt")).alias("usual"))
    placed = own.join(pages, PAGE).join(total.where("all_n >= 2").select("doc_id"), "doc_id").join(usual, "doc_id").join(repeats, ["doc_id", "signature"], "left")
    margin = F.call_function("div", (F.col("page_y1") - F.col("page_y0")) * 12, F.lit(100).cast("long"))
    low, high = F.col("y0") <= F.col("page_y0") + margin, F.col("y1") >= F.col("page_y1") - margin
    large = F.col("max_font_size_mpt") >= F.call_function("div", F.col("usual") * 3, F.lit(2).cast("long"))
    kind = F.when(low & collapse(F.col("text")).rlike(PAGE_NUMBER), "page-number").when(F.col("repeats"), F.when(high, "repeated-header").when(low, "repeated-footer").when(large | (F.coalesce(lightness(F.col("fill_colors")), F.lit(0.0)) >= 600_000), "watermark"))
    return placed.withColumn("kind", kind).where("kind is not null").select("doc_id", "id", "kind")


def smallest_container(inner: DataFrame, outer: DataFrame, keys: list[str], tolerance: int = 0, strip: int = 50_000) -> DataFrame:
    """Each row of ``inner`` with ``container_id``, the smallest box of ``outer`` (ties: least id) that contains it, or null.

    Both sides meet on strips of height ``strip`` within the keys: an outer box stands in all of its strips, an inner one in
    the strip of its lower edge alone, so each pair is met once.
    """
    at = lambda c: F.floor(F.col(c) / strip)
    wide = outer.where("y0 is not null and y1 is not null").select(*keys, F.col("id").alias("container_id"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(F.sequence(F.floor((F.col("y0") - tolerance) / strip), F.floor((F.col("y1") + tolerance) / strip))).alias("strip_"))
    met = inner.select(*keys, "id", "x0", "y0", "x1", "y1").withColumn("strip_", at("y0")).join(wide, [*keys, "strip_"]).where(contains(box("o_"), box(), tolerance))
    best = met.groupBy(*keys, "id").agg(F.min(F.struct(area(box("o_")).alias("a"), "container_id")).alias("b")).select(*keys, "id", F.col("b.container_id").alias("container_id"))
    return inner.join(best, [*keys, "id"], "left")


def nearest_box(captions: DataFrame, regions: DataFrame, keys: list[str], limit: int = 50_000) -> DataFrame:
    """doc, page, caption and region ids: for each caption the region at the least vertical distance, then of the longest
    shared width, then of the least id; only within ``limit`` and with a shared width."""
    a = captions.select(*keys, F.col("id").alias("caption_id"), *[F.col(c).alias(f"c_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = regions.select(*keys, F.col("id").alias("region_id"), *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    away = distance(F.col("c_y0"), F.col("c_y1"), F.col("r_y0"), F.col("r_y1"))
    shared = shared_length(F.col("c_x0"), F.col("c_x1"), F.col("r_x0"), F.col("r_x1"))
    pairs = a.join(b, keys).withColumns({"away": away, "shared": shared}).where((F.col("away") <= limit) & (F.col("shared") > 0))
    return pairs.groupBy(*keys, "caption_id").agg(F.min(F.struct("away", (-F.col("shared")).alias("less"), "region_id")).alias("b")).select(*keys, "caption_id", F.col("b.region_id").alias("region_id"), F.col("b.away").cast("long").alias("away"))


def mentions(frame: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, kind ('figure', 'table'), number of each mention of a figure or table in a text, each once."""
    found = F.expr(f"transform(regexp_extract_all({text}, r'{MENTION}', 0), x -> x)")
    each = frame.select(*keys, F.explode(found).alias("m"))
    kind = F.when(F.col("m").rlike("^(?i:tab|表)"), "table").otherwise("figure")
    return each.select(*keys, kind.alias("kind"), F.lower(F.regexp_extract("m", r"(\d+[A-Za-z]?)$", 1)).alias("number")).distinct()


def unambiguous(targets: DataFrame, keys: list[str], target: str) -> DataFrame:
    """keys and target of the keys that name exactly one target."""
    return targets.groupBy(*keys).agg(F.min(target).alias(target), F.max(target).alias("other_")).where(F.col(target) == F.col("other_")).drop("other_")


def scanned_pages(images: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_number of the pages that an image covers by nine tenths and that hold 5 lines and 200 characters."""
    boxes = pages.select(*PAGE, area(box()).alias("page_area"))
    covered = images.select(*PAGE, area(box()).alias("a")).join(boxes, PAGE).where(F.col("a") * 10 >= F.col("page_area") * 9).select(*PAGE).distinct()
    full = lines.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).where("n >= 5 and chars >= 200")
    return full.join(covered, PAGE, "left_semi").select(*PAGE)


def box_components(boxes: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """keys, id, component: boxes that meet one another directly or over others, one page at a time; a component is named
    by its least id."""

    def join(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["x0", "id"]).reset_index(drop=True)
        parent = list(range(len(page)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        active: list[int] = []
        x0, y0, x1, y1 = (page[c].tolist() for c in ("x0", "y0", "x1", "y1"))
        for i in range(len(page)):  # a sweep: only boxes that still reach here can meet
            active = [j for j in active if x1[j] + tolerance >= x0[i]]
            for j in active:
                if y0[j] <= y1[i] + tolerance and y0[i] <= y1[j] + tolerance:
                    parent[root(i)] = root(j)
            active.append(i)
        roots = pd.Series([root(i) for i in range(len(page))])
        page["component"] = page.id.groupby(roots).transform("min") if len(page) else page.id
        return page[[*keys, "id", "component"]]

    sound = boxes.select(*keys, "id", "x0", "y0", "x1", "y1").dropna()
    kinds = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in [*keys, "id"])
    return sound.groupBy(*keys).applyInPandas(join, f"{kinds}, component {boxes.schema['id'].dataType.simpleString()}")


def merged_rules(vectors: DataFrame, keys: list[str], flat: int = 2000, near: int = 250, touch: int = 1000, least: int = 40_000) -> DataFrame:
    """Horizontal rules from thin boxes: those of one height (within ``near`` of the one before) whose ends touch are one;
    rules shorter than ``least`` are dropped."""
    thin = vectors.where((F.col("y1") - F.col("y0") <= flat) & (F.col("x1") > F.col("x0"))).withColumn("y", F.call_function("div", F.col("y0") + F.col("y1"), F.lit(2).cast("long")))
    by_height = Window.partitionBy(*keys).orderBy("y", "x0", "id")
    leveled = thin.withColumn("fresh_y", F.when(F.col("y") - F.lag("y").over(by_height) > near, 1).otherwise(0)).withColumn("level", F.sum("fresh_y").over(by_height.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    along = Window.partitionBy(*keys, "level").orderBy("x0", "x1")
    reach = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = leveled.withColumn("fresh_x", F.when(F.col("x0") > reach + touch, 1).otherwise(0)).withColumn("part", F.sum("fresh_x").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return parts.groupBy(*keys, "level", "part").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where(F.col("x1") - F.col("x0") >= least).drop("level", "part")


def meeting(boxes: DataFrame, keys: list[str], tolerance: int = 0, strip: int = 50_000) -> DataFrame:
    """keys, id, other of each two boxes (id < other) that touch or overlap, met by strips and reported in their first
    common strip only."""
    rows = boxes.select(*keys, "id", "x0", "y0", "x1", "y1").where("y0 is not null and y1 is not null")
    spread = rows.withColumn("strip_", F.explode(F.sequence(F.floor((F.col("y0") - tolerance) / strip), F.floor((F.col("y1") + tolerance) / strip))))
    other = spread.select(*keys, "strip_", F.col("id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    first = F.floor((F.greatest("y0", "o_y0") - tolerance) / strip)
    return spread.join(other, [*keys, "strip_"]).where((F.col("id") < F.col("other")) & meets(box(), box("o_"), tolerance) & (F.col("strip_") == first)).select(*keys, "id", "other")


def referenced(column: Column) -> Column:
    """Whether a text mentions a figure or table."""
    return column.rlike(MENTION)
