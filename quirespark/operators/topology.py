"""Columns, bands, cuts and roles of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.geometry import box, contains, shared_length
from quirespark.operators.grouped import by_group
from quirespark.operators.intervals import chain_clusters, gaps, persistence, separated

PAGE = ["doc_id", "page_number"]


def occupied(lines: DataFrame, graphics: DataFrame, rules: DataFrame | None = None, widths: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, id, x0..y1, origin of what takes up space: eligible lines, graphics, and rules of half the page
    width that lie within no graphic. ``widths``: doc_id, page_number, width."""
    own = [*PAGE, "id", "x0", "y0", "x1", "y1"]
    out = lines.where("body_eligible").select(*own, F.lit("line").alias("origin")).unionByName(graphics.select(*own, F.lit("graphic").alias("origin")))
    if rules is not None and widths is not None:
        wide = rules.join(widths, PAGE).where((F.col("x1") - F.col("x0")) * 2 >= F.col("width")).select(*own)
        held = graphics.select(*PAGE, *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
        inside = wide.join(held, PAGE).where(contains(box("g_"), box())).select(*PAGE, "id").distinct()
        out = out.unionByName(wide.join(inside, [*PAGE, "id"], "left_anti").withColumn("origin", F.lit("rule")))
    return out


def vertical_cut(boxes: DataFrame, minimum: int) -> DataFrame:
    """doc_id, page_number, region, score, box and count of the regions between the vertical gutters of each page.

    A box belongs to the region of its middle. The score is the least persistence of the page's gutters over its whole
    height, 650 000 without a gutter.
    """
    gutters = gaps(boxes, PAGE, "x0", "x1", minimum)
    height = boxes.groupBy(*PAGE).agg(F.min("y0").alias("y_bottom"), F.max("y1").alias("y_top"))
    kept = persistence(boxes, gutters.join(height, PAGE).select(*PAGE, F.col("gap_start").alias("gutter_left"), F.col("gap_end").alias("gutter_right"), "y_bottom", "y_top"), PAGE)
    per_page = kept.groupBy(*PAGE).agg(F.min("ppm").alias("score"), F.array_sort(F.collect_list("gutter_left")).alias("lefts"))
    middle = F.call_function("div", F.col("x0") + F.col("x1"), F.lit(2).cast("long"))
    placed = boxes.join(per_page, PAGE, "left").withColumn("lefts", F.coalesce("lefts", F.array().cast("array<long>"))).withColumn("region", F.size(F.filter("lefts", lambda g: g < middle)).cast("long"))
    return placed.groupBy(*PAGE, "region").agg(F.coalesce(F.min("score"), F.lit(650_000)).cast("long").alias("score"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("boxes"))


def recursive_cut(boxes: DataFrame, minimum_x: int, minimum_y: int) -> DataFrame:
    """doc_id, page_number, id, path: the leaf of the recursive cut that each box ends in.

    At each node the widest gap of at least the minimum is cut, vertical gutters before horizontal ones and the leftmost
    or lowest of equal ones. ``path`` holds a step such as x0 or y1 for each cut. The recursion is one page's own.
    """

    def split(rows: list[tuple], path: str, out: dict[str, str]) -> None:
        for axis, (a, b), least in (("x", (1, 3), minimum_x), ("y", (2, 4), minimum_y)):
            spans = sorted((r[a], r[b]) for r in rows)
            reach, best = spans[0][1], None
            for low, high in spans[1:]:
                if low - reach >= max(1, least) and (best is None or low - reach > best[1] - best[0]):
                    best = (reach, low)
                reach = max(reach, high)
            if best is not None:
                left = [r for r in rows if r[b] <= best[0]]
                right = [r for r in rows if r[a] >= best[1]]
                if left and right and len(left) + len(right) == len(rows):
                    split(left, f"{path}/{axis}0", out)
                    split(right, f"{path}/{axis}1", out)
                    return
        for r in rows:
            out[r[0]] = path or "/"

    def cut(key: tuple, page: list[dict]) -> list[tuple]:
        out: dict[str, str] = {}
        split([(r["id"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in page], "", out)
        return [(*key, name, path) for name, path in out.items()]

    sound = boxes.select(*PAGE, "id", "x0", "y0", "x1", "y1").dropna().where("x0 < x1 and y0 < y1")
    return by_group(sound, PAGE, ["id", "x0", "y0", "x1", "y1"], cut, "doc_id string, page_number int, id string, path string")


def column_anchors(boxes: DataFrame, keys: list[str], tolerance: int, separation: int) -> DataFrame:
    """keys, anchors: left edges by chains of near values, then greedily at least ``separation`` apart."""
    clusters = chain_clusters(boxes.select(*keys, "x0"), keys, "x0", tolerance).groupBy(*keys, "cluster").agg(F.min("x0").alias("edge"))
    return clusters.groupBy(*keys).agg(F.array_sort(F.collect_list("edge")).alias("edges")).select(*keys, separated(F.col("edges"), separation).alias("anchors"))


def nearest_anchor(value: Column, anchors: Column) -> Column:
    """The number of the anchor nearest to a value, the first of equally near ones."""
    away = F.transform(anchors, lambda a, i: F.struct(F.abs(value - a).alias("d"), i.alias("i")))
    return F.array_min(away)["i"].cast("long")


def assigned(inner: DataFrame, bands: DataFrame, keys: list[str], band: str = "band_id") -> DataFrame:
    """Each row of ``inner`` with the band of the same keys that shares most of its height, then the nearest middle, then
    the least id; null where the keys have no band."""
    b = bands.select(*keys, band, F.col("y0").alias("b_y0"), F.col("y1").alias("b_y1"))
    overlap = shared_length(F.col("y0"), F.col("y1"), F.col("b_y0"), F.col("b_y1"))
    off = F.abs(F.col("y0") + F.col("y1") - F.col("b_y0") - F.col("b_y1"))
    best = inner.select(*keys, "id", "y0", "y1").join(b, keys).groupBy(*keys, "id").agg(F.min(F.struct((-overlap).alias("a"), off.alias("o"), band)).alias("m"))
    return inner.join(best.select(*keys, "id", F.col(f"m.{band}").alias(band)), [*keys, "id"], "left")


def horizontal_groups(boxes: DataFrame, minimum: int) -> DataFrame:
    """``boxes`` with ``group``: their number between the horizontal gaps of at least ``minimum``, from the top."""
    found = gaps(boxes, PAGE, "y0", "y1", minimum).groupBy(*PAGE).agg(F.array_sort(F.collect_list("gap_start")).alias("lows"))
    middle = F.call_function("div", F.col("y0") + F.col("y1"), F.lit(2).cast("long"))
    placed = boxes.join(found, PAGE, "left").withColumn("lows", F.coalesce("lows", F.array().cast("array<long>")))
    return placed.withColumn("group", F.size(F.filter("lows", lambda g: g >= middle)).cast("long")).drop("lows")


def title_lines(lines: DataFrame) -> DataFrame:
    """doc_id, id of the title: first-page lines of nine tenths of the largest size, near the topmost of that size."""
    first = lines.where("page_number = 1 and body_eligible")
    top = first.groupBy("doc_id").agg(F.max("max_font_size_mpt").alias("largest"))
    big = first.join(top, "doc_id").where(F.col("max_font_size_mpt") * 10 >= F.col("largest") * 9)
    edge = big.where(F.col("max_font_size_mpt") == F.col("largest")).groupBy("doc_id").agg(F.max("y1").alias("edge"))
    return big.join(edge, "doc_id").where(F.col("edge") - F.col("y1") <= 4 * F.col("largest")).select("doc_id", "id")


def confidence_gate(frame: DataFrame, key: str, score: str, least: int = 800_000) -> DataFrame:
    """key, needs_review: whether any score of a document is below ``least`` or missing."""
    return frame.groupBy(key).agg(F.max(F.coalesce(F.col(score) < least, F.lit(True))).alias("needs_review"))
