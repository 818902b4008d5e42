"""Roles of lines, blocks of lines of one role, and what a document's last sections make of them.

Roles depend on the lines before them in their column of a page only, so a page is worked on as one; what reaches over
pages (references, acknowledgements) is a window over blocks.
"""

from __future__ import annotations

import re
from statistics import median

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.grouped import by_group

PAGE = ["doc_id", "page_number"]
# Lines that open or name a part of a paper.
KEYWORDS = r"(?i)^\s*(?:key\s*words?|keywords?)\s*[:—-]"
NUMBERED = r"(?i)^\s*(?:\d+(?:\.\d+)*\.|[IVXLCDM]+[.)])\s+\S"
ABSTRACT = r"(?i)^\s*abstract\s*$"
ABSTRACT_INLINE = r"(?i)^\s*abstract\s*[:—-]\s*\S"
ACKNOWLEDGEMENTS = r"(?i)^\s*acknowledg(?:e)?ments?\s*$"
REFERENCES = r"(?i)^\s*references\s*$"
AFFILIATION = r"(?i)^\s*(?:department|faculty|school|institute|centre|center|laboratory|university|hospital)\b"
AFFILIATION_MARK = r"(?i)^\s*[a-z](?:\s*,\s*[a-z])*\s*$"
FOOTNOTE_MARK = r"^\s*[∗*†‡]\s*$"
CORRESPONDING = r"(?i)^\s*(?:✉\s*)?corresponding\s+authors?\b"
EQUAL = r"(?i)^\s*\d+\s+all\s+authors\s+contributed\b"
METADATA = r"(?i)^\s*(?:doi\s*:|\d{4}-\d{3}[\dXx]/|©\s*\d{4}\b)"
# Roles that are translated, that merge, and the most confidence of some.
REQUIRED = ("title", "heading", "abstract", "body", "keywords", "figure-caption", "table-caption")
MERGED = ("title", "author", "affiliation", "heading", "abstract", "body", "keywords")
CONFIDENCE = {"title": 950_000, "author": 850_000, "heading": 950_000, "abstract": 900_000, "body": 850_000}
EXCLUDED = {"repeated-header": "header", "repeated-footer": "footer", **{r: r for r in ("page-number", "watermark", "header", "footer", "footnote", "endnote", "bibliographic-metadata", "acknowledgements", "equation", "variable", "code", "chemical-formula", "pure-data", "reference-entry")}}
LINE = ["id", "text", "x0", "y0", "x1", "y1", "size", "bold", "eligible", "exclusion", "container", "container_id", "confidence", "caption_id", "caption_kind", "target_id"]
BLOCKS = (
    "doc_id string, page_number int, block long, role string, required boolean, text string, x0 long, y0 long, x1 long, y1 long, first_x0 long, first_y1 long, line_ids array<string>, "
    "band long, column long, confidence_ppm long, size long, target_id string"
)


def _is(pattern: str, text: str) -> bool:
    return re.search(pattern, text) is not None


def title_of(lines: list[dict]) -> set[str]:
    """The lines of nine tenths of the largest size near the topmost line of that size."""
    free = [x for x in lines if x["exclusion"] is None and x["container"] is None]
    largest = max((x["size"] for x in free), default=0)
    if not largest:
        return set()
    top = max(x["y1"] for x in free if x["size"] == largest)
    return {x["id"] for x in free if 10 * x["size"] >= 9 * largest and abs(top - x["y1"]) <= largest * 5 // 2}


class Column:
    """The lines of one column in order, and which part of the paper is open."""

    def __init__(self, page_number: int, titles: set[str], title_top: int | None, typical: int, lines: list[dict]) -> None:
        self.first, self.titles, self.title_top, self.typical, self.lines = page_number == 1, titles, title_top, typical, lines
        self.front = any(x["id"] in titles for x in lines)
        self.title = self.abstract = self.affiliation = self.footnote = False
        self.before: tuple[dict, str] | None = None

    def goes_on(self, line: dict, text: str) -> bool:
        """Whether a bold line goes on with the heading before it."""
        if self.before is None or self.before[1] != "heading" or not text or not line["bold"] or line["size"] < self.typical * 9 // 10:
            return False
        if _is(NUMBERED, text) or _is(ABSTRACT, text) or _is(REFERENCES, text):
            return False
        above = self.before[0]
        size = max(above["size"], line["size"])
        return 0 <= above["y0"] - line["y1"] <= max(5_000, size) and abs(above["x0"] - line["x0"]) <= max(2_000, size // 2)

    def opens(self, abstract: bool, affiliation_ends: bool = False) -> None:
        self.abstract, self.front = abstract, False
        self.affiliation &= not affiliation_ends

    def role(self, k: int) -> str:
        line = self.lines[k]
        text = (line["text"] or "").strip()
        if line["id"] in self.titles:
            self.title = True
            return "title"
        if self.first:
            if (self.title_top is not None and line["y0"] >= self.title_top) or (self.front and not self.title):
                return "bibliographic-metadata"
            if _is(METADATA, text):
                self.footnote = False
                return "bibliographic-metadata"
            if self.footnote or (not self.front and (_is(FOOTNOTE_MARK, text) or _is(CORRESPONDING, text) or _is(EQUAL, text))):
                self.footnote = True
                return "footnote"
        if _is(ABSTRACT, text) or _is(ABSTRACT_INLINE, text):
            self.opens(True, affiliation_ends=True)
            return "heading" if _is(ABSTRACT, text) else "abstract"
        if _is(KEYWORDS, text):
            self.opens(False)
            return "keywords"
        if self.goes_on(line, text) or _is(NUMBERED, text) or (line["bold"] and line["size"] >= self.typical * 11 // 10):
            self.opens(False)
            return "heading"
        if self.abstract:
            return "abstract"
        if not (self.title and self.front):
            return "body"
        coming = (self.lines[k + 1]["text"] or "").strip() if k + 1 < len(self.lines) else ""
        self.affiliation |= _is(AFFILIATION, text) or (_is(AFFILIATION_MARK, text) and _is(AFFILIATION, coming))
        return "affiliation" if self.affiliation else "author"

    def roles(self) -> dict[str, str]:
        out = {}
        for k, line in enumerate(self.lines):
            if line["exclusion"] is None and line["container"] is None:
                out[line["id"]] = role = self.role(k)
                self.before = line, role
        return out


def _place(box: dict, bands: list[dict]) -> tuple[int, int, int]:
    """Band, column and the column's left edge of a box: most of its height, then most of its width, then the nearest middle."""
    shared = lambda a, b, c, d: max(0, min(b, d) - max(a, c))
    y = min(bands, key=lambda b: (-shared(box["y0"], box["y1"], b["y0"], b["y1"]), abs(box["y0"] + box["y1"] - b["y0"] - b["y1"]), b["band"]))
    own = [b for b in bands if b["band"] == y["band"]]
    x = min(own, key=lambda b: (-shared(box["x0"], box["x1"], b["x0"], b["x1"]), abs(box["x0"] + box["x1"] - b["x0"] - b["x1"]), b["column"]))
    return x["band"], x["column"], x["x0"]


def page_roles(lines: list[dict], bands: list[dict], page_number: int) -> list[dict]:
    """Units of a page in order: each line, or all lines of a caption, with its role, place and box."""
    for x in lines:
        x["place"] = _place(x, bands)
    lines = sorted(lines, key=lambda x: (*x["place"][:2], -x["y1"], x["x0"], x["id"]))
    free = [x for x in lines if x["caption_id"] is None]
    sizes = [x["size"] for x in free if x["eligible"] and x["size"] > 0]
    titles = title_of(free) if page_number == 1 else set()
    top = max((x["y1"] for x in free if x["id"] in titles), default=None)
    columns: dict[tuple[int, int], list[dict]] = {}
    for x in free:
        columns.setdefault(x["place"][:2], []).append(x)
    roles: dict[str, str] = {}
    for own in columns.values():
        roles |= Column(page_number, titles, top, int(median(sizes)) if sizes else 10_000, own).roles()
    captions: dict[str, list[dict]] = {}
    for x in lines:
        if x["caption_id"] is not None:
            captions.setdefault(x["caption_id"], []).append(x)
    units = []
    for own, role, target in [([x], None, None) for x in free] + [(c, f"{c[0]['caption_kind']}-caption", c[0]["target_id"]) for c in captions.values()]:
        head = own[0]
        if role is None:
            if head["exclusion"] is not None:
                role = EXCLUDED.get(head["exclusion"], "bibliographic-metadata")
            elif head["container"] is not None:
                role, target = ("figure-text" if head["container"] == "figure" else "table-cell"), head["container_id"]
            else:
                role = roles[head["id"]]
        box = {"x0": min(x["x0"] for x in own), "y0": min(x["y0"] for x in own), "x1": max(x["x1"] for x in own), "y1": max(x["y1"] for x in own)}
        units.append({**box, "role": role, "text": " ".join((x["text"] or "").strip() for x in own), "first": (head["x0"], head["y1"]), "ids": [x["id"] for x in own], "place": _place(box, bands), "size": max(x["size"] for x in own), "confidence": min(CONFIDENCE.get(role, 1_000_000), *(x["confidence"] for x in own), 1_000_000), "target": target})
    return sorted(units, key=lambda u: (*u["place"][:2], -u["first"][1], u["first"][0], u["ids"]))


def _joins(block: dict, unit: dict) -> bool:
    """Whether a unit goes on with the block so far."""
    if block["role"] not in MERGED or any(block[k] != unit[k] for k in ("role", "place", "target")):
        return False
    size = max(block["size"], unit["size"])
    if not -1_000 <= block["y0"] - unit["y1"] <= max(5_000, size * 3 // 2):
        return False
    if block["role"] == "heading":
        return not _is(NUMBERED, unit["text"]) and abs(block["x0"] - unit["x0"]) <= max(2_000, size // 2)
    return block["role"] != "body" or unit["first"][0] - unit["place"][2] <= 10_000


def merged(units: list[dict]) -> list[dict]:
    """Units that go on with one another as one block; its lower edge and largest size move with it."""
    out: list[dict] = []
    for unit in units:
        if out and _joins(out[-1], unit):
            block = out[-1]
            block["text"] += " " + unit["text"]
            block["ids"] = block["ids"] + unit["ids"]
            for key, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max), ("confidence", min), ("size", max)):
                block[key] = f(block[key], unit[key])
        else:
            out.append(dict(unit))
    return out


def page_blocks(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """``BLOCKS`` of each page: roles of its lines, merged.

    ``lines``: doc_id, page_number and ``LINE`` (missing ones are taken as null or plain); ``bands``: doc_id, page_number,
    band, column, x0, x1, y0, y1. Lines without a positive box or a text are dropped; pages without bands give no row.
    """
    usual = {"bold": F.lit(False), "eligible": F.lit(True), "confidence": F.lit(1_000_000).cast("long")}
    own = lines.select(*PAGE, *[F.col(c) if c in lines.columns else usual.get(c, F.lit(None).cast("string")).alias(c) for c in LINE]).where("x0 < x1 and y0 < y1 and length(trim(text)) > 0")
    own = own.fillna({"bold": False, "eligible": True, "confidence": 1_000_000, "size": 0})
    kinds = {**dict(own.dtypes), **{c: "bigint" for c in ("band", "column")}}
    nothing = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    fields = [*LINE, "band", "column"]
    both = own.select(*PAGE, *LINE, nothing("band"), nothing("column")).unionByName(bands.select(*PAGE, *[F.col(c).cast(kinds[c]) if c in ("band", "column", "x0", "x1", "y0", "y1") else nothing(c) for c in fields]))

    def work(key: tuple, page: list[dict]) -> list[tuple]:
        places = [r for r in page if r["band"] is not None]
        rows = [r for r in page if r["band"] is None]
        if not places or not rows:
            return []
        blocks = merged(page_roles(rows, places, key[1]))
        return [
            (*key, k, b["role"], b["role"] in REQUIRED, b["text"], b["x0"], b["y0"], b["x1"], b["y1"], *b["first"], b["ids"], *b["place"][:2], b["confidence"], b["size"], b["target"])
            for k, b in enumerate(blocks, 1)
        ]

    return by_group(both, PAGE, fields, work, BLOCKS)


def closing_sections(blocks: DataFrame, order: list[str]) -> DataFrame:
    """``blocks`` with the roles of what stands behind a heading of references (to the end) or of acknowledgements (to the next
    heading); such blocks are no longer required."""
    window = Window.partitionBy("doc_id").orderBy(*order)
    before, through = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.col("role") == "heading"
    opens = F.when(heading, F.when(F.col("text").rlike(REFERENCES), "r").when(F.col("text").rlike(ACKNOWLEDGEMENTS), "a").otherwise("-"))
    marked = blocks.withColumn("opens_", opens).withColumn("past_", F.coalesce(F.max(F.col("opens_") == "r").over(before), F.lit(False))).withColumn("open_", F.last("opens_", ignorenulls=True).over(through))
    entry = F.col("past_") & F.col("required")
    thanks = ~F.col("past_") & (F.col("open_") == "a") & F.col("required")
    role = F.when(entry, "reference-entry").when(thanks, "acknowledgements").otherwise(F.col("role"))
    return marked.withColumn("role", role).withColumn("required", F.col("required") & ~F.coalesce(entry | thanks, F.lit(False))).drop("opens_", "past_", "open_")
