"""Sizes, line breaks, runs and pages."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quirespark.operators.grouped import by_group

# What may not begin or end a line, and tokens that are not broken.
NOT_FIRST = "，。、；：！？）》」』】〕〉”’…％%℃°,.!?;:)]}"
NOT_LAST = "（《「『【〔〈“‘([{¥$£€"
BREAK_AFTER = "/?&#=._-"
URL = re.compile(r"(?i)(?:https?://|www\.|doi:\s*|10\.\d{4,9}/)[^\s，。；！？）》】]+")
WHOLE = re.compile(r"(?i)\[(?:\d+(?:\s*[-–—,;]\s*\d+)*)\]|(?:p|n)\s*[=<>≤≥]\s*[+-]?(?:\d+(?:\.\d+)?|\.\d+)|[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:\s*[-–—]\s*[+-]?\d+(?:\.\d+)?)?(?:\s*(?:mmHg|k?Pa|MPa|kg|mg|[µμ]g|ng|pg|mm|cm|km|mL|[µμ]L|mmol|[µμ]mol|mol|k?Hz|MHz|°C|℃|min|ms|days?|years?|h|s|m|g|L|K|%))?")
LATIN = re.compile(r"[A-Za-zÀ-ɏͰ-Ͽ]+(?:['’-][A-Za-zÀ-ɏͰ-Ͽ]+)*")
# Role, size and line height in thousandths of a point (body 11 000; leading 140 %).
STYLES = {"title": 17_600, "heading": 13_200, "body": 11_000, "abstract": 11_000, "keywords": 11_000, "figure-caption": 10_120, "table-caption": 10_120, "footnote": 10_120, "note": 10_000}


def body_size(samples: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body_size: of the sizes near the median, the one of most characters (ties: nearer to it, then smaller).

    ``samples``: key, size_mpt, characters. Near is within 500, 15 % of the median and three times the median deviation,
    whichever is most. Rows with nulls or nothing positive are dropped.
    """
    sound = samples.select(key, "size_mpt", "characters").dropna().where("size_mpt > 0 and characters > 0")
    centre = sound.groupBy(key).agg(F.median("size_mpt").alias("centre"))
    off = sound.join(centre, key).withColumn("off", F.abs(F.col("size_mpt") - F.col("centre")))
    reach = off.groupBy(key).agg(F.greatest(F.lit(500.0), F.max("centre") * 0.15, F.median("off") * 3.0).alias("reach"))
    weights = off.join(reach, key).where("off <= reach").groupBy(key, "size_mpt").agg(F.sum("characters").alias("w"), F.max("off").alias("off"))
    best = F.min(F.struct((-F.col("w")).alias("less"), "off", "size_mpt"))
    return weights.groupBy(key).agg(best.alias("b")).select(key, F.col("b.size_mpt").cast("long").alias("body_size"))


def styles(spark) -> DataFrame:
    """role, size_mpt, leading_mpt of every role."""
    return spark.createDataFrame([(r, s, s * 140 // 100) for r, s in STYLES.items()], "role string, size_mpt long, leading_mpt long")


def clusters(text: str) -> list[str]:
    """Characters with what must stay with them: marks, selectors, modifiers, joined emoji, pairs of flag letters."""
    out: list[str] = []
    flags = 0
    for c in text:
        cp = ord(c)
        mark = unicodedata.combining(c) or unicodedata.category(c) in ("Mc", "Me") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x1F3FB <= cp <= 0x1F3FF or cp == 0x200D
        flag = 0x1F1E6 <= cp <= 0x1F1FF
        if out and (mark or out[-1].endswith("‍") or (flag and flags == 1)):
            out[-1] += c
            flags = 2 if flag and flags == 1 else 0
        else:
            out.append(c)
            flags = int(flag)
    return out


@F.pandas_udf(ArrayType(StringType()))
def grapheme_clusters(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else clusters(t))


def default_width(text: str, size: int) -> int:
    """A width without fonts: full for East Asian characters, half for others, none for marks."""
    units = sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)
    return -(-units * size // 2)


def pieces(text: str) -> list[str]:
    """What may not be broken: words, numbers with units, citations, parts of addresses, single clusters; blanks go with
    what is before them, and marks that may not begin or end a line with their neighbour."""
    raw: list[str] = []
    at = 0
    while at < len(text):
        url = URL.match(text, at)
        if url:
            raw += re.findall(f"[^{re.escape(BREAK_AFTER)}]*[{re.escape(BREAK_AFTER)}]|[^{re.escape(BREAK_AFTER)}]+", url[0])
            at = url.end()
            continue
        hit = WHOLE.match(text, at) or LATIN.match(text, at)
        piece = hit[0] if hit and hit[0] else clusters(text[at : at + 16])[0]
        raw.append(piece)
        at += len(piece)
    out: list[str] = []
    for piece in raw:
        if out and (piece.isspace() or piece[0] in NOT_FIRST or out[-1].rstrip()[-1:] in tuple(NOT_LAST)):
            out[-1] += piece
        else:
            out.append(piece)
    return out


def broken(text: str | None, width: int, size: int, measure: Callable[[str, int], int] = default_width) -> list[str] | None:
    """Lines of at most ``width``, each as long as possible; a piece that is too wide alone is broken between clusters.

    Null gives null; blank lines are dropped; line feeds in the text always break.
    """
    if text is None:
        return None
    lines: list[str] = []
    for part in text.splitlines():
        line = ""
        for piece in pieces(part.strip()) if part.strip() else ():
            if line and measure((line + piece).rstrip(), size) > width:
                lines.append(line.rstrip())
                line = ""
            if measure(piece.rstrip(), size) > width:
                for c in clusters(piece):
                    if line and measure(line + c, size) > width:
                        lines.append(line)
                        line = ""
                    line += c
            else:
                line += piece
        if line.strip():
            lines.append(line.rstrip())
    return lines


def line_breaks(frame: DataFrame, text: str, width: int, size: int = 11_000) -> DataFrame:
    """``frame`` with ``lines``: each text broken at ``width``. Equal texts are broken once a batch."""

    @F.pandas_udf(ArrayType(StringType()))
    def wrap(texts: pd.Series) -> pd.Series:
        known = {t: broken(t, width, size) for t in texts.unique()}
        return texts.map(known)

    return frame.withColumn("lines", wrap(text))


def font_runs(frame: DataFrame, key: list[str], text: str, faces: dict[str, str]) -> DataFrame:
    """key, run, face, run_text: neighbouring clusters of one face. ``faces``: name and a character class that it covers,
    first fit; clusters of no face have face null."""
    each = frame.select(*key, F.posexplode(grapheme_clusters(F.col(text))).alias("i", "c"))
    face = F.coalesce(*[F.when(F.col("c").rlike(f"^{pattern}"), F.lit(name)) for name, pattern in faces.items()])
    window = Window.partitionBy(*key).orderBy("i")
    marked = each.withColumn("face", face).withColumn("new_", F.when(F.col("face").eqNullSafe(F.lag("face").over(window)) & (F.col("i") > 0), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("new_").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return numbered.groupBy(*key, "run").agg(F.max("face").alias("face"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), "").alias("run_text"))


def rounded_widths(parts: DataFrame, keys: list[str], order: list[str], width: str) -> DataFrame:
    """``parts`` with ``x`` and ``advance``: the running sum is rounded up and not each part, so nothing drifts."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.ceil(F.sum(width).over(window)).cast("long")
    summed = parts.withColumn("end_", end)
    before = F.coalesce(F.lag("end_").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0)).cast("long")
    return summed.withColumn("x", before).withColumn("advance", F.col("end_") - F.col("x")).drop("end_")


def font_usage(parts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, runs, characters: how often and for how many characters each font is used."""
    return parts.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum(F.length(text)).cast("long").alias("characters"))


def paginated(flows: DataFrame, key: str, order: str, page_height: int, gap: int, keep_with_next: int = 2) -> DataFrame:
    """key, id, part, page, line_start, line_end: flows of lines placed one after the other on pages.

    ``flows``: key, order, id, role, lines (count), line_height. A heading goes to the next page if it does not fit there
    with the next ``keep_with_next`` lines. Where a line is higher than a page the document gives no row. Every placement
    depends on those before, so a document is one group.
    """

    def place(name: tuple, rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (r[order], r["id"]))
        out, page, top = [], 1, 0
        for k, f in enumerate(rows):
            height, lines = f["line_height"], f["lines"]
            if height > page_height:
                return []
            top += gap if top else 0
            done = part = 0
            while done < lines:
                if done == 0 and f["role"] == "heading":
                    need, left = lines * height, keep_with_next
                    for n in rows[k + 1 :]:
                        take = min(left, n["lines"])
                        need += gap + take * n["line_height"]
                        left -= take
                        if not left:
                            break
                    if top and need <= page_height < top + need:
                        page, top = page + 1, 0
                fit = min(lines - done, (page_height - top) // height)
                if fit > 0:
                    out.append((*name, f["id"], part, page, done, done + fit))
                    done, part, top = done + fit, part + 1, top + fit * height
                if done < lines:
                    page, top = page + 1, 0
        return out

    kind = flows.schema[key].dataType.simpleString()
    sound = flows.select(key, order, "id", "role", F.col("lines").cast("long").alias("lines"), F.col("line_height").cast("long").alias("line_height")).where("lines > 0 and line_height > 0")
    return by_group(sound.where(F.col(order).isNotNull()), [key], [order, "id", "role", "lines", "line_height"], place, f"{key} {kind}, id string, part long, page long, line_start long, line_end long")
