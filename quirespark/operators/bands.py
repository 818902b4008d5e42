"""Bands and columns of pages, page by page, then once more with what a document's sure pages agree on."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.grouped import by_group
from quirespark.sources.tables import cut

PAGE = ["doc_id", "page_number"]
# Least gutter and gap, most columns of a band, and the score from which a page counts as sure.
GUTTER, GAP, MOST, SURE = 12_000, 6_000, 3, 800_000
CROP = (0, 0, 595_276, 841_890)
BANDS = (
    "doc_id string, page_number int, band long, columns long, column long, x0 long, x1 long, y0 long, y1 long, ratio_ppm long, gutter_ppm long, "
    "support long, members array<string>, score long, page_score long"
)
Box = dict


def _islands(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(s for s in spans if s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _gaps(boxes: list[Box], low: str, high: str, least: int) -> list[tuple[int, int]]:
    parts = _islands([(b[low], b[high]) for b in boxes])
    return [(a[1], b[0]) for a, b in zip(parts, parts[1:], strict=False) if b[0] - a[1] >= least]


def _split(boxes: list[Box], low: str, high: str, least: int) -> list[list[Box]]:
    """The boxes between the gaps of an axis, each by its middle; empty parts are left out."""
    gaps = _gaps(boxes, low, high, least)
    parts: list[list[Box]] = [[] for _ in range(len(gaps) + 1)]
    for b in boxes:
        parts[sum((b[low] + b[high]) // 2 >= g[1] for g in gaps)].append(b)
    return [p for p in parts if p]


def _free(boxes: list[Box], left: int, right: int) -> int:
    """Of the occupied height, the millionths that no box across the gutter covers."""
    length = lambda some: sum(b - a for a, b in _islands([(x["y0"], x["y1"]) for x in some]))
    whole = length(boxes)
    across = length([b for b in boxes if b["x0"] < right and b["x1"] > left])
    return (whole - across) * 1_000_000 // whole if whole else 0


def _shares(widths: list[int]) -> list[int]:
    whole = sum(widths)
    out = [w * 1_000_000 // whole for w in widths]
    for k in sorted(range(len(widths)), key=lambda k: (-(widths[k] * 1_000_000 % whole), k))[: 1_000_000 - sum(out)]:
        out[k] += 1
    return out


def _starts(boxes: list[Box], near: int, apart: int) -> list[int]:
    """Left edges of columns: chains of near values by their least, greedily ``apart``."""
    edges = sorted(b["x0"] for b in boxes)
    heads = [e for k, e in enumerate(edges) if not k or e - edges[k - 1] > near]
    out: list[int] = []
    for e in heads:
        if not out or e - out[-1] >= apart:
            out.append(e)
    return out


def _lane(box: Box, starts: list[int], slack: int | None) -> int:
    """The column of a box: the nearest start, or with ``slack`` the last one that the box reaches but for that."""
    if slack is None:
        return min(range(len(starts)), key=lambda k: (abs(box["x0"] - starts[k]), k))
    return max([0, *(k for k in range(1, len(starts)) if box["x0"] >= starts[k] - slack)])


class PageModel:
    """One page: boxes (id, kind, size, text, x0 .. y1), its crop box, and the document's column starts if there are any."""

    def __init__(self, boxes: list[Box], page_number: int, template: list[int] | None = None, crop: tuple[int, int, int, int] = CROP) -> None:
        self.boxes, self.number, self.crop, self.template = boxes, page_number, crop, template
        width = crop[2] - crop[0]
        sizes = sorted(b["size"] for b in boxes if b["size"] and b["size"] > 0)
        self.size = sizes[len(sizes) // 2] if sizes else 10_000
        self.gutter, self.slack = max(GUTTER, width * 2 // 100), max(12_000, width * 25 // 1_000)
        self.wide = (max(b["x1"] for b in boxes) - min(b["x0"] for b in boxes)) * 52 // 100
        narrow = [b for b in boxes if b["x1"] - b["x0"] < self.wide]
        long = [b for b in narrow if b["kind"] == "line" and b["x1"] - b["x0"] >= 6 * self.size]
        self.starts = template or _starts(long or narrow or boxes, self.slack, max(60_000, width // 10))
        self.most_seen = len(self.starts)

    def front(self) -> tuple[int, int]:
        """Lower and upper edge of the title's part of a first page; empty (upper below lower) without one."""
        tops = [b["y1"] for b in self.boxes if b["kind"] == "line" and (b["text"] or "").strip().casefold().startswith(("abstract:", "abstract "))]
        low = max(tops, default=self.crop[3])
        titles = [b["y1"] for b in self.boxes if b["kind"] == "line" and b["y0"] > low and 4 * (b["size"] or 0) >= 5 * self.size and b["x1"] - b["x0"] >= self.wide]
        return low, max(titles, default=0) if self.number == 1 else 0

    def labelled(self) -> list[dict]:
        """Groups of boxes between white space, from the top, each with its number of columns (None: not known)."""
        low, high = self.front()
        several = len(self.starts) > 1
        out = []
        for own in reversed(_split(self.boxes, "y0", "y1", max(GAP, self.size * 3 // 4))):
            barrier = any(b["x1"] - b["x0"] >= self.wide for b in own)
            if high > low and all(b["kind"] == "line" and low <= b["y0"] < b["y1"] <= high for b in own):
                barrier |= max(b["x1"] for b in own) - min(b["x0"] for b in own) >= self.wide
            parts = len(_split(own, "x0", "x1", self.gutter))
            self.most_seen = max(self.most_seen, parts)
            lanes = {_lane(b, self.starts, self.slack if self.template else None) for b in own if b["x1"] - b["x0"] < self.wide}
            if barrier and several:
                label = 1
            elif parts > 1:
                label = min(MOST, parts)
            elif len(lanes) > 1:
                label = min(MOST, max(lanes) + 1)
            else:
                label = None if several else 1
            out.append({"boxes": own, "label": label, "barrier": barrier and several, "guessed": False, "low": min(b["y0"] for b in own), "high": max(b["y1"] for b in own)})
        return out

    def resolved(self) -> list[dict]:
        """The groups with unknown numbers taken from their neighbours, a run at a time."""
        groups = self.labelled()
        reach = max(30_000, 3 * self.size)
        done: list[dict] = []
        for unknown, run in groupby(groups, key=lambda g: g["label"] is None):
            own = list(run)
            if unknown:
                before = done[-1] if done else None
                after = next(iter(groups[len(done) + len(own) :]), None)
                left, right = (g["label"] if g and g["label"] > 1 else None for g in (before, after))
                if left and left == right:
                    label = left
                elif left:
                    label = left if before["low"] - own[0]["high"] <= reach else 1
                else:
                    label = right if right and own[-1]["low"] - after["high"] <= reach else 1
                own = [{**g, "label": label, "guessed": True} for g in own]
            done += own
        return done

    def single(self, own: list[Box]) -> list[dict]:
        left = min(b["x0"] for b in own)
        right = max(max(b["x1"] for b in own), self.crop[2] - max(0, left - self.crop[0]))
        return [{"x0": left, "x1": right, "ratio": 1_000_000, "gutter": None, "members": [b["id"] for b in own]}]

    def several(self, own: list[Box], count: int) -> tuple[list[dict], int]:
        """Columns of a band and its score; one column of a low score where the boxes don't bear them out."""
        starts = self.starts[:count] if len(self.starts) >= count else [min(b["x0"] for b in p) for p in _split(own, "x0", "x1", self.gutter)]
        lanes: list[list[Box]] = [[] for _ in starts]
        for b in own:
            lanes[_lane(b, starts, self.slack)].append(b)
        if len(starts) != count or not all(lanes):
            return self.single(own), 300_000
        lefts = [min(b["x0"] for b in lane) for lane in lanes]
        end = max(max(b["x1"] for b in own), self.crop[2] - max(0, lefts[0] - self.crop[0]))
        usual = max(self.gutter, (end - lefts[0]) * 35 // 1_000)
        room = [nxt - max(b["x1"] for b in lane) for lane, nxt in zip(lanes, lefts[1:], strict=False)]
        if any(r < self.gutter for r in room):
            return self.single(own), 300_000
        rights = [nxt - min(r, usual) for r, nxt in zip(room, lefts[1:], strict=True)] + [end]
        ratios = _shares([b - a for a, b in zip(lefts, rights, strict=True)])
        gutters = [_free(own, a, b) for a, b in zip(rights, lefts[1:], strict=False)] + [None]
        columns = [{"x0": a, "x1": b, "ratio": r, "gutter": g, "members": [x["id"] for x in lane]} for a, b, r, g, lane in zip(lefts, rights, ratios, gutters, lanes, strict=True)]
        support = min(map(len, lanes))
        return columns, 680_000 if support < 2 else min(990_000, 850_000 + min(120_000, 20_000 * support))

    def bands(self) -> list[dict]:
        """Bands from the top: columns, box and score."""
        out = []
        groups = self.resolved()
        for label, run in groupby(groups, key=lambda g: g["label"]):
            parts = list(run)
            own = sorted((b for p in parts for b in p["boxes"]), key=lambda b: (-b["y1"], b["x0"], b["id"]))
            if label == 1:
                columns = self.single(own)
                if len(self.starts) == 1:
                    score = {1: 650_000, 2: 760_000}.get(len(own), 950_000)
                else:
                    score = 920_000 if any(p["barrier"] for p in parts) else 780_000
            else:
                columns, score = self.several(own, label)
                if any(p["guessed"] for p in parts) and not self.template:
                    score = min(score, 780_000)
                if self.most_seen > MOST:
                    score = min(score, 300_000)
            out.append({"columns": columns, "y0": min(b["y0"] for b in own), "y1": max(b["y1"] for b in own), "score": score})
        return out

    def rows(self) -> list[tuple]:
        bands = self.bands()
        whole = min([b["score"] for b in bands] + [300_000] * (self.most_seen > MOST))
        return [(k, len(b["columns"]), c, col["x0"], col["x1"], b["y0"], b["y1"], col["ratio"], col["gutter"], len(col["members"]), col["members"], b["score"], whole) for k, b in enumerate(bands, 1) for c, col in enumerate(b["columns"], 1)]


FIELDS = ["id", "kind", "size", "text", "x0", "y0", "x1", "y1"]


def page_bands(boxes: DataFrame) -> DataFrame:
    """``BANDS``, a row a column of a band, of each page: doc_id, page_number, id, kind ('line' or other), size, text, x0 .. y1.

    ``boxes`` may have ``template`` (the document's column starts). Null boxes are dropped; pages without any give no row.
    """
    more = ["template"] if "template" in boxes.columns else []
    sound = boxes.where("x0 < x1 and y0 < y1").select(*PAGE, *FIELDS, *more)

    def work(key: tuple, page: list[dict]) -> list[tuple]:
        page.sort(key=lambda b: (-b["y1"], b["x0"], b["id"]))
        return [(*key, *row) for row in PageModel(page, key[1], page[0].get("template")).rows()]

    return by_group(sound, PAGE, [*FIELDS, *more], work, BANDS)


def document_template(bands: DataFrame, width: int = CROP[2]) -> DataFrame:
    """doc_id, template: the column starts that most sure pages of a document agree on.

    A page votes if its sure bands of two or three columns have one number of columns, with the band of most boxes. Two votes
    are needed, a tie has none, and starts that differ by more than 2.5 % of the width have none. Aggregates only, so a
    document of very many pages is no hot group but for its votes, of which there are three at most.
    """
    starts = F.array_sort(F.collect_list(F.struct("column", "x0")))
    each = bands.where(F.col("columns").between(2, MOST) & (F.col("score") >= SURE)).groupBy(*PAGE, "band").agg(F.max("columns").alias("columns"), F.max("score").alias("score"), F.sum("support").alias("n"), starts.alias("starts"))
    votes = each.groupBy(*PAGE).agg(F.min("columns").alias("columns"), F.max("columns").alias("most"), F.max(F.struct("n", "score", (-F.col("band")).alias("b"), "starts")).alias("v")).where("columns = most")
    lefts = F.transform("v.starts", lambda s: s["x0"])
    ends = [f(F.get(lefts, F.lit(k))).alias(f"{n}{k}") for k in range(MOST) for n, f in (("a", F.min), ("z", F.max))]
    counted = votes.groupBy("doc_id", "columns").agg(F.count("*").alias("votes"), *ends)
    order = Window.partitionBy("doc_id").orderBy(F.desc("votes"), "columns")
    ranked = counted.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("votes").over(order))
    near = max(12_000, width * 25 // 1_000)
    spread = F.greatest(*[F.coalesce(F.col(f"z{k}") - F.col(f"a{k}"), F.lit(0)) for k in range(MOST)])
    chosen = ranked.where((F.col("rank") == 1) & (F.col("votes") >= 2) & (F.coalesce("next", F.lit(0)) < F.col("votes")) & (spread <= near))
    return chosen.select("doc_id", F.slice(F.array(*[f"a{k}" for k in range(MOST)]), F.lit(1), F.col("columns").cast("int")).alias("template"))


def document_bands(boxes: DataFrame) -> DataFrame:
    """``BANDS`` of each page; pages that are not sure are tried again with their document's template, which is kept where it
    gives several columns and a better score."""
    first = cut(page_bands(boxes))  # read four times, and far smaller than the boxes
    unsure = first.where(F.col("page_score") < SURE).select(*PAGE, F.col("page_score").alias("before")).distinct()
    again = boxes.join(unsure, PAGE).join(document_template(first), "doc_id")
    retried = cut(page_bands(again).join(unsure, PAGE))
    better = retried.groupBy(*PAGE).agg(F.max("columns").alias("c"), F.max("page_score").alias("s"), F.max("before").alias("b")).where("c > 1 and s > b").select(*PAGE)
    return first.join(better, PAGE, "left_anti").unionByName(retried.join(better, PAGE, "left_semi").drop("before"))
