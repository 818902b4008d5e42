"""Lines of a page from its glyphs: segments of clusters, display formulae parted from prose, small marks at their host.

A glyph is a dict of id, text, x0, y0, x1, y1, font_size_mpt and font_name; a segment is a list of glyphs. What a mark joins
depends on marks joined before, so a page is worked on as one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

Glyph = dict
Segment = list[Glyph]
# Signs of a display formula, what may be raised, set between letters or lowered.
FORMULA_SIGNS = "=→"
RAISED_SIGNS = "®+−"
DIGITS = "0123456789"
RAISED_NUMBER = re.compile(r"[+−-]?\d{1,3}(?:/\d{1,2})?[+−-]?")
LOWERED = re.compile(r"(?:\d{1,3}(?:/\d{1,2})?|[a-z]{1,3})[,;]?")
WORD = re.compile("[A-Za-z]{4,}")


def clusters(page: list[Glyph]) -> list[int]:
    """For each glyph, in the order of ``by_height``, the number of the cluster it joins: the first one whose first member's
    middle is near enough. Clusters are kept by their middles, so only those within reach are looked at."""
    firsts: list[tuple[int, int, int]] = []  # middle, number, size
    found = []
    for c in page:
        middle, size = (c["y0"] + c["y1"]) // 2, c["font_size_mpt"]
        reach = max(2000, size // 4)
        low, high = bisect_left(firsts, (middle - reach,)), bisect_right(firsts, (middle + reach, len(page)))
        near = [n for m, n, s in firsts[low:high] if abs(middle - m) <= max(2000, min(size, s) // 4)]
        number = min(near, default=len(firsts))
        if not near:
            firsts.insert(bisect_left(firsts, (middle, number)), (middle, number, size))
        found.append(number)
    return found


def by_height(page: list[Glyph]) -> list[Glyph]:
    return sorted(page, key=lambda c: (-c["y1"], c["x0"], c["id"]))


def _along(segment: Segment) -> Segment:
    return sorted(segment, key=lambda c: (c["x0"], c["y0"], c["id"]))


def joined(segment: Segment) -> str:
    """The glyphs' text with a blank for every gap of a word."""
    out = []
    for k, c in enumerate(segment):
        if k and c["x0"] - segment[k - 1]["x1"] > max(800, 3 * min(segment[k - 1]["font_size_mpt"], c["font_size_mpt"]) // 20):
            out.append(" ")
        out.append(c["text"])
    return "".join(out).strip()


def segments(page: list[Glyph]) -> Iterator[Segment]:
    """Stretches of clusters without a gap of more than 6000 and the larger size; blank ones are dropped."""
    groups: dict[int, Segment] = {}
    ordered = by_height(page)
    for c, number in zip(ordered, clusters(ordered), strict=True):
        groups.setdefault(number, []).append(c)
    for _, group in sorted(groups.items()):
        row = _along(group)
        cuts = [k for k in range(1, len(row)) if row[k]["x0"] - row[k - 1]["x1"] > max(6000, row[k]["font_size_mpt"], row[k - 1]["font_size_mpt"])]
        for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True):
            if joined(row[a:b]):
                yield row[a:b]


def parted(segment: Segment, signs: Segment) -> list[Segment]:
    """A segment in two where prose meets a display formula: another font (or a colon) begins, no word follows, and a sign of
    a formula stands near on the same height outside of the segment."""
    own = {c["id"] for c in segment}
    right = segment[-1]["x1"] + 40_000
    outside = [s for s in signs if s["id"] not in own]
    for k in range(1, len(segment)) if outside else ():
        c = segment[k]
        before = joined(segment[:k])
        if c["text"].isspace() or (c["font_name"] == segment[k - 1]["font_name"] and not before.endswith(":")):
            continue
        if not WORD.search(before) or WORD.search(joined(segment[k:])):
            continue
        if any(c["x0"] <= s["x0"] <= right and abs(s["y0"] + s["y1"] - c["y0"] - c["y1"]) <= 30_000 for s in outside):
            return [segment[:k], segment[k:]]
    return [segment]


def _shared(a: Glyph, b: Glyph) -> int:
    return max(0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))


def _height(c: Glyph) -> int:
    return c["y1"] - c["y0"]


def _half_shared(mark: Glyph, host: Glyph) -> bool:
    return 2 * _shared(mark, host) >= min(_height(mark), _height(host))


def _within(gap: int, size: int) -> bool:
    return -max(250, size // 20) <= gap <= max(500, size // 4)


def _raised(mark: Glyph, host: Glyph) -> tuple | None:
    """How far a raised mark is from the glyph before it, or None if it is none of its marks."""
    above = (mark["y0"] + mark["y1"]) // 2 - (host["y0"] + host["y1"]) // 2
    gap = mark["x0"] - host["x1"]
    small = 10 * mark["font_size_mpt"] <= 9 * host["font_size_mpt"]
    good = small and above > max(500, mark["font_size_mpt"] // 10) and _half_shared(mark, host) and _within(gap, host["font_size_mpt"])
    return (abs(gap), -_shared(mark, host)) if good else None


def _between(mark: Glyph, left: Glyph, right: Glyph) -> tuple | None:
    """The same for a mark set low between two letters or digits."""
    size = min(left["font_size_mpt"], right["font_size_mpt"])
    middle = sum(g[y] for g in (left, right) for y in ("y0", "y1")) // 4
    gaps = mark["x0"] - left["x1"], right["x0"] - mark["x1"]
    low = (mark["y0"] + mark["y1"]) // 2 < middle - max(500, mark["font_size_mpt"] // 10)
    good = left["text"][-1:].isalnum() and right["text"][:1].isalnum() and 10 * mark["font_size_mpt"] <= 9 * size and low
    good = good and all(_half_shared(mark, g) for g in (left, right)) and all(_within(g, size) for g in gaps)
    return (abs(gaps[0]) + abs(gaps[1]), abs(gaps[0])) if good else None


def _neighbours(mark: Glyph, part: Segment) -> Iterator[tuple | None]:
    row = sorted(part, key=lambda c: (c["x0"], c["id"]))
    return (_between(mark, a, b) for a, b in zip(row, row[1:], strict=False))


def _lowered(mark: Glyph, host: Glyph) -> tuple | None:
    """The same for a low suffix."""
    gap = mark["x0"] - host["x1"]
    small = 10 * mark["font_size_mpt"] <= 8 * host["font_size_mpt"] and (host["text"][-1:].isalnum() or host["text"] == ")")
    low = mark["y0"] + mark["y1"] < host["y0"] + host["y1"] - 1000 and 2 * _shared(mark, host) >= _height(mark)
    return (abs(gap),) if small and low and -500 <= gap <= max(500, host["font_size_mpt"] // 4) else None


def _nearest(parts: list[Segment], away: Callable[[Segment], Iterator[tuple | None]]) -> int | None:
    """The segment of the least distance, the first of equally near ones."""
    best = min(((*d, k) for k, part in enumerate(parts) if part for d in away(part) if d is not None), default=None)
    return best[-1] if best else None


def _host(mark: Glyph, parts: list[Segment]) -> int | None:
    text = mark["text"]
    number = RAISED_NUMBER.fullmatch(text) is not None
    found = None
    if text in RAISED_SIGNS or number:
        found = _nearest(parts, lambda part: (_raised(mark, c) for c in part))
    if found is None and len(text) == 1 and text in DIGITS:
        found = _nearest(parts, lambda part: _neighbours(mark, part))
    if found is None and LOWERED.fullmatch(text):
        found = _nearest(parts, lambda part: (_lowered(mark, c) for c in part))
    return found


def attached(parts: list[Segment]) -> list[Segment]:
    """Segments that are one small mark join the segment they stand at; what such a mark had parted is joined again."""
    parts = [list(p) for p in parts]
    for k in range(len(parts)):
        own = parts[k]
        text = joined(own) if own else ""
        if not own or not (len(own) == 1 or (len(own) <= 6 and (RAISED_NUMBER.fullmatch(text) or LOWERED.fullmatch(text)))):
            continue
        mark = own[0] if len(own) == 1 else {**own[0], "text": text, **{c: f(g[c] for g in own) for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max), ("font_size_mpt", max))}}
        at = _host(mark, parts)
        if at is None or at == k:
            continue
        parts[at] = _along(parts[at] + own)
        parts[k] = []
        largest = max(parts[at], key=lambda c: c["font_size_mpt"])
        for j, other in enumerate(parts):
            if other and j != at:
                gap = other[0]["x0"] - max(c["x1"] for c in parts[at])
                if 0 <= gap <= max(500, largest["font_size_mpt"] // 3) and abs(other[0]["y0"] - largest["y0"]) <= 500 and other[0]["font_size_mpt"] == largest["font_size_mpt"]:
                    parts[at] = parts[at] + other
                    parts[j] = []
    return [p for p in parts if p]


def page_lines(page: list[Glyph]) -> list[Segment]:
    """The lines of a page from the top, each a list of its glyphs in order."""
    signs = [c for c in page if c["text"] in FORMULA_SIGNS and c["text"]]
    parts = [p for s in segments(page) for p in parted(s, signs)]
    return sorted(attached(parts), key=lambda p: (-max(c["y1"] for c in p), min(c["x0"] for c in p), [c["id"] for c in p]))
