"""Problem 1: one form for texts that look the same but are made of other characters.

``normal_forms`` works on whole Arrow batches: the UTF-8 buffer is decoded once into an array of code points, every code
point is replaced by gathers from lookup tables (with expansion offsets, since a ligature yields several and an
invisible character none), marks are put in canonical order and composed with their letters by binary search in a
table of pairs. No string is touched on its own.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТХҮԌԚԜаеѕіјорсухһԁԛԝѵ"
CYRILLIC_AS = "ABESIJKMHOPCTXYGQWaesijopcyxhdqwv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ"
GREEK_AS = "ABEZHIKMNOPTYXCjovc"
ARMENIAN = "ՍՕհոսօցՏ"
ARMENIAN_AS = "UOhnuogS"
CHEROKEE = "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ"
CHEROKEE_AS = "ABCDEHJKLMPSTVWZ"
PALOCHKA = "Ӏӏ"
PALOCHKA_AS = "Il"
# Hyphens of other kinds, and line breaks of other kinds.
HYPHENS = "֊᠆‐‑⁃﹣－"
BREAKS = "\r\u0085\u2028\u2029\u000b\u000c"
# Invisible characters that the category Cf does not hold.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u2800\u3164\uffa0"
# Kinds of compatibility forms that look like their ordinary form.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
TOP = 0x110000
S_BASE, L_BASE, V_BASE, T_BASE = 0xAC00, 0x1100, 0x1161, 0x11A7


def letters_of_other_scripts() -> dict[int, int]:
    pairs = ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (PALOCHKA, PALOCHKA_AS))
    return {ord(a): ord(b) for own, latin in pairs for a, b in zip(own, latin, strict=True)}


class Tables:
    """size, start and flat: the code points that replace each code point; mark: its combining class; first, second and
    composed: pairs that make one letter, ordered by ``first << 21 | second``."""

    def __init__(self) -> None:
        latin = letters_of_other_scripts()
        plain: dict[int, tuple[int, ...]] = {}
        pairs: dict[int, int] = {}
        self.mark = np.zeros(TOP, np.uint8)

        def expand(cp: int) -> tuple[int, ...]:
            found = plain.get(cp)
            if found is None:
                ch = chr(cp)
                kind = unicodedata.category(ch)
                parts = unicodedata.decomposition(ch).split()
                if ch in BREAKS:
                    found = (10,)
                elif kind == "Zs" or ch == "\t":
                    found = (32,)
                elif (kind == "Cf" and not 0x600 <= cp <= 0x605 and cp not in (0x6DD, 0x70F)) or ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
                    found = ()
                elif ch in HYPHENS:
                    found = (45,)
                elif cp in latin:
                    found = (latin[cp],)
                elif parts and not S_BASE <= cp < S_BASE + 11172:
                    form = parts[0] if parts[0][0] == "<" else ""
                    own = [int(x, 16) for x in parts[bool(form) :]]
                    if form and (form not in SAME_LOOK or own[0] == 32 or ch in "…‥"):
                        found = (cp,)  # raised, circled and such forms look different; so do dots set as one glyph
                    else:
                        found = tuple(x for o in own for x in expand(o))
                else:
                    found = (cp,)
                plain[cp] = found
            return found

        size = np.ones(TOP, np.uint8)
        start = np.arange(TOP, dtype=np.int64)
        extra: list[int] = []
        for cp in range(TOP):
            if 0x20 <= cp < 0x7F or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xF900 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000 or cp >= 0xE0200:
                continue
            self.mark[cp] = unicodedata.combining(chr(cp))
            out = expand(cp)
            if out != (cp,):
                size[cp], start[cp] = len(out), TOP + len(extra)
                extra += out
        self.size, self.start = size, start
        self.flat = np.concatenate([np.arange(TOP, dtype=np.int64), np.asarray(extra, np.int64)])
        for cp in range(0xC0, 0x1F000):
            parts = unicodedata.decomposition(chr(cp)).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                a, b = expand(int(parts[0], 16)), expand(int(parts[1], 16))
                if len(a) == len(b) == 1:
                    pairs.setdefault(a[0] << 21 | b[0], cp)
                elif len(b) == 1:  # the first part is itself a composed letter
                    pairs.setdefault(int(parts[0], 16) << 21 | b[0], cp)
        self.pair = np.asarray(sorted(pairs), np.int64)
        self.composed = np.asarray([pairs[k] for k in sorted(pairs)], np.int64)
        self.joins = np.zeros(TOP, bool)  # code points that may be a pair's second part
        self.joins[self.pair & 0x1FFFFF] = True
        self.plain = (size == 1) & (start == np.arange(TOP)) & (self.mark == 0)
        self.joins[V_BASE : V_BASE + 21] = self.joins[T_BASE + 1 : T_BASE + 28] = True


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array, and the offsets of its rows in them (one more than rows); null as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    octets = np.frombuffer(raw, np.uint8)
    points = np.frombuffer(bytes(raw).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((octets & 0xC0) != 0x80)])
    return points.astype(np.int64), leads[offsets - offsets[0]]


def to_strings(points: np.ndarray, offsets: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    """The string array with these code points; rows where ``valid`` is false are null."""
    width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
    ends = np.concatenate([[0], np.cumsum(width)])[offsets].astype(np.int64)
    raw = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw))
    if valid is not None and valid.null_count:
        out = pc.if_else(pc.is_valid(valid), out, pa.nulls(len(out), pa.large_string()))
    return out.cast(pa.string())


def _compose(points: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Only rows that hold a mark (or a joining jamo) are worked on; the order of rows stays."""
    moves = t.joins[points] | (t.mark[points] > 0)
    if not moves.any():
        return points, row
    held = np.zeros(int(row[-1]) + 1, bool)
    held[row[moves]] = True
    mine = held[row]
    if mine.all():
        return _compose_all(points, row, t)
    own, own_row = _compose_all(points[mine], row[mine], t)
    points, row = np.concatenate([points[~mine], own]), np.concatenate([row[~mine], own_row])
    order = np.argsort(row, kind="stable")
    return points[order], row[order]


def _compose_all(points: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    mark = t.mark[points]
    inner = np.flatnonzero((mark[1:] > 0) & (mark[:-1] > mark[1:]) & (row[1:] == row[:-1]))
    if len(inner):  # canonical order: a stable sort by class within each run of marks
        run = np.cumsum(mark == 0)
        order = np.lexsort((mark, run))
        points, row, mark = points[order], row[order], mark[order]
    while True:
        n = len(points)
        seconds = np.flatnonzero(t.joins[points])
        seconds = seconds[seconds > 0]
        if not len(seconds):
            return points, row
        # the letter that a mark stands on: the last code point of class 0 before it
        place = np.where(t.mark[points] == 0, np.arange(n), 0)
        base = np.maximum.accumulate(place)
        before = base[seconds - 1]
        klass = t.mark[points[seconds]]
        between = t.mark[points[seconds - 1]]
        free = (before == seconds - 1) | ((between < klass) & (between > 0))
        free &= row[before] == row[seconds]
        free &= t.mark[points[before]] == 0
        key = points[before] << 21 | points[seconds]
        at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        made = np.where(t.pair[at] == key, t.composed[at], -1)
        lead, vowel = points[before] - L_BASE, points[seconds] - V_BASE
        hangul = (lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21)
        made = np.where(hangul, S_BASE + (lead * 21 + vowel) * 28, made)
        block, tail = points[before] - S_BASE, points[seconds] - T_BASE
        made = np.where((block >= 0) & (block < 11172) & (block % 28 == 0) & (tail > 0) & (tail < 28), points[before] + tail, made)
        good = free & (made >= 0)
        if not good.any():
            return points, row
        first = np.unique(before[good], return_index=True)[1]  # one mark a letter and pass, the first
        chosen = np.flatnonzero(good)[first]
        points = points.copy()
        points[before[chosen]] = made[chosen]
        keep = np.ones(n, bool)
        keep[seconds[chosen]] = False
        points, row = points[keep], row[keep]


def normal_points(texts: pa.Array, origin: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Code points and row offsets of the normal forms; with ``origin`` also each one's place in its own given text."""
    t = tables()
    points, offsets = code_points(texts)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    if len(points):  # \r\n is one line break
        pair = np.zeros(len(points), bool)
        pair[:-1] = (points[:-1] == 13) & (points[1:] == 10) & (row[:-1] == row[1:])
        size = np.where(pair, 0, t.size[points]).astype(np.int64)
        source = np.repeat(np.arange(len(points)), size)
        first = np.cumsum(size) - size
        points, row, place = t.flat[t.start[points[source]] + np.arange(len(source)) - first[source]], row[source], source - offsets[row[source]]
        if origin:
            return points, np.searchsorted(row, np.arange(rows + 1)), place
        points, row = _compose(points, row, t)
    return points, np.searchsorted(row, np.arange(rows + 1)), None


def normal_forms(texts: pa.Array) -> pa.Array:
    """The normal form of each text; null stays null, an empty text stays empty."""
    points, offsets = code_points(texts)
    t = tables()
    odd = np.concatenate([[0], np.cumsum(~t.plain[points] | t.joins[points] | (points == 13))])[offsets]
    mine = np.flatnonzero(odd[1:] > odd[:-1])  # the other rows are their own normal form
    if not len(mine):
        return texts.cast(pa.string())
    own = texts.take(pa.array(mine))
    made, ends, _ = normal_points(own)
    if len(mine) == len(texts):
        return to_strings(made, ends, texts)
    mask = np.zeros(len(texts), bool)
    mask[mine] = True
    return pc.replace_with_mask(texts.cast(pa.string()), pa.array(mask), to_strings(made, ends))


def normal_form(text: str) -> str:
    return normal_forms(pa.array([text], pa.string()))[0].as_py()
