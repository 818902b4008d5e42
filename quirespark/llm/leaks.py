"""Problem 7: documents that hold a passage of an evaluation item.

Texts are brought to words (and, for items in Chinese, to characters without punctuation) of the look-alike normal form
in lower case. One Aho-Corasick automaton holds every run of ``SEED_WORDS`` words and ``SEED_CHARS`` characters of all
items and scans a document once. A passage of n words of which at most one in eight is replaced always keeps such a run
unchanged, for every n from the least length on. Each hit names an item and a diagonal, on which the longest passage is
then measured exactly; offsets lead back to the given text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa

from quirespark.llm.lookalike import normal_points

LEAST_WORDS, LEAST_CHARS = 15, 30
SEED_WORDS, SEED_CHARS = 5, 6
ONE_IN = 8
WORD = re.compile(r"[^\W_]+")
HAN = re.compile("[㐀-鿿]")
MARKS = np.asarray([cp for cp in range(0x300, 0x3100) if unicodedata.combining(chr(cp))], np.int64)


def plain_texts(texts: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """The normal form of each text in lower case without marks, and the place of each character in the given text."""
    points, offsets, place = normal_points(texts, origin=True)
    keep = ~np.isin(points, MARKS)
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    points, place = points[keep], place[keep] if place is not None else points
    whole = points.astype("<u4").tobytes().decode("utf-32-le", "replace")
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = whole[a:b]
        low = own.lower()
        yield (low if len(low) == len(own) else "".join(c.lower()[:1] for c in own)), place[a:b]


def longest(same: np.ndarray, least: int) -> tuple[int, int] | None:
    """The longest stretch that begins and ends with a match, has ``least`` places and at most one in eight unlike."""
    hits = np.flatnonzero(same)
    if len(hits) * ONE_IN < least * (ONE_IN - 1):
        return None
    # of a stretch from hit i to hit j 7 n <= 8 m holds, n its places and m its matches, if a[j] >= a[i] - 1 for the a below;
    # the farthest such j of an i comes from the greatest a behind it, and only an i with a new least a can begin the longest
    a = ONE_IN * np.arange(len(hits)) - (ONE_IN - 1) * hits
    ahead = np.maximum.accumulate(a[::-1])[::-1]
    first = np.flatnonzero(a == np.minimum.accumulate(a))
    last = len(a) - 1 - np.searchsorted(ahead[::-1], a[first] - 1)
    n = hits[last] - hits[first] + 1
    k = int(np.argmax(n))
    return (int(hits[first[k]]), int(hits[last[k]]) + 1) if n[k] >= least else None


class Items:
    """items: (item_id, lang, text)."""

    def __init__(self, items: Iterable[tuple[int, str | None, str | None]]) -> None:
        rows = [(i, lang, t) for i, lang, t in items if t]
        self.automaton = ahocorasick.Automaton()
        self.texts: list[tuple[int, bool, list[str]]] = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for (item, _, _), (text, _) in zip(rows, plain_texts(pa.array([t for _, _, t in rows], pa.string())), strict=True):
            words = WORD.findall(text)
            signs = list("".join(words))
            chinese = sum(map(bool, map(HAN.match, signs))) * 2 > len(signs)
            own, size, form = (signs, SEED_CHARS, "".join) if chinese else (words, SEED_WORDS, lambda x: " " + " ".join(x) + " ")
            number = len(self.texts)
            self.texts.append((item, chinese, own))
            for k in range(len(own) - size + 1):
                seeds.setdefault(form(own[k : k + size]), []).append((number, k))
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (seed, tuple(places)))
        self.any = bool(seeds)
        self.automaton.make_automaton()

    def passages(self, text: str, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """item_id, start and end in the given text of the longest passage of each item in a plain text."""
        if not self.any:
            return
        words = WORD.findall(text)
        spaced, signs = " " + " ".join(words) + " ", "".join(words)
        chinese = HAN.search(signs) is not None
        lines = spaced + "\n" + signs if chinese else spaced
        diagonals: dict[tuple[int, int], None] = {}
        starts: dict[int, int] = {}
        for end, (seed, places) in self.automaton.iter(lines):
            first = end - len(seed) + 1
            if seed[0] == " ":
                if first >= len(spaced):
                    continue
                if not starts:
                    at = 0
                    for k, w in enumerate(words):
                        starts[at] = k
                        at += len(w) + 1
                first = starts[first]
            else:
                first -= len(spaced) + 1
                if first < 0:
                    continue
            for number, k in places:
                diagonals[number, first - k] = None
        best: dict[int, tuple[int, int, int]] = {}
        bounds = None
        for number, shift in diagonals:
            item, by_sign, own = self.texts[number]
            given = signs if by_sign else words
            a, b = max(0, -shift), min(len(own), len(given) - shift)
            same = np.fromiter((own[k] == given[k + shift] for k in range(a, b)), bool, max(0, b - a))
            found = longest(same, LEAST_CHARS if by_sign else LEAST_WORDS)
            if found is None:
                continue
            bounds = bounds or [m.span() for m in WORD.finditer(text)]
            first, last = found[0] + a + shift, found[1] + a + shift - 1
            if by_sign:
                flat = np.concatenate([np.arange(x, y) for x, y in bounds])
                start, end = int(flat[first]), int(flat[last])
            else:
                start, end = bounds[first][0], bounds[last][1] - 1
            size = found[1] - found[0]
            if size > best.get(item, (0, 0, 0))[0]:
                best[item] = (size, int(place[start]), int(place[end]) + 1)
        for item, (_, start, end) in best.items():
            yield item, start, end
