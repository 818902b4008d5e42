"""Problem 5: pairs of sentences that render each other.

A concept is a unit given in both languages. A sentence is represented by its similarities to the concepts' texts in its
own language; as the concepts are shared, such vectors compare across languages. Numbers, names in Latin letters and
symbols, which a rendering keeps, are concepts of their own. A vector has length 1; entries far below its greatest are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,:]\d+)*|[%°±<>=]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
HAN = re.compile("[㐀-鿿]+")
NAME = re.compile(r"[A-ZÀ-ÞĀ-Ž][^\W\d_]{2,}")
KEPT = -1  # concepts of kept tokens are negative
LEAST_ENTRY = 0.1  # of the greatest entry of a vector
#: Signs that both languages write alike, by what they stand for.
SIGNS = {"?": "q", "？": "q", "!": "e", "！": "e", "%": "%", "±": "±", "<": "<", "°": "°"}
PERCENT = re.compile(r"percent|百分之")


def kept(text: str) -> Counter[str]:
    """Tokens that a rendering keeps as they are: numbers, names and signs."""
    found = Counter(x.replace(",", "") for x in NUMBER.findall(text))
    found.update(x.lower() for part in NAME.findall(text) for x in [part])
    found.update("sign " + v for c, v in SIGNS.items() if c in text)
    if PERCENT.search(text):
        found["sign %"] += 1
    return found


def own_terms(text: str, han: bool) -> list[str]:
    """Terms of one language: words and pairs of words, or pairs of ideographs."""
    if han:
        return [run[i : i + 2] for run in HAN.findall(text) for i in range(len(run) - 1)] + [run for run in HAN.findall(text) if len(run) == 1]
    words = [w for w in WORDS.findall(text.lower()) if not w[0].isdigit()]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


class Side:
    """Terms of one language with their weights in each concept."""

    def __init__(self, texts: list[str], han: bool, least: int = 2) -> None:
        self.han, n = han, max(1, len(texts))
        bags = [Counter(own_terms(t, han)) for t in texts]
        df = Counter(x for b in bags for x in b)
        self.index = {t: k for k, t in enumerate(sorted(t for t, c in df.items() if c >= least))}
        self.idf = np.asarray([np.log(n / df[t]) + 0.05 for t in sorted(self.index)], np.float32)
        self.weights = np.zeros((len(self.index), len(texts)), np.float32)
        for k, bag in enumerate(bags):
            own = [(self.index[t], c) for t, c in bag.items() if t in self.index]
            if own:
                at = np.asarray([a for a, _ in own])
                w = self.idf[at] * np.sqrt(np.asarray([c for _, c in own], np.float32))
                self.weights[at, k] = w / max(1e-6, float(np.linalg.norm(w)))

    def likeness(self, text: str) -> np.ndarray:
        """What a text shares with each concept, up to a factor; that of two texts together is the sum of theirs."""
        index = self.index
        own = [index[t] for t in own_terms(text, self.han) if t in index]
        if not own:
            return np.zeros(self.weights.shape[1], np.float32)
        return self.idf[own] @ self.weights[own]


class Concepts:
    """pairs: (source, target) texts of the concept units; bounded by whoever chooses them."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.source = Side([a for a, _ in pairs], han=False)
        self.target = Side([b for _, b in pairs], han=True)

    def parts(self, text: str, side: str) -> tuple[np.ndarray, Counter[str]]:
        """What the vector of a sentence is made of; parts of neighbours add up to those of their window."""
        return (self.source if side == "source" else self.target).likeness(text), kept(text)

    @staticmethod
    def vector(likeness: np.ndarray, tokens: Counter[str], least: float = LEAST_ENTRY, share: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of every concept with a weight of at least ``least`` of the greatest one's, and of kept tokens,
        which weigh ``share`` at most."""
        like = likeness * likeness
        top = np.flatnonzero(like >= least * max(1e-12, float(like.max(initial=0))))
        size = sum(tokens.values()) ** 0.5
        b = share * min(1.0, len(tokens) / 2) if size else 0.0
        own = like[top]
        own *= (1 - b * b) ** 0.5 / max(1e-9, float(np.linalg.norm(own)))
        keyed = {_token_key(t): b * c**0.5 / size for t, c in tokens.items()}
        ids = np.concatenate([top, np.fromiter(keyed, np.int64, len(keyed))]).astype(np.int32)
        return ids, np.concatenate([own, np.fromiter(keyed.values(), np.float64, len(keyed))]).astype(np.float32)


@lru_cache(maxsize=200_000)
def _token_key(token: str) -> int:
    return KEPT - zlib.crc32(token.encode()) % 2**30


def spans(count: int, widest: int = 2) -> list[tuple[int, int]]:
    """First sentence and number of sentences of each window."""
    return [(i, n) for n in range(1, widest + 1) for i in range(count - n + 1)]


def choose(singles: dict[tuple[int, int], float], merged_source: dict[tuple[int, int], float], merged_target: dict[tuple[int, int], float], least: float, gain: float) -> set[tuple[int, int]]:
    """Pairs of sentence numbers: mutual bests of single sentences, and windows that beat their best single by ``gain``.

    merged_source: likeness of the sources i, i + 1 together with target j; merged_target: of source i with j, j + 1.
    """
    best_row: dict[int, tuple[float, int]] = {}
    best_column: dict[int, tuple[float, int]] = {}
    for (i, j), v in singles.items():
        best_row[i] = max(best_row.get(i, (v, -j)), (v, -j))
        best_column[j] = max(best_column.get(j, (v, -i)), (v, -i))
    found = {(i, j) for (i, j), v in singles.items() if v >= least and best_row[i] == (v, -j) and best_column[j] == (v, -i)}
    taken_rows, taken_columns = {i for i, _ in found}, {j for _, j in found}
    extra = set()
    for (i, j), v in merged_source.items():
        a, b = (i, j) in found, (i + 1, j) in found
        if a != b and v >= least:
            other = i + 1 if a else i
            if other not in taken_rows and v >= singles.get((i if a else i + 1, j), 0) + gain:
                extra.add((other, j))
    for (i, j), v in merged_target.items():
        a, b = (i, j) in found, (i, j + 1) in found
        if a != b and v >= least:
            other = j + 1 if a else j
            if other not in taken_columns and v >= singles.get((i, j if a else j + 1), 0) + gain:
                extra.add((i, other))
    return found | extra


def concept_pairs(units: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted({(a, b) for a, b in units if a and b})
