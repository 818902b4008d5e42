"""Problem 4: text that was decoded with the wrong encoding.

A chain is a list of steps (wrong, right): the text's characters are written back to bytes by ``wrong`` and read again
by ``right``. Each step replaces the stretches of the text for which that is possible at all; the stretches of plain
text between them stay. A text's description length is the least size to which zstandard compresses it over the
dictionaries of the languages, plus the cost of its chain. The chain of least total length wins; where that is the
empty chain, the text stays as it is.
"""

from __future__ import annotations

import re
from functools import lru_cache

import zstandard

from quirespark.llm.lookalike import tables

# Encodings of one byte a character, and of several, that text is commonly misread by.
SINGLE = ("cp1252", "latin_1", "cp437", "mac_roman", "cp1251", "cp850", "cp1250", "iso8859_15", "koi8_r", "cp866")
DOUBLE = ("gb18030", "cp932", "big5", "euc_kr")
STEP_COST = 1  # bytes a step of the chain
BEAM = 3  # chains kept at a time
CONTEXT = 24
LEVEL = 19
LOST = "�"
CONTROLS = re.compile("[\x80-\x84\x86-\x9f]")
BEYOND_ASCII = re.compile("[^\x00-\x7f]+")
# a sequence of UTF-8 for one character beyond ASCII
SEQUENCE = rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}"
SEQUENCES = re.compile(b"(?:" + SEQUENCE + b")+")
TWO_BYTES = re.compile(rb"(?:[\xa1-\xa3\xb0-\xf7][\xa1-\xfe])+")
STRONG = re.compile(rb"(?:[\xe1-\xef][\x80-\xbf]{2}){4}")
EASTERN = re.compile("[\u1100-\u11ff\u3040-\u30ff\u3105-\u318f\u3400-\u9fff\uac00-\ud7a3\ue000-\uf8ff\uff66-\uff9f]")
IN_LATIN = re.compile("[A-Za-z][\u3400-\u9fff\uac00-\ud7a3\uff66-\uff9f]{1,3}[a-z]")
# Blocks whose characters may stand alone in restored text, and blocks of scripts that come in words.
ALONE = ((0x80, 0x17F), (0x192, 0x192), (0x2C6, 0x2DD), (0x300, 0x36F), (0x391, 0x3C9), (0x1E00, 0x1EFF), (0x2000, 0x22FF), (0x3000, 0x303F), (0x3400, 0x9FFF), (0xFB00, 0xFB06), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF))
IN_WORDS = ((0x400, 0x52F), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x3040, 0x30FF), (0xAC00, 0xD7A3))


def plausible(made: str) -> bool:
    """Whether restored characters can be text: of scripts that come in words at least two, and of one script."""
    words: dict[int, int] = {}
    for c in made:
        cp = ord(c)
        if cp < 0x80 or c == LOST or any(a <= cp <= z for a, z in ALONE):
            continue
        block = next((k for k, (a, z) in enumerate(IN_WORDS) if a <= cp <= z), -1)
        if block < 0:
            return False
        words[block] = words.get(block, 0) + 1
    return not words or (len(words) == 1 and min(words.values()) > 1)


def disguised(stretch: str) -> bool:
    """Whether the characters only look like plain letters; such a stretch was not decoded wrongly."""
    return all(map(_looks_plain, stretch))


def within_word(text: str, found: re.Match) -> bool:
    """Whether a stretch of Cyrillic letters alone goes on as a Cyrillic word."""
    if not found[0].isalpha() or not "\u0400" <= found[0][0] <= "\u052f":
        return False
    return any("\u0400" <= c <= "\u052f" for c in text[max(0, found.start() - 1) : found.start()] + text[found.end() : found.end() + 1])


@lru_cache(maxsize=100_000)
def _looks_plain(c: str) -> bool:
    t = tables()
    first = t.start[ord(c)]
    return bool((t.flat[first : first + t.size[ord(c)]] < 0x80).all())


@lru_cache(maxsize=None)
def byte_of(name: str) -> dict[str, int]:
    """The bytes from 0x80 of an encoding of one byte a character; bytes it leaves undefined stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


@lru_cache(maxsize=1)
def lost_forms() -> re.Pattern:
    """U+FFFD, and its UTF-8 read by another encoding: alone by one of one byte a character, twice in a row by one of several."""
    forms = {LOST}
    for name in SINGLE:
        table = {b: c for c, b in byte_of(name).items()}
        forms.add("".join(table[b] for b in LOST.encode()))
    for name in DOUBLE:
        made = (LOST * 2).encode().decode(name, "ignore")
        if len(made) >= 3:
            forms.add(made)
    return re.compile("|".join(map(re.escape, sorted(forms))))


@lru_cache(maxsize=None)
def pattern(name: str) -> re.Pattern:
    """Stretches of characters that stand for UTF-8 sequences in the encoding ``name``."""
    chars = {b: re.escape(c) for c, b in byte_of(name).items()}
    of = lambda a, z: "[" + "".join(chars[b] for b in range(a, z + 1)) + "]"
    more = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF3)}{more}{{3}})+")


@lru_cache(maxsize=None)
def runs(name: str) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(c) for c in byte_of(name)) + "]{2,}")


def _from_single(text: str, name: str) -> str | None:
    table = byte_of(name)
    hit = False

    def back(found: re.Match) -> str:
        nonlocal hit
        try:
            made = bytes(table[c] for c in found[0]).decode("utf-8")
        except UnicodeDecodeError:
            return found[0]
        if not plausible(made) or disguised(found[0]) or within_word(text, found):
            return found[0]
        hit = True
        return made

    made = pattern(name).sub(back, text)
    return made if hit else None


def _from_single_to_double(text: str, name: str, right: str) -> str | None:
    """Runs of even length that are whole characters of ``right``; one of three characters, or one of letters that is no
    part of a word, must be among them."""
    table = byte_of(name)
    good = False

    def back(found: re.Match) -> str:
        nonlocal good
        alone = found[0].isalpha() and not text[max(0, found.start() - 1) : found.start()].isalpha() and not text[found.end() : found.end() + 1].isalpha()
        raw = bytes(table[c] for c in found[0])
        out, at = [], 0
        for m in TWO_BYTES.finditer(raw):
            try:
                made = m[0].decode(right)
            except UnicodeDecodeError:
                continue
            if not plausible(made) or not any("\u3400" <= c <= "\u9fff" for c in made):
                continue
            good |= len(made) >= 3 or (alone and len(m[0]) == len(raw))
            out += [found[0][at : m.start()], made]
            at = m.end()
        return "".join([*out, found[0][at:]])

    made = runs(name).sub(back, text)
    return made if good and made != text else None


def _from_double(text: str, name: str) -> str | None:
    """Runs beyond ASCII written back by an encoding of several bytes a character.

    Four whole sequences of three bytes in a row somewhere, or a lost character, are evidence enough to take stretches of
    two; without it only a short run within a Latin word is taken, and only if it gives Latin letters.
    """
    strong = STRONG.search(text.encode(name, "replace")) is not None or LOST in text
    if not strong and not IN_LATIN.search(text):
        return None
    hit = False

    def back(found: re.Match) -> str:
        nonlocal hit
        run = found[0]
        raw = run.encode(name, "replace")
        if not SEQUENCES.search(raw):
            return run
        starts: dict[int, int] = {}
        at = 0
        for i, c in enumerate(run):
            starts[at] = i
            at += len(c.encode(name, "replace"))
        starts[at] = len(run)
        out, last, end = [], 0, len(raw)
        for m in SEQUENCES.finditer(raw):
            made = m[0].decode("utf-8")
            first = starts.get(m.start())
            stop = starts.get(m.end(), starts.get(m.end() + 1))
            if first is None or stop is None or first < last:
                continue
            if strong and sum(c > "\u07ff" for c in made) < 2:
                if (m.start(), m.end()) != (0, end) or not made.isalpha() or max(made) > "\u024f":
                    continue
            elif not strong and ((m.start(), m.end()) != (0, end) or not made.isalpha() or max(made) > "\u024f" or not text[found.start() - 1 : found.start()].isascii()):
                continue
            if not plausible(made) or disguised(run[first:stop]):
                continue
            out += [run[last:first], made]
            last = stop
            hit = True
        return "".join([*out, run[last:]])

    made = BEYOND_ASCII.sub(back, text)
    return made if hit else None


@lru_cache(maxsize=1)
def _worth() -> re.Pattern:
    """Two characters next to each other that one of the encodings of one byte a character has beyond ASCII."""
    chars = {c for n in SINGLE for c in byte_of(n)}
    return re.compile("[" + "".join(map(re.escape, sorted(chars))) + "]{2}")


def candidates(text: str) -> list[tuple[tuple[str, str], str]]:
    """Every step that changes ``text``, with what it makes."""
    found = []
    if _worth().search(text):
        for name in SINGLE:
            if pattern(name).search(text) and (made := _from_single(text, name)) is not None:
                found.append(((name, "utf_8"), made))
        for name in ("cp1252", "latin_1", "cp437", "mac_roman", "cp850"):
            if (made := _from_single_to_double(text, name, "gb18030")) is not None:
                found.append(((name, "gb18030"), made))
    if EASTERN.search(text):
        for name in DOUBLE:
            if (made := _from_double(text, name)) is not None:
                found.append(((name, "utf_8"), made))
    return found


class Mender:
    """dictionaries: trained zstandard dictionaries by language; none at all is allowed."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        trained = [zstandard.ZstdCompressionDict(x) for x in dictionaries.values() if x]
        for each in trained:
            each.precompute_compress(level=LEVEL)
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.compress = [zstandard.ZstdCompressor(level=LEVEL, **plain).compress]
        self.compress += [zstandard.ZstdCompressor(dict_data=x, **plain).compress for x in trained]

    def length(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(c(raw)) for c in self.compress)

    def gain(self, text: str, made: str) -> int:
        """Bytes saved by ``made``, over the stretch in which the two differ and the context beside it; what both share
        beyond that would only add the noise of block boundaries."""
        n = min(len(text), len(made))
        head = next((i for i in range(n) if text[i] != made[i]), n)
        tail = next((i for i in range(n - head) if text[-1 - i] != made[-1 - i]), n - head)
        head, tail = max(0, head - CONTEXT), max(0, tail - CONTEXT)
        return self.length(text[head : len(text) - tail]) - self.length(made[head : len(made) - tail])

    def mend(self, text: str) -> tuple[str, list[tuple[str, str]]]:
        """The text of least description length and its chain; the chain is empty where nothing is gained.

        A beam of chains is kept; every step makes the text shorter, so chains of any length end by themselves.
        """
        best, beam, seen = (0, 0, text, ()), [(0, 0, text, ())], {text}
        while beam:
            grown = []
            for saved, _, old, chain in beam:
                for k, (step, made) in enumerate(candidates(old)):
                    if made not in seen and len(made) < len(old) and (gain := self.gain(old, made)) > STEP_COST:
                        seen.add(made)
                        grown.append((saved + gain - STEP_COST, -k, made, (*chain, step)))
            beam = sorted(grown, reverse=True)[:BEAM]
            best = max([best, *beam], key=lambda found: found[0])
        return best[2], list(best[3])

    def damage(self, text: str | None) -> tuple[bool, str | None, str]:
        """Whether ``text`` holds a wrongly decoded sequence, the mended text where it changed, and the chain."""
        if not text or text.isascii():
            return False, None, ""
        made, chain = self.mend(text)
        lost = lost_forms().search(text) is not None or CONTROLS.search(text) is not None
        return bool(chain) or lost, made if chain else None, " ".join(f"{a}>{b}" for a, b in chain)


#: Bytes of a language's dictionary, and of the samples into which dictionaries are cut where they are merged.
SIZE, PIECE = 32_768, 256
#: Every sample trains, none is kept back to try the result on.
TRAINING = {"d": 8, "steps": 4, "split_point": 1.0}


def train(samples: list[bytes], size: int = SIZE) -> bytes | None:
    """A zstandard dictionary; none from too few samples."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, **TRAINING).as_bytes()
    except zstandard.ZstdError:
        return None


def merge(dictionaries: list[bytes], size: int = SIZE) -> bytes:
    """One dictionary of what several have in common; a single one stays as it is. Their headers are too rare among the
    pieces to be taken over. Training wants several times as much as it may keep, so the pieces come more than once."""
    if len(dictionaries) == 1:
        return dictionaries[0]
    pieces = [x[k : k + PIECE] for x in dictionaries for k in range(0, len(x), PIECE)]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, pieces))), pieces * 4, **TRAINING).as_bytes()
    except zstandard.ZstdError:
        return max(dictionaries, key=lambda x: (len(x), x))
