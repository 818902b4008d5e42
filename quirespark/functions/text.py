"""Column factories for text: normal forms, counts, tokens, quotes and ratios.

All are native expressions but NFC and case folding, for which Spark has none: those run once, as Arrow batches. A null
text gives null; an empty text gives an empty result or a count of 0.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as Unicode text splitting has it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
CHINESE_DIGITS = "一二两三四五六七八九"
CHINESE_VALUES = "122345678"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def collapse(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def compact(text: Column, maximum: int, fold: bool = False) -> Column:
    """Bounded one-line text; null where it is empty, longer than ``maximum`` or holds a control character."""
    short = collapse(nfc(text))
    short = casefold(short) if fold else short
    return F.when(F.length(short).between(1, maximum) & ~short.rlike(r"\p{Cc}"), short)


def tag_set(tags: Column, maximum: int = 48, most: int = 8) -> Column:
    """Distinct tags in order, lower case; null unless there are 1 to ``most`` and all are valid."""
    short = F.transform(tags, lambda t: F.lower(collapse(t)))
    own = F.array_sort(F.array_distinct(short))
    sound = F.forall(own, lambda t: F.length(t).between(1, maximum) & ~t.rlike(r"\p{Cc}"))
    return F.when(F.size(own).between(1, most) & sound, own)


def line_signature(text: Column) -> Column:
    """What a repeated line is known by: lower case, single blanks, every number as #."""
    return F.regexp_replace(F.lower(collapse(text)), r"\d+", "#")


def marker_text(text: Column) -> Column:
    """Text without extraction artefacts: ligatures as letters, glyph placeholders dropped with a number behind them."""
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\(cid:\d+\)\s*\d+", ""), r"(?i)\(cid:\d+\)", "")


def number_form(number: Column) -> Column:
    """One form of a number: no thousands separators, a plain minus, a 0 before a leading point."""
    plain = F.replace(F.replace(number, F.lit(","), F.lit("")), F.lit("−"), F.lit("-"))
    return F.regexp_replace(plain, r"^([+-]?)\.", "$10.")


def chinese_integer(text: Column) -> Column:
    """Chinese numerals up to 99 as a number; null where the text is none."""
    digit = lambda c: F.translate(c, CHINESE_DIGITS, CHINESE_VALUES).cast("int")
    tens, ones = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
    with_ten = F.when(tens == "", 1).otherwise(digit(tens)) * 10 + F.when(ones == "", 0).otherwise(digit(ones))
    return F.when(text.contains("十") & (F.length(tens) <= 1) & (F.length(ones) <= 1), with_ten).when(F.length(text) == 1, digit(text))


def joined_fragments(fragments: Column) -> Column:
    """Fragments in order as one text: a fragment that ends with a hyphen loses it and is joined tightly, others by a blank."""
    return F.aggregate(
        fragments,
        F.lit(None).cast("string"),
        lambda text, part: F.when(text.isNull(), part).when(text.endswith("-"), F.concat(F.regexp_replace(text, "-$", ""), part)).otherwise(F.concat(text, F.lit(" "), part)),
    )


def visible_characters(text: Column) -> Column:
    """Characters that are neither white space nor punctuation."""
    return F.length(F.regexp_replace(text, rf"[\p{{P}}]|{SPACE}", "")).cast("long")


def ascii_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", "")).cast("long")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")).cast("long")


def solid_characters(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def tokens(text: Column) -> Column:
    """Words in lower case, with inner hyphens and apostrophes, each once and in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), F.lit(0))))


def token_overlap(left: Column, right: Column) -> Column:
    """Whether two token sets agree: equal, or two thirds of the smaller one, of two at least, in common."""
    least = F.least(F.size(left), F.size(right))
    return (left == right) | ((least >= 2) & (F.size(F.array_intersect(left, right)) * 3 >= least * 2))


def nth_position(text: Column, quote: Column, occurrence: int | Column = 0) -> Column:
    """0-based start of the nth occurrence, those that overlap counted; null if there are fewer, the quote is empty or the
    number is null or negative."""
    wanted = F.lit(occurrence) if isinstance(occurrence, int) else occurrence
    found = F.aggregate(
        F.sequence(F.lit(0), F.greatest(wanted.cast("int"), F.lit(0))),
        F.lit(0),
        lambda at, k: F.when((k > 0) & (at == 0), F.lit(0)).otherwise(F.call_function("locate", quote, text, at + 1)),
    )
    return F.when((F.length(quote) > 0) & (wanted >= 0) & (found > 0), (found - 1).cast("long"))


def rounded_share(part: Column, whole: Column, scale: int = 10_000) -> Column:
    """part / whole in units of 1 / scale, halves up; 0 of nothing is 0."""
    part, whole = part.cast("long"), whole.cast("long")
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", part * scale + F.call_function("div", whole, F.lit(2).cast("long")), whole))


def floor_share(part: Column, whole: Column, scale: int = 1_000_000) -> Column:
    """part / whole in units of 1 / scale, rounded down; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", part.cast("long") * scale, whole.cast("long")))


def content_line(english: Column, chinese: Column) -> Column:
    """Both texts on one line; null where either is empty or breaks the line."""
    good = (F.length(F.trim(english)) > 0) & (F.length(F.trim(chinese)) > 0) & ~english.rlike(r"[\r\n]") & ~chinese.rlike(r"[\r\n]")
    return F.when(good, F.concat(F.trim(english), F.lit(" — "), F.trim(chinese)))
