"""Small Column helpers shared by the feature functions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailprism.functions.fixed_values import HTML_TAG, SPACE

# Every whitespace character, and the same set as a Java class: Latin-1 members first, the rest
# behind one range check, so that a letter fails after two comparisons.
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
JAVA_SPACE = (
    "".join(rf"\x{ord(c):02x}" for c in SPACE_CHARS if ord(c) < 256)
    + r"[[\x{1680}-\x{3000}]&&["
    + "".join(rf"\x{{{ord(c):x}}}" for c in SPACE_CHARS if ord(c) > 255)
    + "]]"
)


def flag(condition: Column) -> Column:
    """Boolean to 0/1; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of ``word``."""
    if len(word) == 1:
        return count_char(text, word)
    return (count_char(text, word) / F.lit(len(word))).cast("int")


def any_of(text: Column, words) -> Column:
    return reduce(or_, (text.contains(w) for w in words))


def ends_with_any(text: Column, endings) -> Column:
    return reduce(or_, (text.endswith(e) for e in endings))


def present(text: Column, words) -> Column:
    """How many of ``words`` occur as substrings."""
    return reduce(add, (text.contains(w).cast("int") for w in words))


def total_occurrences(text: Column, words) -> Column:
    return reduce(add, (occurrences(text, w) for w in words))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as DOUBLE, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    """Trim every kind of whitespace at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def single_spaced(text: Column) -> Column:
    """Every whitespace run as one blank, none at the ends. Most texts need the ASCII class alone."""
    ascii_space = r"[\x09-\x0d\x1c-\x20]+"
    return F.trim(
        F.when(is_ascii(text), F.regexp_replace(text, ascii_space, " "))
        .otherwise(F.regexp_replace(text, f"[{JAVA_SPACE}]+", " "))
    )


def not_blank(text: Column) -> Column:
    return text.rlike(f"[^{SPACE}]")


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, " ")


def _odd_digits() -> str:
    """Regex class body for the characters with a digit value that are no decimal digits."""
    odd = [
        c for c in range(0x20000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"
    ]
    starts = [c for c in odd if c - 1 not in odd]
    ends = [c for c in odd if c + 1 not in odd]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))


ODD_DIGITS = _odd_digits()


# What most texts consist of besides ASCII digits: scripts below Arabic without the digits of Latin-1, kana,
# ideographs, Hangul. None of these is a digit of any kind, and few ranges are fast to test.
NO_DIGITS = r"\x00-\x2f\x3a-\xb1\xb4-\xb8\xba-\x{65f}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}"


def count_digits(text: Column, size: Column) -> Column:
    """Digits of any script: ASCII texts have ten, others may have odd ones too, sought in what common scripts leave."""
    rest = F.regexp_replace(text, f"[{NO_DIGITS}]+", "")
    return F.length(
        F.when(F.octet_length(text) == size, F.regexp_replace(text, "[^0-9]+", ""))
        .otherwise(F.regexp_replace(rest, f"[^\\p{{Nd}}{ODD_DIGITS}]+", ""))
    )
