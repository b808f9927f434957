"""Column builders over text: ASCII and Unicode variants, lossy numbers, common affixes. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the byte mode: everything up to the space. The Unicode mode uses the regex engine's own class.
ASCII_SPACE, UNICODE_SPACE = "[\\x00-\\x20]", "(?U:[\\s\\x00-\\x20])"

_NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
_BINARY, _DECIMAL = "KMGTPEZYRQ", "kmgtpezyrq"


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def lower(c: Column, utf8: bool = False) -> Column:
    return F.lower(c) if utf8 else F.translate(c, UPPER, LOWER)


def upper(c: Column, utf8: bool = False) -> Column:
    return F.upper(c) if utf8 else F.translate(c, LOWER, UPPER)


def length(c: Column, utf8: bool = False) -> Column:
    return (F.char_length(c) if utf8 else F.octet_length(c)).cast("long")


def trim(c: Column, utf8: bool = False) -> Column:
    space = UNICODE_SPACE if utf8 else ASCII_SPACE
    return F.regexp_replace(c, f"^{space}+|{space}+$", "")


def normal_space(c: Column, utf8: bool = False) -> Column:
    """Runs of white space become one space, none at the ends."""
    space = UNICODE_SPACE if utf8 else ASCII_SPACE
    return trim(F.regexp_replace(c, f"{space}+", " "), utf8)


def lossy_double(c: Column) -> Column:
    """The number that a text begins with, 0 without one, times the factor of a letter K..Q (powers of 1024) or k..q (of 1000) after it."""
    text = empty_if_null(c)
    found = F.regexp_extract(text, _NUMBER, 0)
    number = F.coalesce(found.try_cast("double"), F.lit(0.0))
    after = F.substring(text, F.char_length(found) + F.lit(1), F.lit(1))
    power = F.when(after == "", 0).otherwise(F.position(after, F.lit(_BINARY + _DECIMAL)))
    factor = F.when(power == 0, F.lit(1.0)).when(power <= 10, F.pow(F.lit(1024.0), power.cast("double"))).otherwise(F.pow(F.lit(1000.0), (power - 10).cast("double")))
    return number * factor


def occurrences(c: Column, piece: str) -> Column:
    """How often one character is in a text."""
    return (F.char_length(c) - F.char_length(F.replace(c, F.lit(piece), F.lit("")))).cast("long")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two texts. That of a group is the common prefix of its least and greatest value."""
    n = F.least(F.char_length(a), F.char_length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first = F.when(n == 0, F.lit(1)).otherwise(F.coalesce(F.try_element_at(places, F.lit(1)), n + 1))
    return F.substring(a, F.lit(1), first - 1)


def common_suffix(a_reversed: Column, b_reversed: Column) -> Column:
    """Longest common suffix of two texts given reversed."""
    return F.reverse(common_prefix(a_reversed, b_reversed))


def unescape_char(ch: str) -> str:
    return {"t": "\t", "s": " ", "r": "\r", "n": "\n"}.get(ch, ch)


def quoted(text: str) -> str:
    """A regex that matches this text."""
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 and c not in "\n\t\r\0" else c for c in text)
