"""Comparators as key Columns: equal keys are equal values, ordered keys are ordered values.

plain, lower, float, numeric, length, ip, equal, random, and expr over whole lines. Modifiers: rev reverses; strict, trail and low
choose where text that is no number goes (low: before all numbers, otherwise after; trail lets text follow the number).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsmith.functions import text as T
from colsmith.functions.registry import Registry

COMPARATORS = Registry("comparator")
_STRICT = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[KMGTPEZYRQkmgtpezyrq]?"


@COMPARATORS.push("plain", aliases=("",))
def _plain(c: Column, mods: frozenset) -> Column:
    """Order of UTF-8 bytes."""
    return T.empty_if_null(c)


@COMPARATORS.push("lower")
def _lower(c: Column, mods: frozenset) -> Column:
    """Order of bytes, ASCII letters in lower case."""
    return T.lower(T.empty_if_null(c))


@COMPARATORS.push("float")
def _float(c: Column, mods: frozenset) -> Column:
    """The number at the begin, 0 for text without one; strict or trail tell such text apart."""
    number = T.lossy_double(c) + F.lit(0.0)
    if not mods & {"strict", "trail"}:
        return number
    ok = T.empty_if_null(c).rlike(_STRICT + ("$" if "strict" in mods else ""))
    return F.when(ok, number).otherwise(F.lit(float("-inf") if "low" in mods else float("nan")))


@COMPARATORS.push("numeric", aliases=("num",))
def _numeric(c: Column, mods: frozenset) -> Column:
    """Decimal numbers of any length, commas skipped, compared as text of digits."""
    text = F.regexp_replace(T.empty_if_null(c), ",", "")
    negative = F.startswith(text, F.lit("-"))
    whole = F.regexp_replace(F.regexp_extract(text, "^[+-]?([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(text, "^[+-]?[0-9]*\\.([0-9]*)", 1), "0+$", "")
    zero = (whole == "") & (part == "")
    flip = lambda d: F.translate(d, "0123456789", "9876543210")
    below = negative & ~zero
    # A negative fraction that goes on is smaller: a mark after all digits ends it.
    return F.struct(
        F.when(zero, 1).when(negative, 0).otherwise(2).alias("sign"),
        F.when(below, -F.char_length(whole)).otherwise(F.char_length(whole)).alias("size"),
        F.when(below, flip(whole)).otherwise(whole).alias("whole"),
        F.when(below, F.concat(flip(part), F.lit("~"))).otherwise(part).alias("part"),
    )


@COMPARATORS.push("length", aliases=("len",))
def _length(c: Column, mods: frozenset) -> Column:
    """Number of bytes."""
    return F.octet_length(T.empty_if_null(c)).cast("long")


@COMPARATORS.push("ip")
def _ip(c: Column, mods: frozenset) -> Column:
    """Sections between dots, each by number of digits, then digits; fewer sections first."""
    return F.transform(F.split(T.empty_if_null(c), "\\.", -1), lambda s: F.struct(F.char_length(s).alias("n"), s.alias("d")))


@COMPARATORS.push("equal")
def _equal(c: Column, mods: frozenset) -> Column:
    """All values are equal."""
    return F.lit(0)


@COMPARATORS.push("random")
def _random(c: Column, mods: frozenset) -> Column:
    """A new random order every time."""
    return F.rand()


@dataclass(frozen=True)
class Comparator:
    """A parsed method.modifiers; key() is the ordered key, order() the sort order."""

    method: str
    mods: frozenset

    @classmethod
    def parse(cls, spec: str) -> Comparator:
        name, *mods = spec.split(".")
        if unknown := set(mods) - {"rev", "strict", "trail", "low"}:
            raise ValueError(f"comparator {spec!r}: no modifier {sorted(unknown)}")
        COMPARATORS.get(name)
        return cls(name, frozenset(mods))

    def key(self, c: Column) -> Column:
        return COMPARATORS.get(self.method)(c, self.mods)

    def order(self, key: Column) -> Column:
        return key.desc() if "rev" in self.mods else key.asc()

    def smallest(self, value: Column, key: Column, row: Column) -> Column:
        """Aggregate: the first of the least values (rev: of the greatest)."""
        if "rev" in self.mods:
            return F.max_by(value, F.struct(key.alias("k"), (-row).alias("r")))
        return F.min_by(value, F.struct(key.alias("k"), row.alias("r")))

    def greatest(self, value: Column, key: Column, row: Column) -> Column:
        """Aggregate: the first of the greatest values (rev: of the least)."""
        if "rev" in self.mods:
            return F.min_by(value, F.struct(key.alias("k"), row.alias("r")))
        return F.max_by(value, F.struct(key.alias("k"), (-row).alias("r")))
