"""Value transforms, chained with +: name[.utf8][,pattern]."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsmith.functions import text as T
from colsmith.functions.registry import Registry

TRANSFORMS = Registry("transform")


@TRANSFORMS.push("lower", aliases=("lowercase",))
def _lower(c: Column, pattern: str, utf8: bool) -> Column:
    """Letters in lower case: ASCII, or all with utf8."""
    return T.lower(c, utf8)


@TRANSFORMS.push("upper", aliases=("uppercase",))
def _upper(c: Column, pattern: str, utf8: bool) -> Column:
    """Letters in upper case: ASCII, or all with utf8."""
    return T.upper(c, utf8)


@TRANSFORMS.push("normspace")
def _normspace(c: Column, pattern: str, utf8: bool) -> Column:
    """Runs of white space as one space, none at the ends."""
    return T.normal_space(c, utf8)


@TRANSFORMS.push("to_base64")
def _to_base64(c: Column, pattern: str, utf8: bool) -> Column:
    """Standard base64, in one line."""
    return F.regexp_replace(F.base64(c.cast("binary")), "[\r\n]", "")


@TRANSFORMS.push("from_base64")
def _from_base64(c: Column, pattern: str, utf8: bool) -> Column:
    """Text from standard base64; what isn't base64 is an error."""
    return F.unbase64(c).cast("string")


def ranges(spec: str) -> list[tuple[int, int | None]]:
    """1-based inclusive ranges of a list such as 3,2-4,7-."""
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"(\d*)(-?)(\d*)", part)
        if not m or not part:
            raise ValueError(f"bad range {part!r}")
        first = int(m[1]) if m[1] else 1
        last = (int(m[3]) if m[3] else None) if m[2] else first
        if first < 1 or (last is not None and last < first):
            raise ValueError(f"bad range {part!r}")
        out.append((first, last))
    return out


@TRANSFORMS.push("bytes")
def _bytes(c: Column, pattern: str, utf8: bool) -> Column:
    """Bytes of the given ranges, joined, clipped at the end."""
    raw = c.cast("binary")
    parts = [F.substring(raw, F.lit(a), F.lit(2**31 - 1 - a if b is None else b - a + 1)) for a, b in ranges(pattern)]
    return F.concat(*parts).cast("string")


@TRANSFORMS.push("select")
def _select(c: Column, pattern: str, utf8: bool) -> Column:
    """Cut at the first character of the pattern, keep parts by position, join by the second."""
    if len(pattern) < 3:
        raise ValueError("select needs a delimiter, an output delimiter and ranges")
    cut, join = T.unescape_char(pattern[0]), T.unescape_char(pattern[1])
    parts = F.split(c, T.quoted(cut), -1)
    picked = [F.slice(parts, F.lit(a), F.lit(2**31 - 1 if b is None else b - a + 1)) for a, b in ranges(pattern[2:])]
    return F.array_join(F.concat(*picked), join)


def transform(spec: str) -> Callable[[Column], Column]:
    """A chain such as normspace+lower.utf8+bytes,1-3 as one function of a Column."""
    steps = []
    for step in spec.split("+"):
        head, _, pattern = step.partition(",")
        name, *mods = head.split(".")
        if unknown := set(mods) - {"utf8"}:
            raise ValueError(f"transform {step!r}: no modifier {sorted(unknown)}")
        steps.append((TRANSFORMS.get(name), pattern, "utf8" in mods))

    def run(c: Column) -> Column:
        for build, pattern, utf8 in steps:
            c = build(c, pattern, utf8)
        return c

    return run
