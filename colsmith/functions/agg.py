"""Aggregators and counters, over groups of rows and over columns of one row.

Spec: name.modifiers,arguments. Group aggregates take the order of rows as a Column, as the first of ties and merged lists depend on it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsmith.functions import text as T
from colsmith.functions.keys import Comparator
from colsmith.functions.numfmt import plain
from colsmith.functions.registry import Registry

COUNTERS = Registry("counter")
AGGREGATORS = Registry("aggregator")


@COUNTERS.push("chars")
def _chars(c: Column, arg: str, utf8: bool) -> Column:
    """Bytes, or characters with utf8."""
    return T.length(c, utf8)


@COUNTERS.push("swords")
def _swords(c: Column, arg: str, utf8: bool) -> Column:
    """Words apart by white space."""
    return F.regexp_count(c, F.lit("(?U)[^\\s\\x00-\\x20]+" if utf8 else "[^\\x00-\\x20]+")).cast("long")


@COUNTERS.push("awords")
def _awords(c: Column, arg: str, utf8: bool) -> Column:
    """Runs of letters and digits."""
    return F.regexp_count(c, F.lit("[\\p{L}\\p{N}]+" if utf8 else "[A-Za-z0-9]+")).cast("long")


@COUNTERS.push("occurs")
def _occurs(c: Column, arg: str, utf8: bool) -> Column:
    """Occurrences of one character."""
    return T.occurrences(c, T.unescape_char(arg))


def counter(spec: str) -> Callable[[Column], Column]:
    head, _, arg = spec.partition(",")
    name, *mods = head.split(".")
    build = COUNTERS.get(name)
    return lambda c: build(T.empty_if_null(c), arg, "utf8" in mods)


@dataclass
class Merge:
    """Options of merged lists: sort uniq count max_len:N min_len:N max_parts:N Dxy comp:spec."""

    cut: str = ","
    join: str = ","
    sort: bool = False
    uniq: bool = False
    count: bool = False
    least: int = 0
    most: int | None = None
    parts: int | None = None
    comp: Comparator = field(default_factory=lambda: Comparator.parse("plain"))

    @classmethod
    def parse(cls, spec: str) -> Merge:
        out = cls()
        rest = spec
        while rest:
            if rest[0] == "D":
                if len(rest) < 3:
                    raise ValueError("merge: D needs two delimiters")
                out.cut, out.join, rest = T.unescape_char(rest[1]), T.unescape_char(rest[2]), rest[3:]
                rest = rest.removeprefix(".")
                continue
            part, _, rest = rest.partition(".")
            key, _, value = part.partition(":")
            if key == "comp":
                out.comp, rest = Comparator.parse(value + ("." + rest if rest else "")), ""
            elif key in ("sort", "uniq", "count"):
                setattr(out, key, True)
            elif key in ("max_len", "min_len", "max_parts"):
                setattr(out, {"max_len": "most", "min_len": "least", "max_parts": "parts"}[key], int(value))
            elif key:
                raise ValueError(f"merge: no option {key!r}")
        return out

    def of(self, values: Column) -> Column:
        """From an array of values in order to the list as text."""
        full = F.filter(values, lambda v: v != "")
        # A group of empty values only is one empty part.
        full = F.when((F.size(full) == 0) & (F.size(values) > 0), F.array(F.lit(""))).otherwise(full)
        parts = F.flatten(F.transform(full, lambda v: F.split(v, T.quoted(self.cut), -1)))
        keyed = F.transform(parts, lambda v, i: F.struct(self.comp.key(v).alias("k"), i.alias("i"), v.alias("v")))
        if self.sort:
            keyed = F.array_sort(keyed)
            keyed = F.reverse(keyed) if "rev" in self.comp.mods else keyed
        if self.uniq:
            before = F.transform(F.concat(F.slice(keyed, 1, 1), keyed), lambda x: x["k"])  # the first meets itself and stays by its place
            pairs = F.slice(F.zip_with(keyed, before, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), F.lit(1), F.size(keyed))
            kept = F.filter(pairs, lambda p, i: (i == 0) | (p["x"]["k"] != p["k"]))
            keyed = F.transform(kept, lambda p: p["x"])
        values = F.transform(keyed, lambda x: x["v"])
        if self.count:
            return F.size(values).cast("string")
        if self.least or self.most is not None:
            values = F.filter(values, lambda v: (F.octet_length(v) >= self.least) & (F.octet_length(v) <= (2**31 - 1 if self.most is None else self.most)))
        if self.parts is not None:
            values = F.slice(values, F.lit(1), F.lit(self.parts))
        return F.array_join(values, self.join)


@dataclass(frozen=True)
class Agg:
    """group(value, row) is an aggregate over rows in order of row; across(values) works on columns of one row. text says how to print."""

    group: Callable[[Column, Column], Column]
    across: Callable[[Sequence[Column]], Column]
    numeric: bool = True
    #: For columns of number types: the same aggregate with a buffer of fixed size, which a hash aggregate takes.
    typed: Callable[[Column], Column] | None = None

    def of(self, value: Column, row: Column, kind: str = "string") -> Column:
        return self.typed(value) if self.typed and kind in NUMBERS else self.group(value, row)


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _in_order(value: Column, row: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(row.alias("r"), value.alias("v")))), lambda x: x["v"])


def _total(values: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, values)


@AGGREGATORS.push("count")
def _count(arg: str) -> Agg:
    """Number of values, from a start."""
    start = int(arg) if arg else 0
    return Agg(lambda v, r: F.count(F.lit(1)) + start, lambda vs: F.lit(len(vs) + start).cast("long"))


def exact_sum(number: Column) -> Column:
    """Sum of doubles that doesn't depend on the order of rows, for values of up to 20 digits before and 8 after the point."""
    return F.sum(number.cast("decimal(28,8)")).cast("double")


@AGGREGATORS.push("sum")
def _sum(arg: str) -> Agg:
    """Sum of numbers; text counts as 0. `exact` adds decimals, so that partitioning can't change the last digits."""
    add = exact_sum if arg == "exact" else F.sum
    return Agg(lambda v, r: F.coalesce(add(T.lossy_double(v)), F.lit(0.0)), lambda vs: _total([T.lossy_double(v) for v in vs]))


@AGGREGATORS.push("mean", aliases=("avg",))
def _mean(arg: str) -> Agg:
    """Mean of numbers, 0 of none."""
    if arg == "exact":
        return Agg(lambda v, r: exact_sum(T.lossy_double(v)) / F.count(F.lit(1)), lambda vs: _total([T.lossy_double(v) for v in vs]) / len(vs))
    return Agg(lambda v, r: F.coalesce(F.avg(T.lossy_double(v)), F.lit(0.0)), lambda vs: _total([T.lossy_double(v) for v in vs]) / len(vs))


def _extreme(arg: str, least: bool) -> Agg:
    comp = Comparator.parse(arg or "plain")
    down = least != ("rev" in comp.mods)

    def group(v: Column, r: Column) -> Column:
        v = T.empty_if_null(v)
        if comp.method in ("", "plain") and not comp.mods:  # equal values are equal texts: no ties to break
            return F.min(v) if least else F.max(v)
        return (comp.smallest if least else comp.greatest)(v, comp.key(v), r)

    def across(vs: Sequence[Column]) -> Column:
        vs = [T.empty_if_null(v) for v in vs]
        packed = [F.struct(comp.key(v).alias("k"), F.lit(i if down else -i).alias("i"), v.alias("v")) for i, v in enumerate(vs)]
        return (F.array_min if down else F.array_max)(F.array(*packed))["v"]

    # Equal numbers of one type are equal texts, so there are no ties to break.
    typed = (lambda v: (F.min if down else F.max)(v).cast("string")) if comp.method == "float" and comp.mods <= {"rev"} else None
    return Agg(group, across, numeric=False, typed=typed)


@AGGREGATORS.push("min", aliases=("minimum",))
def _min(arg: str) -> Agg:
    """First of the least values under a comparator."""
    return _extreme(arg, True)


@AGGREGATORS.push("max", aliases=("maximum",))
def _max(arg: str) -> Agg:
    """First of the greatest values under a comparator."""
    return _extreme(arg, False)


@AGGREGATORS.push("merge")
def _merge(arg: str) -> Agg:
    """Values as one delimited list."""
    m = Merge.parse(arg)
    return Agg(lambda v, r: m.of(_in_order(T.empty_if_null(v), r)), lambda vs: m.of(F.array(*map(T.empty_if_null, vs))), numeric=False)


@AGGREGATORS.push("prefix")
def _prefix(arg: str) -> Agg:
    """Longest common prefix: that of the least and the greatest value."""
    return Agg(
        lambda v, r: T.common_prefix(F.min(T.empty_if_null(v)), F.max(T.empty_if_null(v))),
        lambda vs: T.common_prefix(F.array_min(F.array(*map(T.empty_if_null, vs))), F.array_max(F.array(*map(T.empty_if_null, vs)))),
        numeric=False,
    )


@AGGREGATORS.push("suffix")
def _suffix(arg: str) -> Agg:
    """Longest common suffix."""
    back = lambda v: F.reverse(T.empty_if_null(v))
    return Agg(
        lambda v, r: T.common_suffix(F.min(back(v)), F.max(back(v))),
        lambda vs: T.common_suffix(F.array_min(F.array(*map(back, vs))), F.array_max(F.array(*map(back, vs)))),
        numeric=False,
    )


@AGGREGATORS.push("asum")
def _asum(arg: str) -> Agg:
    """Sum of a counter."""
    c = counter(arg or "chars")
    return Agg(lambda v, r: F.coalesce(F.sum(c(v)), F.lit(0)).cast("long"), lambda vs: _total([c(v) for v in vs]))


@AGGREGATORS.push("amin")
def _amin(arg: str) -> Agg:
    """Least value of a counter; of nothing, the largest integer."""
    c = counter(arg or "chars")
    return Agg(lambda v, r: F.coalesce(F.min(c(v)), F.lit(2**63 - 1)), lambda vs: F.array_min(F.array(*[c(v) for v in vs])))


@AGGREGATORS.push("amax")
def _amax(arg: str) -> Agg:
    """Greatest value of a counter, 0 of nothing."""
    c = counter(arg or "chars")
    return Agg(lambda v, r: F.coalesce(F.max(c(v)), F.lit(0)), lambda vs: F.array_max(F.array(*[c(v) for v in vs])))


@AGGREGATORS.push("amean", aliases=("aavg",))
def _amean(arg: str) -> Agg:
    """Mean of a counter."""
    c = counter(arg or "chars")
    return Agg(lambda v, r: F.coalesce(F.avg(c(v)), F.lit(0.0)), lambda vs: _total([c(v) for v in vs]).cast("double") / len(vs))


def aggregator(spec: str) -> Agg:
    name, _, arg = spec.partition(",")
    return AGGREGATORS.get(name)(arg)


def as_text(agg: Agg, value: Column) -> Column:
    """What the aggregate prints: numbers in their shortest form."""
    return plain(value.cast("double")) if agg.numeric else value.cast("string")


def push_counter(name: str, build: Callable[[Column, str, bool], Column]) -> None:
    """Register a counter of one's own."""
    COUNTERS.push(name, build)
