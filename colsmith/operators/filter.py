"""cgrep, cat and verify: keep rows by matchers, concatenate with numbering, report violations."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.functions.match import bounds, determiner, in_range, matcher
from colsmith.operators.sort import Keys
from colsmith.plans import columns as C
from colsmith.plans.ordering import Ordered


class Split(NamedTuple):
    matching: DataFrame
    others: DataFrame


def whole_line(df: DataFrame, delimiter: str = "\t") -> Column:
    """The line a row stands for: _line if the scan kept it, otherwise its columns joined."""
    if "_line" in df.columns:
        return F.col("_line")
    return F.concat_ws(delimiter, *[F.coalesce(C.col(c).cast("string"), F.lit("")) for c in C.data_columns(df)])


def _parse(spec: str) -> tuple[str, str]:
    """(target, matcher) of a pattern; a target in brackets or parentheses may hold commas."""
    if spec[:1] in ("[", "("):
        depth = 0
        for i, ch in enumerate(spec):
            depth += ch in "[("
            depth -= ch in "])"
            if not depth:
                return spec[: i + 1], spec[i + 2 :]
    target, _, rest = spec.partition(",")
    return target, rest


def predicate(df: DataFrame, spec: str, delimiter: str = "\t") -> Column:
    """One pattern: Column,Method,Pattern. No column: the whole line. [determiner,set]: several columns. Line methods: expr, comp, count."""
    target, method = _parse(spec)
    head, _, pattern = method.partition(",")
    name = head.split(".")[0]
    negate = "not" in head.split(".")[1:]
    if name == "expr" and not target:
        found = C.expression(df, pattern) != 0
    elif name == "count" and not target:
        n = F.col("_ncols") if "_ncols" in df.columns else F.lit(len(C.data_columns(df)))
        found = n == int(pattern)
    elif name == "comp":
        found = _compare(df, target, pattern)
    elif target.startswith("["):
        how, _, which = target[1:-1].partition(",")
        test = matcher(method)
        return determiner(how)([test(C.col(c)) for _, c in C.resolve(which, C.data_columns(df))])
    else:
        test = matcher(method)
        if not target:
            return test(whole_line(df, delimiter))
        picked = C.resolve(target, C.data_columns(df))
        return determiner("some")([test(C.col(c)) for _, c in picked])
    return ~found if negate else found


def _compare(df: DataFrame, target: str, pattern: str) -> Column:
    """<author or >=[all,2-4],float: the target column against other columns under a comparator."""
    symbol = next(s for s in ("<=", ">=", "==", "!=", "<", ">", "=") if pattern.startswith(s))
    rest = pattern[len(symbol) :]
    how = "some"
    if rest.startswith("["):
        inside, _, rest = rest[1:].partition("]")
        how, _, which = inside.partition(",")
        comparator = rest.removeprefix(",")
    else:
        which, _, comparator = rest.partition(",")
    columns = C.data_columns(df)
    mine = C.col(C.resolve(target, columns)[0][1])
    tests = []
    for _, other in C.resolve(which, columns):
        tests.append(in_range(mine, f"{comparator or 'plain'},{symbol}x", lambda _v, o=other: C.col(o)))
    return determiner(how)(tests)


def condition(df: DataFrame, patterns: Sequence[str], any_of: bool = False, invert: bool = False) -> Column:
    preds = [predicate(df, p) for p in patterns]
    found = functools.reduce(operator.or_ if any_of else operator.and_, preds) if preds else F.lit(True)
    return ~found if invert else found


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def implied(df: DataFrame, spec: str) -> Column | None:
    """A condition on the bare column that every matching row meets, which a Parquet or ORC scan can take; None if there is none.

    Matchers take null for empty text, so they work on coalesced columns, which scans don't take. Where an empty value can't match,
    the bare comparison says the same.
    """
    target, method = _parse(spec)
    head, _, pattern = method.partition(",")
    if not pattern or target[:1] in ("[", "(", "") or head not in ("exact", "prefix", "suffix", "infix", "substr", "substring", "range"):
        return None
    try:
        picked = C.resolve(target, C.data_columns(df))
    except ValueError:
        return None
    if len(picked) != 1:
        return None
    c, kind = C.col(picked[0][1]), dict(df.dtypes)[picked[0][1]]
    if head != "range":
        if kind != "string":
            return None
        return c == F.lit(pattern) if head == "exact" else c.startswith(pattern) if head == "prefix" else c.endswith(pattern) if head == "suffix" else c.contains(pattern)
    comparator, tests = bounds(pattern)
    if comparator.mods or (kind == "string") != (comparator.method in ("", "plain")) or (kind != "string" and (comparator.method != "float" or kind not in _NUMBERS)):
        return None
    found = []
    for op, text in tests:
        value = text if kind == "string" else float(text)
        if not op("" if kind == "string" else 0.0, value):  # an empty value fails this test
            found.append(op(c, F.lit(value)))
    return functools.reduce(operator.and_, found) if found else None


def grep(df: DataFrame, *patterns: str, any_of: bool = False, invert: bool = False) -> DataFrame:
    """Rows that match all patterns (any_of: one), or with invert those that don't."""
    pushed = [p for p in (implied(df, x) for x in patterns) if p is not None] if not (any_of or invert) else []
    for p in pushed:
        df = df.where(p)
    return df.where(condition(df, patterns, any_of, invert))


def grep_split(df: DataFrame, *patterns: str, any_of: bool = False, invert: bool = False) -> Split:
    """Matching rows and the others."""
    keep = condition(df, patterns, any_of, invert)
    return Split(df.where(keep), df.where(~keep))


def location(df: DataFrame, spec: str) -> DataFrame:
    """Columns in front, from name:what of bytes (1-based offset), line, and name.N (last N parts of the path); a bare what names itself."""
    front = []
    for part in spec.split(","):
        new, _, what = part.rpartition(":")
        kind, _, n = what.partition(".")
        if kind == "bytes":
            front.append((F.col("_byte") + 1).alias(new or "bytes"))
        elif kind == "line":
            front.append(F.col("_row").alias(new or "line"))
        elif kind in ("name", "filename"):
            front.append((F.substring_index("_file", "/", -int(n)) if n else F.col("_file")).alias(new or "filename"))
        else:
            raise ValueError(f"no location {what!r}")
    return df.select(*front, *[C.col(c) for c in df.columns])


def concat(tables: Sequence[DataFrame], header: str = "match") -> DataFrame:
    """All rows in order. header: match and require demand equal names, strip and trust go by position, ignore fills up."""
    first = C.data_columns(tables[0])
    out = None
    for k, t in enumerate(tables):
        names = C.data_columns(t)
        if header in ("match", "require") and names != first:
            raise ValueError(f"columns differ: {names} and {first}")
        if header in ("strip", "trust", "none"):
            if len(names) != len(first):
                raise ValueError("numbers of columns differ")
            t = t.select(*[C.col(n).alias(f) for n, f in zip(names, first)], *[c for c in t.columns if c.startswith("_")])
        if "_file_no" not in t.columns:
            t = t.withColumn("_file_no", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=header == "ignore")
    return out


def remove(df: DataFrame, *matchers: str) -> DataFrame:
    """Rows whose whole line no matcher accepts."""
    line = whole_line(df)
    return df.where(~functools.reduce(operator.or_, [matcher(m)(line) for m in matchers], F.lit(False)))


def number(df: DataFrame, by: Sequence[str], name: str = "line", start: int = 1, skip: Sequence[str] = (), at: str = "begin", line: Column | None = None) -> DataFrame:
    """Numbers rows in the order of a unique key; rows that a skip matcher accepts get an empty number and use none up."""
    line = whole_line(df) if line is None else line
    skipped = functools.reduce(operator.or_, [matcher(m)(line) for m in skip], F.lit(False))
    out = Ordered(df.withColumn("_skip", skipped), by).running("_n", F.when(F.col("_skip"), 0).otherwise(1), start - 1).done()
    shown = F.when(F.col("_skip"), F.lit("")).otherwise(F.col("_n").cast("string")).alias(name)
    rest = [C.col(c) for c in df.columns]
    return out.select(*([shown, *rest] if at == "begin" else [*rest, shown]))


def verify(df: DataFrame, by: Sequence[str], rules: Sequence[str] = (), width: int | None = None, sort_keys: Sequence[str] = (), unique: bool = False, first: str = "", last: str = "", limit: int | None = None) -> DataFrame:
    """Violations as (rule, by..., line): rules that a row breaks, a wrong width, rows out of order, a first or last row out of bounds."""
    line = whole_line(df).alias("line")
    keys = [F.col(c) for c in by]
    found = [df.where(~predicate(df, r)).select(F.lit(r).alias("rule"), *keys, line) for r in rules]
    if width is not None:
        n = F.col("_ncols") if "_ncols" in df.columns else F.lit(len(C.data_columns(df)))
        found.append(df.where(n != width).select(F.lit("width").alias("rule"), *keys, line))
    if sort_keys or unique:
        k = Keys.parse(df, sort_keys)
        found.append(k.out_of_order(by, unique).select(F.lit("unique" if unique else "sort").alias("rule"), *keys, line))
    for rule, spec, pick in (("first", first, F.min_by), ("last", last, F.max_by)):
        if spec:
            columns = Keys.parse(df, sort_keys).first_value()
            edge = df.select(*df.columns).groupBy().agg(pick(F.struct(*keys, columns.alias("v"), line), F.struct(*keys)).alias("e")).select("e.*")
            found.append(edge.where(~in_range(F.col("v"), spec)).select(F.lit(rule).alias("rule"), *keys, "line"))
    if not found:
        raise ValueError("nothing to verify")
    out = functools.reduce(DataFrame.unionByName, found)
    return out.limit(limit) if limit else out


Predicate = Callable[[Column], Column]
