"""wc: lines, bytes, words and any aggregate, by file, by column, with totals."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.functions.agg import aggregator
from colsmith.functions.numfmt import format_num
from colsmith.operators.filter import whole_line
from colsmith.plans import columns as C

SHORT = {"l": "lines,count", "b": "bytes,asum,chars", "c": "chars,asum,chars.utf8", "w": "words,asum,swords"}


def _pairs(specs: Sequence[str]) -> list[tuple[str, str]]:
    out = []
    for s in specs or ["l"]:
        name, _, agg = SHORT.get(s, s).partition(",")
        out.append((name, agg))
    return out


def _shown(df: DataFrame, names: Sequence[str], fmt: str) -> DataFrame:
    return df.select(*[format_num(F.col(c), fmt).alias(c) if c in names else F.col(c) for c in df.columns]) if fmt else df


def count(df: DataFrame, specs: Sequence[str] = (), by: str | None = "_file", totals: str = "no", filename: str = "file", fmt: str = "") -> DataFrame:
    """Aggregates over whole lines: l b c w or name,agg. by: one row for each value of a column. totals: no, yes, maybe (if there are two
    files or more), only; a total adds up the files' values. Line ends aren't counted."""
    pairs = _pairs(specs)
    line = whole_line(df)
    aggs = [aggregator(a).group(line, F.lit(0)).alias(n) for n, a in pairs]
    names = [n for n, _ in pairs]
    each = df.groupBy(F.col(by).alias(filename)).agg(*aggs) if by else df.agg(*aggs)
    if not by or totals == "no":
        return _shown(each, names, fmt)
    total = each.agg(F.count(F.lit(1)).alias("_files"), *[F.sum(n).alias(n) for n in names])
    total = total.where("_files > 1") if totals == "maybe" else total
    total = total.select(F.lit("totals").alias(filename), *names)
    return _shown(total if totals == "only" else each.unionByName(total), names, fmt)


def count_columns(df: DataFrame, specs: Sequence[str] = (), which: str = "-", fmt: str = "") -> DataFrame:
    """Aggregates of each column apart, one row a column: one pass over the table, then a turn of the single result row."""
    pairs = _pairs(specs or ["b"])
    picked = [c for _, c in C.resolve(which, C.data_columns(df))]
    aggs = [aggregator(a).group(C.col(c), F.lit(0)).alias(f"{i}_{j}") for i, c in enumerate(picked) for j, (_, a) in enumerate(pairs)]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{j}").alias(n) for j, (n, _) in enumerate(pairs)]) for i, c in enumerate(picked)])
    return _shown(one.select(F.inline(rows)), [n for n, _ in pairs], fmt)


def counter_columns(df: DataFrame, specs: Sequence[str]) -> DataFrame:
    """Adds name,column,counter measures to each row."""
    from colsmith.functions.agg import counter

    return functools.reduce(lambda d, s: d.withColumn(s.split(",", 2)[0], counter(s.split(",", 2)[2])(C.col(s.split(",", 2)[1]))), specs, df)
