"""uniq: runs of equal neighbours, whole-line distinct, and aggregates over each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.functions.agg import aggregator, as_text
from colsmith.functions.keys import Comparator
from colsmith.operators.sort import Keys
from colsmith.plans import columns as C
from colsmith.plans.ordering import Ordered


def _folded(spec: str, df: DataFrame, row: list[str]):
    """expr,var,init,expression: var = expression(var, columns), row by row."""
    _, var, init, text = spec.split(",", 3)
    used = [c for c in C.data_columns(df) if c in _names(text, df)]
    packed = F.array_sort(F.collect_list(F.struct(F.struct(*row).alias("r"), F.struct(*[C.col(c).alias(c) for c in used] or [F.lit(0).alias("_")]).alias("v"))))

    def step(acc, item):
        from colsmith.functions import text as T
        from colsmith.functions.expr import compile_expr

        def find(name: str):
            if name == var:
                return acc
            try:
                return T.lossy_double(item["v"][C.data_columns(df)[C.position(name, C.data_columns(df))]])
            except ValueError:
                return None

        return compile_expr(text, find)

    return F.aggregate(packed, F.lit(float(init)), step)


def _names(text: str, df: DataFrame) -> set[str]:
    from colsmith.functions.expr import names_in

    columns, out = C.data_columns(df), set()
    for n in names_in(text):
        try:
            out.add(columns[C.position(n, columns)])
        except ValueError:
            pass
    return out


def unique(
    df: DataFrame,
    keys: Sequence[str] = (),
    row: Sequence[str] = (),
    which: str = "first",
    count: str = "",
    replace: Sequence[str] = (),
    before: Sequence[str] = (),
    after: Sequence[str] = (),
    is_sorted: bool = False,
    as_string: bool = True,
) -> DataFrame:
    """One row for each run of neighbours with equal keys, in the order of the unique key `row`.

    which: first, last, min or max, the latter two with a key (min,two,float). count: name,begin or name,end adds the run's length.
    replace: col,agg in place; before and after: new,col,agg. is_sorted says that the input is sorted by its keys: then runs are
    groups, and nothing needs the order of rows but the choice of a representative.
    """
    row = list(row)
    k = Keys.parse(df, keys)
    named, names = k.named()
    if is_sorted:
        runs, ids = named, names
    else:
        o = Ordered(named, row).previous("_before", F.struct(*names))
        o.df = o.df.withColumn("_new", F.when(F.col("_before").isNull() | (F.struct(*names) != F.col("_before")["v"]), 1).otherwise(0))
        runs, ids = o.running("_run", F.col("_new")).done(), ["_run"]
    order = F.struct(*row)
    whole = F.struct(*[C.col(c) for c in df.columns])
    how, _, key = which.partition(",")
    if how in ("first", "last"):
        kept = (F.min_by if how == "first" else F.max_by)(whole, order)
    elif how in ("min", "max"):
        column, _, method = key.partition(",")
        comp = Comparator.parse(method or "plain")
        value = comp.key(C.col(C.resolve(column or "1", C.data_columns(df))[0][1]))
        least = (how == "min") != ("rev" in comp.mods)
        if least:
            kept = F.min_by(whole, F.struct(value.alias("k"), order.alias("r")))
        else:  # the first of the greatest: rows are numbers, so their negatives order them backwards
            kept = F.max_by(whole, F.struct(value.alias("k"), *[(-F.col(c)).alias(f"r{i}") for i, c in enumerate(row)]))
    else:
        raise ValueError(f"no choice {which!r}")
    aggs = [kept.alias("_kept"), F.count(F.lit(1)).alias("_count"), F.min(order).alias("_at")]
    changed: dict[str, str] = {}
    fronts, backs = [], []

    def add(source: str, spec: str) -> str:
        name = f"_a{len(aggs)}"
        if spec.startswith("expr,"):
            value = _folded(spec, df, row)
            aggs.append((as_text_number(value) if as_string else value).alias(name))
        else:
            a = aggregator(spec)
            column = C.resolve(source, C.data_columns(df))[0][1]
            value = a.of(C.col(column), order if len(row) > 1 else F.col(row[0]), dict(df.dtypes)[column])
            aggs.append((as_text(a, value) if as_string else value).alias(name))
        return name

    for spec in replace:
        source, _, agg = spec.partition(",")
        changed[C.resolve(source, C.data_columns(df))[0][1]] = add(source, agg)
    for specs, into in ((before, fronts), (after, backs)):
        for spec in specs:
            new, _, rest = spec.partition(",")
            if rest.startswith("expr,"):
                into.append((new or "expr", add("", rest)))
            else:
                source, _, agg = rest.partition(",")
                into.append((new, add(source, agg)))
    out = runs.groupBy(*ids).agg(*aggs)
    columns = [F.col(a).alias(n) for n, a in fronts]
    columns += [F.col(changed[c]).alias(c) if c in changed else F.col("_kept")[c].alias(c) for c in df.columns]
    columns += [F.col(a).alias(n) for n, a in backs]
    if count:
        name, _, where = count.partition(",")
        n = F.col("_count").alias(name or "count")
        columns = [*columns, n] if where == "end" else [n, *columns]
    return out.select(*columns)


def as_text_number(value):
    from colsmith.functions.numfmt import plain

    return plain(value)


def distinct_lines(df: DataFrame, row: Sequence[str] = ()) -> DataFrame:
    """First of equal rows, wherever they are; compared in full, combined before the shuffle."""
    columns = [c for c in C.data_columns(df) if c not in row]
    if not row:
        return df.dropDuplicates(columns)
    if len(row) == 1:  # a number: the hash aggregate's kind of buffer
        return df.groupBy(*[C.col(c) for c in columns]).agg(F.min(row[0]).alias(row[0]))
    return df.groupBy(*[C.col(c) for c in columns]).agg(F.min(F.struct(*row)).alias("_at")).select(*[C.col(c) for c in columns], "_at.*")


def group_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[str], row: Sequence[str] = (), as_string: bool = False) -> DataFrame:
    """Plain grouping: one row a key with new,col,agg columns; combined before the shuffle, whatever the order of rows."""
    order = F.struct(*row) if len(row) > 1 else (F.col(row[0]) if row else F.lit(0))
    out = []
    for spec in aggs:
        new, source, agg = spec.split(",", 2)
        a = aggregator(agg)
        column = C.resolve(source, C.data_columns(df))[0][1]
        value = a.of(C.col(column), order, dict(df.dtypes)[column])
        out.append((as_text(a, value) if as_string else value).alias(new))
    return df.groupBy(*[C.col(c) for c in keys]).agg(*out)
