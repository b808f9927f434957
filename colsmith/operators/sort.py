"""sort, its checks, and key specs: columns,method.modifiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.functions.keys import Comparator
from colsmith.plans import columns as C
from colsmith.plans.ordering import Ordered


@dataclass
class Keys:
    """Key columns of a table: ordered values and how each sorts."""

    df: DataFrame
    values: list[Column]
    raw: list[Column]
    comparators: list[Comparator]

    @classmethod
    def parse(cls, df: DataFrame, specs: Sequence[str]) -> Keys:
        values, raw, comps = [], [], []
        for spec in specs or [""]:
            which, _, method = spec.partition(",")
            if which.startswith("("):
                which, _, method = spec.partition("),")
                which += ")" if not which.endswith(")") else ""
            if method.startswith("expr"):
                head, _, text = method.partition(",")
                comp = Comparator("expr", frozenset(head.split(".")[1:]))
                v = C.expression(df, text)
                values.append(v)
                raw.append(v)
                comps.append(comp)
                continue
            comp = Comparator.parse(method or "plain")
            if which:
                sources = [C.col(c) for _, c in C.resolve(which, C.data_columns(df))]
            elif "_line" in df.columns:
                sources = [F.col("_line")]
            else:
                sources = [C.col(c) for c in C.data_columns(df)] if comp.method in ("plain", "") else [F.concat_ws("\t", *[F.coalesce(C.col(c).cast("string"), F.lit("")) for c in C.data_columns(df)])]
            for s in sources:
                values.append(comp.key(s))
                raw.append(s)
                comps.append(comp)
        return cls(df, values, raw, comps)

    def order(self) -> list[Column]:
        return [v.desc() if "rev" in c.mods else v.asc() for v, c in zip(self.values, self.comparators)]

    def first_value(self) -> Column:
        return self.raw[0]

    def named(self) -> tuple[DataFrame, list[str]]:
        """The table with its keys as columns _k0, _k1, ..."""
        names = [f"_k{i}" for i in range(len(self.values))]
        return self.df.select("*", *[v.alias(n) for v, n in zip(self.values, names)]), names

    def out_of_order(self, by: Sequence[str], unique: bool = False) -> DataFrame:
        """Rows that sort before the row in front of them (unique: or equal to it)."""
        df, names = self.named()
        seen = Ordered(df, by).previous("_before", F.struct(*names)).done()
        less, equal = F.lit(False), F.lit(True)
        for n, c in zip(names, self.comparators):
            now, was = F.col(n), F.col("_before")["v"][n]
            earlier = now > was if "rev" in c.mods else now < was
            less = less | (equal & earlier)
            equal = equal & (now == was)
        bad = (less | equal) if unique else less
        return seen.where(F.col("_before").isNotNull() & bad).drop("_before", *names)


def sort(df: DataFrame, keys: Sequence[str] = (), row: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Rows by keys, equal ones in the order of `row` (the columns that give input order); unique keeps the first of equal keys."""
    k = Keys.parse(df, keys)
    ties = [F.col(c).asc() for c in row]
    if not unique:
        return df.orderBy(*k.order(), *ties)
    named, names = k.named()
    if ties:
        # min_by aggregates before the shuffle; a window would move and sort every row.
        kept = named.groupBy(*names).agg(F.min_by(F.struct(*[C.col(c) for c in df.columns]), F.struct(*row)).alias("_r")).select("_r.*", *names)
    else:
        kept = named.dropDuplicates(names)
    order = [F.col(n).desc() if "rev" in c.mods else F.col(n).asc() for n, c in zip(names, k.comparators)]
    return kept.orderBy(*order).drop(*names)


def merge(tables: Sequence[DataFrame], keys: Sequence[str] = (), row: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Sorted inputs as one sorted output: a union in input order, sorted."""
    from colsmith.operators.filter import concat

    return sort(concat(tables), keys, ["_file_no", *row], unique).drop("_file_no")


def rank(df: DataFrame, keys: Sequence[str], row: Sequence[str], name: str = "rn", within: Sequence[str] = ()) -> DataFrame:
    """Adds each row's place in the sorted order; within names the groups that are ranked apart."""
    k = Keys.parse(df, keys)
    if within:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(*k.order(), *[F.col(c) for c in row])))
    named, names = k.named()
    down = {n for n, c in zip(names, k.comparators) if "rev" in c.mods}
    return Ordered(named, [*names, *row], down=down).running(name).done().drop(*names)


def check(df: DataFrame, by: Sequence[str], keys: Sequence[str] = (), unique: bool = False, limit: int | None = None) -> DataFrame:
    """Rows out of order; empty if the table is sorted."""
    bad = Keys.parse(df, keys).out_of_order(by, unique)
    return bad.limit(limit) if limit else bad


def top(df: DataFrame, n: int, keys: Sequence[str] = (), row: Sequence[str] = ()) -> DataFrame:
    """First n rows in sorted order, without sorting the rest."""
    k = Keys.parse(df, keys)
    return df.orderBy(*k.order(), *[F.col(c) for c in row]).limit(n)
