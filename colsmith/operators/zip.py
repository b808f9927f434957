"""paste: tables side by side, by row number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.operators.project import rename
from colsmith.plans import columns as C
from colsmith.plans.ordering import number_rows


def scoped(defaults: Sequence[str], names: Sequence[str]) -> dict[str, str]:
    """Value of each column from value or value,set entries; later ones win."""
    out = {}
    for d in defaults:
        value, _, where = d.partition(",")
        for _, c in C.resolve(where or "-", names):
            out[c] = value
    return out


def paste(
    tables: Sequence[DataFrame], orders: Sequence[Sequence[str]], end: str = "exact", defaults: Sequence[str] = (), repeat_last: bool = False, renames: Sequence[str] = (), sloppy: bool = False, duplicates: str = "fail", numbered: bool = False
) -> DataFrame:
    """Row k of every table as one row. orders: each table's unique key. end: early stops with the shortest table, late fills up with
    defaults (or each table's last row), exact demands equal lengths. The result has the row number as _row if numbered."""
    parts, names, outs = [], [], []
    for k, (t, by) in enumerate(zip(tables, orders)):
        columns = C.data_columns(t)
        own = number_rows(t, by).select("_row", *[C.col(c).alias(f"_t{k}_{i}") for i, c in enumerate(columns)])
        parts.append(own)
        names += [(c, f"_t{k}_{i}") for i, c in enumerate(columns)]
    if end == "exact":
        sizes = {t.count() for t in tables}
        if len(sizes) > 1:
            raise ValueError(f"tables have {sorted(sizes)} rows; use early or late")
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "_row", "inner" if end in ("exact", "early") else "full_outer")
    labels = [f"c{i + 1}" for i in range(len(names))]
    fill = scoped(defaults, [n for n, _ in names]) if len({n for n, _ in names}) == len(names) else {labels[i]: v for i, v in enumerate(scoped(defaults, labels).values())}
    last = {}
    if end == "late" and repeat_last:
        for p in parts:
            row = p.orderBy(F.desc("_row")).limit(1).first()
            last |= {c: row[c] for c in p.columns if row and c != "_row"}
    for i, (n, source) in enumerate(names):
        value = F.col(source)
        if end == "late":
            missing = F.lit(last[source]) if source in last else F.lit(fill.get(n, fill.get(labels[i], "")))
            value = F.coalesce(value.cast("string"), missing.cast("string"))
        outs.append(C.Output(n, value))
    if renames:
        taken = {p.split(".")[0] for p in renames}
        seen: set[str] = set()
        for i, o in enumerate(outs):  # a rename is for the later one of two equal names
            new = next((p.split(".")[1] for p in renames if p.split(".")[0] == o.name), None)
            if new and (o.name in seen or sum(x.name == o.name for x in outs) == 1):
                outs[i] = C.Output(new, o.value)
            seen.add(o.name)
        if not sloppy and not taken <= seen:
            raise ValueError(f"no columns {sorted(taken - seen)} to rename")
    result = out.select(*C.settle(outs, duplicates), *([F.col("_row")] if numbered else []))
    return result


__all__ = ["paste", "rename", "scoped"]
