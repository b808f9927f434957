"""cut: select, rename, transform, fold, group, compute and compose columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.plans import columns as C

_STEPS = {"f": C.fields, "fields": C.fields, "g": C.group, "group": C.group, "e": C.computed, "expr": C.computed, "c": C.composite, "composite": C.composite}


def cut(df: DataFrame, *steps: tuple[str, str] | str, duplicates: str = "fail", as_string: bool = True) -> DataFrame:
    """Columns of all steps, in order: ("f", set), ("g", group), ("e", name:expression), ("c", name:template); a bare text is a set."""
    outputs: list[C.Output] = []
    for step in steps or (("f", "-"),):
        kind, spec = ("f", step) if isinstance(step, str) else step
        if kind not in _STEPS:
            raise ValueError(f"no step {kind!r}")
        outputs += C.fields(df, spec, as_string) if kind in ("f", "fields") else _STEPS[kind](df, spec)
    meta = [F.col(c) for c in df.columns if c.startswith("_")]
    return df.select(*C.settle(outputs, duplicates), *meta)


def rename(df: DataFrame, pairs: Sequence[str], sloppy: bool = False) -> DataFrame:
    """Each old.new renames a column; without sloppy an unknown one is an error."""
    for pair in pairs:
        old, _, new = pair.partition(".")
        if old not in df.columns and not sloppy:
            raise ValueError(f"no column {old!r} to rename")
        df = df.withColumnRenamed(old, new)
    return df
