"""binsearch: rows of a key in a sorted table, with rows around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.functions.keys import Comparator
from colsmith.plans import columns as C
from colsmith.plans.ordering import number_rows


def search(df: DataFrame, keys: Sequence[str], value: str, row: Sequence[str], context: str = "0,0", cut: str = ",") -> DataFrame:
    """Rows whose keys equal value (its parts, for several keys) in a table sorted by them.

    context: before,after, each as match.miss: rows around a match, or around the place where a match would be. Without context it is
    a filter, which statistics of sorted files prune; with it, row numbers of the first and last match, or the place, pick the range.
    """
    before, after = [tuple(int(x) for x in (p.split(".") * 2)[:2]) for p in context.split(",")]
    parts = value.split(cut) if len(keys) > 1 else [value]
    equal, less = F.lit(True), F.lit(False)
    for spec, part in zip(keys, parts):
        which, _, method = spec.partition(",")
        comp = Comparator.parse(method or "plain")
        for _, c in C.resolve(which, C.data_columns(df)):
            kind = dict(df.dtypes)[c]
            plain = comp.method in ("", "plain") and kind != "string"
            key, wanted = (C.col(c), F.lit(part).cast(kind)) if plain else (comp.key(C.col(c)), comp.key(F.lit(part)))
            earlier = key > wanted if "rev" in comp.mods else key < wanted
            less = less | (equal & earlier)
            equal = equal & (key == wanted)
    if context == "0,0":
        return df.where(equal)
    numbered = number_rows(df, row).withColumn("_hit", equal).withColumn("_less", less)
    facts = numbered.agg(F.min(F.when(F.col("_hit"), F.col("_row"))).alias("_first"), F.max(F.when(F.col("_hit"), F.col("_row"))).alias("_last"), F.count_if("_less").alias("_place"))
    low = F.when(F.col("_first").isNotNull(), F.col("_first") - before[0]).otherwise(F.col("_place") - before[1] + 1)
    high = F.when(F.col("_first").isNotNull(), F.col("_last") + after[0]).otherwise(F.col("_place") + after[1])
    bounds = facts.select(low.alias("_low"), high.alias("_high"))
    # The bounds are one row.
    return numbered.join(F.broadcast(bounds), F.col("_row").between(F.col("_low"), F.col("_high"))).drop("_row", "_hit", "_less", "_low", "_high")
