"""transpose: rows become columns. For small tables: the result has a column a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.plans import columns as C
from colsmith.plans.ordering import number_rows


def transpose(df: DataFrame, by: Sequence[str], most: int = 1000, name: str = "column") -> DataFrame:
    """One row a column: its name, then its values as r1, r2, ... in the order of `by`. More than `most` rows are an error."""
    columns = C.data_columns(df)
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"transpose: more than {most} rows")
    long = number_rows(df, by).select("_row", F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(c).alias(name), C.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])))
    wide = long.groupBy("_i", name).pivot("_row", list(range(1, n + 1))).agg(F.first("v"))
    return wide.select("_i", name, *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(f"r{k}") for k in range(1, n + 1)]).orderBy("_i").drop("_i")
