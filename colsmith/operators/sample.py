"""sample: rows by position; every sampler needs the number of rows at most, never the rows themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.functions.trans import ranges
from colsmith.plans.ordering import number_rows


def even_positions(total: int, size: int) -> list[int]:
    """Positions (from 0) of `size` rows spread evenly over `total`, the first and last included, as a one-pass sampler keeps them: slots
    fill up, and when they are full the distance doubles and slots between the ends are thinned out."""
    small = max(2, size)
    large = 2 * small - 2
    kept: list[int] = []
    step, wait = 1, 0

    def thin() -> None:
        nonlocal kept
        n = len(kept)
        if n <= small:
            return
        if small == 2:
            kept = [kept[0], kept[-1]]
            return
        ratio = (n - 2) / (small - 2)
        slots = list(kept)
        for i in range(1, small - 1):
            j = int(i * ratio)
            slots[i], slots[j] = slots[j], slots[i]
        slots[small - 1], slots[n - 1] = slots[n - 1], slots[small - 1]
        kept = slots[:small]

    at = 0
    while at < total:
        if wait == 0:
            if len(kept) >= large:
                step *= 2
                thin()
            kept.append(at)
            at += 1
            if step > 1:
                wait = 1
        else:  # the newest slot follows the rows until the distance is reached
            limit = 2 * step if len(kept) == large else step
            ahead = min(limit - wait, total - at)
            at += ahead
            kept[-1] = at - 1
            wait += ahead
            if wait >= limit:
                wait = 0
    thin()
    return kept


def sample_even(df: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """`size` rows spread evenly, first and last included."""
    numbered = number_rows(df, by)
    wanted = [p + 1 for p in even_positions(df.count(), size)]
    if len(wanted) <= 1000:
        return numbered.where(F.col("_row").isin(*wanted)).drop("_row")
    rows = df.sparkSession.createDataFrame([(p,) for p in wanted], "_row long")
    return numbered.join(rows, "_row", "left_semi").drop("_row")


def sample_every(df: DataFrame, by: Sequence[str], step: int, first: int = 1, last: int | None = None) -> DataFrame:
    """Every step-th row from first to last."""
    n = F.col("_row")
    keep = (n >= first) & ((n - first) % step == 0)
    return number_rows(df, by).where(keep & (n <= last) if last is not None else keep).drop("_row")


def sample_ranges(df: DataFrame, by: Sequence[str], spec: str) -> DataFrame:
    """Rows at positions such as 1-5,42,100-."""
    n, keep = F.col("_row"), F.lit(False)
    for a, b in ranges(spec):
        keep = keep | ((n >= a) & (n <= b) if b is not None else n >= a)
    return number_rows(df, by).where(keep).drop("_row")
