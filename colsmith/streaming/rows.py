"""The row-local operators on unbounded tables, and running groups with late data.

cut, grep and the value transforms are functions of one row, so they run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.functions.agg import aggregator
from colsmith.operators.filter import condition
from colsmith.operators.project import cut
from colsmith.plans import columns as C

#: Aggregates whose state is of fixed size; lists and ordered folds would grow with the stream.
BOUNDED = {"count", "sum", "mean", "avg", "asum", "amin", "amax", "amean", "aavg", "prefix", "suffix"}


def pipeline(stream: DataFrame, patterns: Sequence[str] = (), steps: Sequence = (), any_of: bool = False) -> DataFrame:
    """Filter, then project, each row by itself."""
    kept = stream.where(condition(stream, patterns, any_of)) if patterns else stream
    return cut(kept, *steps) if steps else kept


def windowed(stream: DataFrame, time: str, window: str, keys: Sequence[str], aggs: Sequence[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """new,col,agg aggregates by keys and window of event time; rows later than `late` are dropped by the watermark, as asked."""
    out = []
    for spec in aggs:
        new, source, agg = spec.split(",", 2)
        name = agg.split(",")[0]
        if name not in BOUNDED and not (name in ("min", "max") and "," not in agg):
            raise ValueError(f"{agg!r} needs unbounded state on a stream")
        out.append(aggregator(agg).group(C.col(source), F.lit(0)).alias(new))
    if dict(stream.dtypes)[time] == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(*out)


def distinct_stream(stream: DataFrame, keys: Sequence[str], time: str, late: str = "10 minutes") -> DataFrame:
    """First row of each key, keys being forgotten after `late`."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
