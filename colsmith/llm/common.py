"""Shared pieces: tables in the shared folder, text chunks for Arrow workers, joins that survive hot keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.session import new_path

#: A key counts as hot from this share of all rows on, so at most 1/HOT_SHARE keys can be hot: that bounds every broadcast of hot keys.
HOT_SHARE = 1 / 1000
#: Characters of text that a Python worker holds as words at once.
SUB_BATCH_CHARS = 2_000_000
#: Rows of (id, digest), about 50 bytes each, up to which they are broadcast, by count; beyond, they meet by shuffle.
BROADCAST_ROWS = 200_000


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sub_batches(lengths: np.ndarray, limit: int = SUB_BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` characters each; a longer single text is a range of its own."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(lengths):
        yield first, len(lengths)


def hot_keys(groups: DataFrame, key: str, rows: int, count: str = "n") -> DataFrame:
    """Keys holding at least HOT_SHARE of all rows: at most 1/HOT_SHARE of them, however large the input is."""
    return groups.where(F.col(count) >= max(2, rows * HOT_SHARE)).select(key)


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined to facts (one row a key, every key of rows present). Hot keys meet by a bounded broadcast, the rest by shuffle."""
    hot = hot.withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    facts_hot = facts.join(F.broadcast(hot.select(key)), key, "left_semi")
    few = marked.where("_hot").drop("_hot").join(F.broadcast(facts_hot), key)
    rest = marked.where("_hot is null").drop("_hot").join(facts.join(F.broadcast(hot.select(key)), key, "left_anti"), key)
    return few.unionByName(rest)


def drop_rows(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """docs without the rows whose (doc_id, key) is in gone, a stored table of _id and _key; key is an expression over docs."""
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (key == gone["_key"]), "left_anti")


def give_back() -> None:
    """Memory of what was dropped, to the operating system: workers live on into the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_KEPT: dict = {}


def forget() -> None:
    """Drop what the worker keeps, and give its memory back: at the end of tasks that keep nothing for the next."""
    _KEPT.clear()
    give_back()


def kept(key: tuple, make: Callable):
    """What a worker keeps between tasks: one operator's caches at a time, so those of a stage before don't stay in memory."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT[key] = make()
    return _KEPT[key]
