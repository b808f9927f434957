"""Token ids in ORC: stripes with integer run-length encoding, row indexes, and Bloom filters on doc_id.

Rows are range-partitioned and sorted by doc_id, so file and stripe statistics prune by range and Bloom filters by single id.
Each row has its start within its file's part; starts in the whole corpus follow from one total a part.

Null text counts as empty: its ids are the end id alone. Rows of one doc_id stand side by side, by text. Null ids come first.
An empty table writes no stripes and reads back empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from colsmith.llm.common import sub_batches, text_or_empty
from colsmith.llm.tokens import BATCH_CHARS, encoder

STORED = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, parts: int | None = None, stripe_mb: int = 16) -> None:
    """Encode whole texts and write them to path in ascending doc_id."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in sub_batches(np.array(batch.column(2), np.int64), BATCH_CHARS):
                own = batch.slice(a, b - a)
                n, ids = tokens.encode(own.column(1))
                ends = np.cumsum(n)
                flat = np.insert(ids.astype(np.int32), ends, end_id)
                n = n + 1
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(flat))],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    stored = ordered.withColumn("chars", F.length("text")).mapInArrow(run, STORED)
    (
        stored.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000").option("orc.stripe.size", str(stripe_mb << 20)).option("orc.compress", "ZSTD").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; doc_ids is pushed down to stripe statistics and Bloom filters."""
    rows = spark.read.schema(STORED).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(*doc_ids))


def stripes(path: str) -> list[tuple[str, int]]:
    """(file, stripe) of every stripe of a local folder, for readers that take stripes in parallel without Spark."""
    from pathlib import Path

    from pyarrow import orc

    return [(str(f), k) for f in sorted(Path(path.removeprefix("file://")).glob("*.orc")) for k in range(orc.ORCFile(str(f)).nstripes)]


def read_stripe(file: str, stripe: int, columns: list[str] | None = None) -> pa.RecordBatch:
    from pyarrow import orc

    return orc.ORCFile(file).read_stripe(stripe, columns)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, all from the ids that the files hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            offsets = np.asarray(lists.offsets)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path)
    found = rows.select("doc_id", "part", "start_in_part", "ids").mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # One row a part: the number of parts is the writer's parameter.
    before = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n")).select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
