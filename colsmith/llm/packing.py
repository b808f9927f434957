"""Best-two-fit packing of tokenised documents into sequences.

A document is its token ids and one closing id. Longer ones than a sequence are cut into full pieces, the first piece taking the
rest. Full pieces are sequences of their own. The others, as rows of lengths only, are spread over shards of bounded size, and each
shard is packed by its histogram of lengths: a bin is filled greedily by the longest piece that fits; if a gap stays, the bin's
smallest piece gives way to the two unpacked pieces that fill its place and the gap most tightly, if they fill more than it did.
A shard wastes less than about one bin, so the loss against packing everything in one place is a few bins in tens of thousands.

Null or empty text: one piece, the closing id alone. Repeated rows are packed each. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm.common import give_back, materialize, sub_batches, text_or_empty
from colsmith.llm.tokens import MOST_PIECES, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Characters of text that are encoded at once. Fewer need less memory and more time.
BATCH_CHARS = 4_000_000


def cut(length: int, most: int) -> list[int]:
    """Lengths of a document's pieces: all full but for the first."""
    rest = length % most
    return ([rest] if rest else []) + [most] * (length // most)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, its offset there) for lengths of 1 to capacity."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1).tolist()
    there = 0  # bit s: an item of length s is left
    for s, n in enumerate(count):
        if n:
            there |= 1 << s
    upto = [(1 << (g + 1)) - 1 for g in range(capacity + 1)]
    bins: list[list[int]] = []

    def take(s: int) -> None:
        nonlocal there
        count[s] -= 1
        if not count[s]:
            there &= ~(1 << s)

    while there:
        bin_, gap = [], capacity
        while gap and (fit := (there & upto[gap])):
            s = fit.bit_length() - 1
            take(s)
            bin_.append(s)
            gap -= s
        if gap and there and bin_:
            small = bin_[-1]  # greedy filling takes falling lengths
            room = gap + small
            best, pair = small, None
            left = there & upto[room]
            while left:
                a = left.bit_length() - 1
                left &= ~(1 << a)
                if 2 * a <= best:  # the second isn't longer than the first
                    break
                can = there & upto[min(a, room - a)]
                if can and can.bit_length() - 1 == a and count[a] < 2:
                    can &= ~(1 << a)
                if can and a + can.bit_length() - 1 > best:
                    best, pair = a + can.bit_length() - 1, (a, can.bit_length() - 1)
                    if best == room:
                        break
            if pair:
                for s in pair:
                    take(s)
                bin_[-1:] = pair
                count[small] += 1
                there |= 1 << small
        bins.append(bin_)
    sizes = np.array([s for b in bins for s in b], np.int64)
    of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    ends = np.cumsum(sizes)
    offset = ends - sizes - np.repeat(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(b) for b in bins])])[:-1]], [len(b) for b in bins]) if len(bins) else ends
    slot = np.argsort(sizes, kind="stable")  # both sides sorted by length: items meet slots
    out_bin, out_offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    out_bin[order], out_offset[order] = of[slot], offset[slot]
    return out_bin, out_offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, batch_chars: int = BATCH_CHARS, most_pieces: int = MOST_PIECES) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, with_ids, the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, most_pieces)
        for batch in batches:
            chars = np.array(batch.column(2), np.int64)
            for a, b in sub_batches(chars, batch_chars):
                part = batch.slice(a, b - a)
                n, ids = tokens.encode(part.column(1))
                ends = np.cumsum(n)
                rows: list[tuple] = []
                blobs: list[np.ndarray] = []
                for doc, first, last in zip(part.column(0).to_pylist(), ends - n, ends):
                    own = np.append(ids[first:last], np.uint32(end_id)).astype("<u4")
                    at = 0
                    for k, size in enumerate(cut(len(own), capacity)):
                        blob = own[at : at + size]
                        rows.append((doc, k, at, size, zlib.crc32(blob)))
                        if with_ids:
                            blobs.append(blob.astype(np.int32))
                        at += size
                columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in blobs])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(blobs))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.length(text_or_empty()).alias("chars"))
    return texts.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack(table: DataFrame, capacity: int = 2048, shard_rows: int = 150_000) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (column length, 1 to capacity).

    table must be stored (materialize), as rows are numbered by its files. A shard holds about shard_rows rows of a few numbers.
    """
    keyed = table.withColumn("_row", F.monotonically_increasing_id())
    full = keyed.where(F.col("length") == capacity).select(*table.columns, (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = keyed.where(F.col("length") < capacity)
    shards = max(1, math.ceil(short.count() / shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["_shard"].iloc[0])
        bin_, offset = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns=["_shard", "_row"]).assign(sequence_id=2 * ((shard << 36) + bin_), offset=offset)

    fields = ", ".join(f"`{n}` {t}" for n, t in table.dtypes)
    packed = short.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards))).groupBy("_shard").applyInPandas(run, f"{fields}, sequence_id long, offset long")
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, batch_chars: int = BATCH_CHARS, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Documents to placed pieces; with_ids adds each piece's ids (array<int>), ready to be written in order of sequence and offset."""
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id, with_ids, batch_chars, most_pieces), "pieces"), capacity)
