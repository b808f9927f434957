"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints within 4 of 64 bits agree, in at least one of three segments, in all bits but at most one. So each distinct
fingerprint is indexed under 64 keys: a segment with one of its bits left out. Equal keys meet by one shuffle; their fingerprints
are compared in full. A partition of keys passes on only a spanning star of what it linked, not its pairs, and a key with very many
fingerprints is cut again by five blocks of the other bits, one of which two linked fingerprints must share. Components follow by
rounds of joins. Exact copies share one fingerprint, so the search runs over distinct fingerprints.

Where one document of each group is kept, as in pipelines, the same search over fingerprints of distinct words only finds candidates; their
sets of five-word shingles decide.

Null, empty and blank texts have fingerprint zero and are linked like any other. Fewer words than a shingle: the whole sequence is
the one shingle. Nulls in doc_id are never a component's name unless it has no other. Where one row of a component is kept, rows are
told apart by doc_id and a digest of the text, so none is lost to another one's missing or repeated id. An empty table gives an empty
table. Very long texts are read whole; columns besides doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.llm.common import BROADCAST_ROWS, drop_rows, forget, give_back, hot_keys, join_by_key, materialize, sub_batches, text_or_empty
from colsmith.llm.graph import components
from colsmith.llm.words import WordHashes, mix

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: First bit and width of the segments; within one, a pair differs by one bit at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of the index compared at once in a worker.
INDEX_ROWS = 400_000
#: Fingerprints under one key from which it is cut by blocks of the other bits.
LARGE_KEY = 512
#: Near copies in pipelines: words of a shingle, similarity, and bits by which the fingerprints of candidates may
#: differ, which are of single, distinct words: those of longer shingles lie 3 to 13 bits apart at that similarity.
NEAR_SHINGLE, NEAR, NEAR_BITS = 5, 0.8, 4
#: Documents and shingles of a group of candidates that one task takes, and documents of a larger one that are tried as keepers at once.
GROUP_ROWS, GROUP_SHINGLES, HEADS = 1000, 2_000_000, 64
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[str], shingle: int = SHINGLE, distinct: bool = False) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text, over all its shingles or the distinct ones (single words only)."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    docs, sizes = [], []
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        if distinct:
            words = list(set(words))
        joined = b" ".join(words)
        if distinct:
            hashes += [xxh64_intdigest(w, SEED) for w in words]
            sizes.append(len(words))
        elif len(words) <= shingle:
            hashes.append(xxh64_intdigest(joined, SEED))
            sizes.append(1)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            last = ends[shingle - 1 :].tolist()
            first = [0, *(ends[: len(last) - 1] + 1).tolist()]
            hashes += [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)]
            sizes.append(len(last))
        docs.append(k)
    if not docs:
        return out
    h, size = np.array(hashes, np.uint64), np.array(sizes, np.int64)
    begin = np.cumsum(size) - size
    # Bits are counted in eight lanes of eight bits, by groups of at most 255 hashes.
    groups = -(-size // 255)
    doc_group = np.cumsum(groups) - groups
    at = np.repeat(begin - 255 * doc_group, groups) + 255 * np.arange(groups.sum())
    counts = np.zeros((len(at), 64), np.int32)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, at)
        counts[:, bit::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts, doc_group, axis=0)
    bits = (2 * total > size[:, None]).astype(np.uint8)
    out[docs] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _key() -> Column:
    """128-bit digest of the text."""
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def fingerprints(docs: DataFrame, with_key: bool = False, shingle: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and, with_key, the digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what another operator's tasks have kept in this worker
        for batch in batches:
            for a, b in sub_batches(np.array(batch.column(2), np.int64)):
                part = batch.slice(a, b - a)
                found = [part.column(0), pa.array(fingerprints_of(part.column(1).to_pylist(), shingle, distinct).view(np.int64))]
                yield pa.RecordBatch.from_arrays(found + part.columns[3:], ["doc_id", "fp"] + ["key"] * with_key)
        forget()

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.length(text_or_empty()).alias("chars"), *[_key().alias("key")] * with_key)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", key binary" * with_key)


def _close(fps: np.ndarray, at: np.ndarray, bits: int = MOST_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (of those in at) within bits, compared in blocks."""
    out = []
    for i in range(0, len(at), 512):
        left = at[i : i + 512]
        for j in range(i, len(at), 4096):
            right = at[j : j + 4096]
            x, y = np.nonzero(np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= bits)
            keep = left[x] < right[y]
            out.append((left[x][keep], right[y][keep]))
    return out


def _star(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least position that each of n positions reaches over the pairs."""
    root = np.arange(n)
    if not pairs:
        return root
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(nxt := root[root], root):
            root = nxt
    return root


def link(keys: np.ndarray, fps: np.ndarray, bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fingerprint, fingerprint) of all that rows sorted by key link; rows of one key are all here."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(keys)))
    values, ident = np.unique(fps, return_inverse=True)
    pairs = []
    small = np.repeat(size <= 64, size)
    at, step = np.flatnonzero(small), 1
    while True:  # rows against the row `step` further on, as long as the key is the same
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= bits]
        pairs.append((ident[near], ident[near + step]))
        step += 1
    for k in np.flatnonzero(size > 64):
        own = np.arange(start[k], start[k] + size[k])
        found = []
        if len(own) <= LARGE_KEY:
            found = _close(fps, own, bits)
        else:
            seg = next((lo, w) for lo, w in SEGMENTS if lo <= (keys[start[k]] >> 32) < lo + w)
            others = np.array([b for b in range(64) if not seg[0] <= b < seg[0] + seg[1]], np.uint64)
            for block in np.array_split(others, bits + 1):
                mask = np.bitwise_or.reduce(np.uint64(1) << block)
                order = own[np.argsort(fps[own] & mask, kind="stable")]
                value = fps[order] & mask
                cuts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
                for a, b in zip(cuts, cuts[1:]):
                    if b - a > 1:
                        found += _close(fps, np.sort(order[a:b]), bits)
        pairs += [(ident[x], ident[y]) for x, y in found]
    root = _star(len(values), pairs)
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def links(distinct: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """a, b: edges between distinct fingerprints (column fp) that keep every component of links whole; bits: five at most, as three
    segments share them."""
    j = F.explode(F.sequence(F.lit(0), F.lit(63)))
    rows = distinct.select("fp", j.alias("j"))
    key = None
    for lo, width in SEGMENTS:
        part = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1))
        without = part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j") - lo)))
        inside = (F.col("j") >= lo) & (F.col("j") < lo + width)
        key = F.when(inside, without) if key is None else key.when(inside, without)
    rows = rows.select(F.call_function("shiftleft", F.col("j").cast("long"), F.lit(32)).bitwiseOR(key).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal keys, fps, held
            if not held:
                return
            k, f = np.concatenate(keys), np.concatenate(fps)
            upto = len(k) if last else int(np.searchsorted(k, k[-1]))  # the last key may go on
            if upto:
                a, b = link(k[:upto], f[:upto].view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            keys, fps, held = [k[upto:]], [f[upto:]], len(k) - upto

        bound = INDEX_ROWS
        for batch in batches:
            keys.append(np.array(batch.column(0)))
            fps.append(np.array(batch.column(1)))
            held += batch.num_rows
            if held >= bound:
                yield from done(False)
                bound = INDEX_ROWS + held  # one key of many rows is gathered whole, 16 bytes a row
        yield from done(True)
        keys, fps = [], []
        give_back()

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def _rooted(distinct: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """fp, first, root (the least fingerprint of its component) of each distinct fingerprint."""
    roots = components(links(distinct, bits)).withColumnRenamed("a", "fp")
    return distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    nodes = _rooted(distinct)
    named = nodes.join(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    found = join_by_key(prints, materialize(named, "named"), "fp", materialize(hot_keys(distinct, "fp", prints.count()), "hot-prints"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- one document of each group, for pipelines ----


def shingle_sets(texts: list[str], hashes: WordHashes, shingle: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; fewer words: the whole sequence; none: nothing."""
    out = []
    for text in texts:
        h = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())
        n = min(shingle, len(h))
        g = h[: len(h) - n + 1] if n else h
        for k in range(1, n):
            g = mix(g, h[k : len(h) - n + 1 + k])
        out.append(np.unique(g))
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float = NEAR) -> bool:
    """Whether two sets have a Jaccard similarity of `least` or more; two empty ones are alike."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def dropped_of(sets: list[np.ndarray]) -> list[int]:
    """Of a group in order: the places of those that are similar to an earlier one that stays."""
    stay: list[np.ndarray] = []
    gone = []
    for k, s in enumerate(sets):
        if any(similar(s, t) for t in stay):
            gone.append(k)
        else:
            stay.append(s)
    return gone


_MEMBER = "root long, doc_id long, key binary, size int, shingles binary"


def _members(docs: DataFrame) -> DataFrame:
    """root, doc_id, key, size, shingles of each distinct document that shares a group of fingerprints with another one."""
    prints = materialize(fingerprints(docs, with_key=True, shingle=1, distinct=True), "near-prints")
    nodes = prints.select("fp", "doc_id", "key").distinct()
    distinct = materialize(nodes.groupBy("fp").agg(F.count("*").alias("n"), F.lit(None).alias("first")), "near-distinct")
    rooted = _rooted(distinct, NEAR_BITS)
    groups = rooted.join(distinct.select("fp", "n"), "fp")
    several = groups.groupBy("root").agg(F.sum("n").alias("of")).where("of > 1")
    found = groups.join(several, "root").select("fp", "root")
    wanted = materialize(nodes.join(found, "fp").select("doc_id", "key", "root"), "near-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(100_000)
        for batch in batches:
            for a, b in sub_batches(np.array(batch.column(4), np.int64)):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column(3).to_pylist(), hashes)
                sizes = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sizes, pa.array([s.tobytes() for s in sets], pa.binary())], ["root", "doc_id", "key", "size", "shingles"])
        hashes.clear()
        forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("text")).withColumn("_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = rows.join(wanted, rows["_id"].eqNullSafe(wanted["doc_id"]) & (rows["_key"] == wanted["key"]))
    texts = texts.select("root", "doc_id", "key", "text", F.length("text").alias("chars"))
    return materialize(texts.mapInArrow(run, _MEMBER).dropDuplicates(["doc_id", "key"]), "near-sets")


_GONE = "doc_id long, key binary"


def _sorted_sets(rows: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    """Rows by doc_id, nulls last, then digest, with their sets."""
    ids, keys = rows.column("doc_id").to_pylist(), rows.column("key").to_pylist()
    rows = rows.take(sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, keys[k])))
    return rows, [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, key (a digest of the text) of the documents that are near copies of one that stays.

    Documents whose fingerprints of distinct words are linked by NEAR_BITS or fewer bits, over any number of links, form a group of
    candidates. In a group, in order of doc_id (nulls last) and digest, a document stays if its Jaccard similarity over
    NEAR_SHINGLE-word shingles with each that stays before it is below NEAR. So no two that stay in a group are near copies, and
    nothing goes that isn't one of a document that stays.

    Groups of bounded size are worked out by one task each. In larger ones the first HEADS that are undecided are worked out among
    themselves in each round, the rest is tested against those of them that stay, in parts of bounded size, and goes on without
    what is similar, until it is within bounds. The result is the same.
    """
    left = _members(docs)
    order = [F.col("doc_id").asc_nulls_last(), F.col("key").asc()]
    gone: list[DataFrame] = []

    def settle(rows: pa.Table) -> pa.Table:
        if len(rows) == 1:
            return rows.slice(0, 0).select(["doc_id", "key"])
        rows, sets = _sorted_sets(rows)
        return rows.take(pa.array(dropped_of(sets), pa.int64())).select(["doc_id", "key"])

    def first_few(rows: pa.Table) -> pa.Table:
        rows, sets = _sorted_sets(rows)
        out = set(dropped_of(sets))
        return rows.select(["root", "doc_id", "key", "shingles"]).append_column("stays", pa.array([k not in out for k in range(len(sets))]))

    def against(rows: pa.Table, leaders: pa.Table) -> pa.Table:
        those = [np.frombuffer(x, np.uint64) for x in leaders.column("shingles").to_pylist()]
        alike = [any(similar(np.frombuffer(x, np.uint64), y) for y in those) for x in rows.column("shingles").to_pylist()]
        return rows.select(["root", "doc_id", "key", "size", "shingles"]).append_column("alike", pa.array(alike, pa.bool_()))

    while True:
        sizes = left.groupBy("root").agg(F.count("*").alias("rows"), F.sum(F.col("size").cast("long")).alias("total"))
        parts = F.ceil(F.greatest(F.col("rows") / GROUP_ROWS, F.col("total") / GROUP_SHINGLES)).cast("int")
        large = materialize(sizes.where("rows > 1").select("root", parts.alias("parts")).where("parts > 1"), "near-large")
        gone.append(materialize(left.join(large, "root", "left_anti").groupBy("root").applyInArrow(settle, _GONE), "near-gone"))
        if large.isEmpty():
            return functools.reduce(DataFrame.unionByName, gone)
        rest = left.join(large, "root")
        few = rest.withColumn("at", F.row_number().over(W.partitionBy("root").orderBy(*order))).where(F.col("at") <= HEADS)
        heads = materialize(few.select("root", "doc_id", "key", "shingles").groupBy("root").applyInArrow(first_few, "root long, doc_id long, key binary, shingles binary, stays boolean"), "near-heads")
        gone.append(heads.where("not stays").select("doc_id", "key"))
        named = heads.select(F.col("root").alias("h_root"), F.col("doc_id").alias("h_id"), F.col("key").alias("h_key"))
        others = rest.join(named, (rest["root"] == named["h_root"]) & rest["doc_id"].eqNullSafe(named["h_id"]) & (rest["key"] == named["h_key"]), "left_anti")
        others = others.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
        leaders = heads.where("stays").join(large, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "shingles")
        tested = others.groupBy("root", "part").cogroup(leaders.groupBy("root", "part")).applyInArrow(against, f"{_MEMBER}, alike boolean")
        tested = materialize(tested, "near-tested")
        gone.append(tested.where("alike").select("doc_id", "key"))
        left = tested.where("not alike").drop("alike")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay of each group of near copies, with all their columns. Rows are told apart by doc_id and a digest of the
    text; of rows equal in both, which are copies of one text, one stays."""
    gone = near_copies(docs).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    gone = materialize(gone, "near-dropped")
    left = drop_rows(docs, gone, F.unhex(F.md5(text_or_empty().cast("binary"))))
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("i"), _key().alias("k")).count().where("count > 1")
    if ids.isEmpty():
        return left
    return left.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_key", _key()).dropDuplicates(["_id", "_key"]).drop("_id", "_key")
