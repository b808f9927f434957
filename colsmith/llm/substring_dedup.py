"""Substring deduplication over a compacted de Bruijn graph of repeated windows.

Every window of WINDOW consecutive words is an edge between two nodes, its first and its last WINDOW - 1 words. To find the edges that
repeat, windows that follow one another and have the same least gram of MINIMIZER words cross the network as one row under that gram,
with their coordinates and a 48-bit hash each; under a gram that is hot in a sample of the documents, window by window under their own
hashes. Each occurrence of a repeated edge but the first refers to the coordinates of the one before it, its source, and becomes part of a
fragment: a walk along edges that stand side by side at their source too. Fragments that meet at a node are joined on its coordinates;
where one goes on with another source the node branches, and through all other nodes Spark joins compact them into long spans. Each
span's words are then verified at the source's coordinates by SHA-256 before they count. Windows whose hashes met without their words
being equal are compared by their words, so hashes never decide. Before the shuffle each worker does the same within blocks of its own
text, comparing words, so a passage that many documents share sends at most one row a block.

Null, empty and short texts have no window: nothing is removed. A very long text is worked out whole, in memory of its own words. A
null doc_id sorts before all others, and each row without an id is a document of its own, numbered in a stored table. Rows that repeat
a doc_id are told apart by a hash of their texts; only those that repeat the text too count as one document: a window is never earlier
than itself, and what is removed is removed in each such row. An empty table gives an empty table; columns besides doc_id and text are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.llm.common import give_back, materialize, sub_batches, text_or_empty
from colsmith.llm.words import WordHashes, longer

WINDOW, MINIMIZER = 20, 8
#: Characters of text in which a worker looks for repeats before anything is sent.
BLOCK_CHARS = 4_000_000
#: Bytes of a window's hash that travel with it, and rows that are compared at once.
HASH_BYTES, ROWS = 6, 50_000
#: Documents of the sample that tells hot grams, at most and as one in so many, and documents from which on, by the sample, a gram is hot:
#: more than one task should take. It decides only where windows meet, never what is found.
HOT_SAMPLE, HOT_EVERY, HOT_DOCS = 200_000, 20, 1_000_000
_ROW = ["at", "doc", "row", "start", "n", "hashes"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_FRAGMENT = ["doc", "row", "start", "n", "s_doc", "s_row", "s_start"]
_FRAGMENT_SCHEMA = "doc long, row long, start int, n int, s_doc long, s_row long, s_start int"
#: What a row that is known to repeat holds in place of hashes: the coordinates of its source. Its n is negative.
_SOURCE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i4")])
#: Stands for a null doc_id.
_NONE = -(1 << 63)


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of 20 words, its least hash of 8 words) from the words' hashes of one run of words."""
    g2 = longer(h, h, 1)
    g4 = longer(g2, g2, 2)
    g8 = longer(g4, g4, 4)
    g16 = longer(g8, g8, 8)
    g20 = longer(g16, g4, 16)
    m2 = np.minimum(g8[:-1], g8[1:])
    m4 = np.minimum(m2[:-2], m2[2:])
    m8 = np.minimum(m4[:-4], m4[4:])
    m12 = np.minimum(m8[:-4], m4[8:])
    return g20, np.minimum(m12[:-1], g8[12:])


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs that begin where breaks is true."""
    start = np.flatnonzero(breaks)
    return start, np.diff(np.append(start, len(breaks)))


def _ranks(doc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each document among all, doc and row of each rank): documents are in order of (doc, row)."""
    order = np.lexsort((row, doc))
    d, r = doc[order], row[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, d[new], r[new]


def _later(doc: np.ndarray, start: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a window of the same group starts earlier in (doc, start), the position of the one before it)."""
    order = np.lexsort((start, doc, groups))
    g = groups[order]
    source = np.empty(len(g), np.int64)
    source[order] = np.where(np.concatenate([[False], g[1:] == g[:-1]]), np.concatenate([order[:1], order[:-1]]), order)
    return (doc != doc[source]) | (start != start[source]), source


def _steps(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each window follows the one before it."""
    return np.concatenate([[False], (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1)])


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def block_paths(docs: list[int], rows: list[int], texts: list[str], hashes: WordHashes, hot: np.ndarray, hash_bits: int = 64) -> pa.RecordBatch:
    """A block's windows: rows to compare under their gram, and rows whose words were found earlier in the block."""
    doc_of, start_of, window, least = [], [], [], []
    rank, doc_at, row_at = _ranks(np.array(docs, np.int64), np.array(rows, np.int64))
    for doc, text in zip(rank.tolist(), texts):
        words = _words(text)
        if len(words) < WINDOW:
            continue
        g, m = window_hashes(hashes.of(words))
        doc_of.append(np.full(len(g), doc, np.int64))
        start_of.append(np.arange(len(g), dtype=np.int32))
        window.append(g)
        least.append(m)
    if not doc_of:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], _ROW)
    doc, start, g, m = map(np.concatenate, (doc_of, start_of, window, least))
    if hash_bits < 64:
        g &= np.uint64((1 << hash_bits) - 1)
    later, source_at = _later(doc, start, g)
    follows = _steps(doc, start)
    s_doc, s_start = doc[source_at], start[source_at]
    aligned = follows & _steps(s_doc, s_start) & later & np.concatenate([[False], later[:-1]])
    # What the hashes say repeats is compared word by word; where words differ it is sent like any other.
    text_at = dict(zip(rank.tolist(), texts))
    split: dict[int, list[bytes]] = {}

    def span(d: int, a: int, n: int) -> list[bytes]:
        if d not in split:
            split[d] = _words(text_at[d])
        return split[d][a : a + n + WINDOW - 1]

    at_later = np.flatnonzero(later)
    begin, n = _runs(~aligned[at_later]) if len(at_later) else (np.zeros(0, np.int64),) * 2
    for i, size in zip(at_later[begin].tolist(), n.tolist()):
        if span(int(doc[i]), int(start[i]), size) != span(int(s_doc[i]), int(s_start[i]), size):
            later[i : i + size] = False
    aligned &= later
    key = m.view(np.int64)
    if len(hot):
        key = np.where(hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key, g.view(np.int64), key)
    together = aligned | (follows & ~later & ~np.concatenate([[False], later[:-1]]) & np.concatenate([[False], key[1:] == key[:-1]]))
    begin, n = _runs(~together)
    known = later[begin]
    own_doc, own_row = doc_at[doc[begin]], row_at[doc[begin]]
    at = np.where(known, (own_doc ^ own_row) * 1_000_003 + start[begin], key[begin])  # any place will do for known rows
    size = np.where(known, _SOURCE.itemsize, n * HASH_BYTES)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    tail = np.empty(ends[-1], np.uint8)
    is_source = np.repeat(known, size)
    tail[~is_source] = g[np.repeat(~known, n)].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].ravel()
    source = np.empty(known.sum(), _SOURCE)
    source["doc"], source["row"], source["start"] = doc_at[s_doc[begin[known]]], row_at[s_doc[begin[known]]], s_start[begin[known]]
    tail[is_source] = source.view(np.uint8)
    blob = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(tail)])
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(own_doc), pa.array(own_row), pa.array(start[begin]), pa.array(np.where(known, -n, n).astype(np.int32)), blob], _ROW)


def _fragments(doc: np.ndarray, row: np.ndarray, start: np.ndarray, s_doc: np.ndarray, s_row: np.ndarray, s_start: np.ndarray) -> pa.RecordBatch:
    """Windows in order of their rows, with their sources, as fragments."""
    if len(doc):
        on = _steps(doc, start) & _steps(s_doc, s_start)
        on[1:] &= (row[1:] == row[:-1]) & (s_row[1:] == s_row[:-1])
        begin, n = _runs(~on)
    else:
        begin, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[begin], row[begin], start[begin].astype(np.int32), n.astype(np.int32), s_doc[begin], s_row[begin], s_start[begin].astype(np.int32))], _FRAGMENT)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (at, doc, row, start): the fragments. Of the last key only the last of each window seen stays in memory."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    last, seen = None, none
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            at, doc, row, start, n = (np.array(part.column(k)) for k in range(5))
            raw = part.column(5)
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
            known = n < 0
            if known.any():
                source = data[ends[:-1][known][:, None] + np.arange(_SOURCE.itemsize)].ravel().view(_SOURCE)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[known], row[known], start[known], -n[known], source["doc"].copy(), source["row"].copy(), source["start"].copy())], _FRAGMENT)
            if known.all():
                continue
            here = np.repeat(~known, np.diff(ends))
            at, doc, row, start, n = (x[~known] for x in (at, doc, row, start, n))
            h = np.zeros((here.sum() // HASH_BYTES, 8), np.uint8)
            h[:, :HASH_BYTES] = data[ends[0] : ends[-1]][here].reshape(-1, HASH_BYTES)
            h = h.view("<u8").ravel()
            key = np.cumsum(np.concatenate([[at[0] != last if last is not None else True], at[1:] != at[:-1]])).astype(np.uint64)
            rank, doc_at, row_at = _ranks(doc, row)
            d, k = np.repeat(rank, n), np.repeat(key, n)
            s = np.repeat(start, n).astype(np.int64) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            # Windows of the key that went on from before stand first, under no document, none equal to another.
            carried = seen if last is not None and at[0] == last else none
            c = len(carried[0])
            w_doc, w_row, w_start = np.concatenate([carried[1], doc_at[d]]), np.concatenate([carried[2], row_at[d]]), np.concatenate([carried[3], s])
            d, s = np.concatenate([np.full(c, -1), d]), np.concatenate([np.arange(c), s])
            k, h = np.concatenate([np.full(c, key[0], np.uint64), k]), np.concatenate([carried[0], h])
            later, to = _later(d, s, (k << np.uint64(48)) | h)  # at most ROWS + 1 keys: 16 bits
            has_next = np.zeros(len(to), bool)
            has_next[to[to != np.arange(len(to))]] = True
            stay = (k == k[-1]) & ~has_next
            last, seen = at[-1], (h[stay], w_doc[stay], w_row[stay], w_start[stay])
            # A row that repeats meets its own windows again.
            later &= (w_doc != w_doc[to]) | (w_row != w_row[to]) | (w_start != w_start[to])
            to = to[later]
            yield _fragments(w_doc[later], w_row[later], w_start[later], w_doc[to], w_row[to], w_start[to])


def hot_grams(rows: DataFrame, n: int) -> np.ndarray:
    """Least grams that many documents of a sample have, sorted: at most those of the sample's documents, by twenty."""
    every = max(HOT_EVERY, n // HOT_SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                words = _words(text)
                if len(words) >= WINDOW:
                    found.append(np.unique(window_hashes(hashes.of(words))[1]))
            grams, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(count)], ["gram", "n"])

    drawn = rows.where(F.pmod(F.xxhash64("doc", "row", F.lit(1)), F.lit(every)) == 0).select("text")
    most = drawn.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(20, HOT_DOCS // every))
    return np.sort(np.array([r["gram"] for r in most.collect()], np.int64))


def fragments(rows: DataFrame, n: int, hash_bits: int = 64) -> DataFrame:
    """doc, row, start, n and the source's coordinates of _keyed() rows (n of them): runs of windows that, by their hashes, stand in
    the same order at the source, where they occurred the time before."""
    hot = hot_grams(rows, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids: list[int] = []
        numbers: list[int] = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for a, b in sub_batches(np.array(batch.column(3), np.int64)):
                part = batch.slice(a, b - a)
                ids += part.column(0).to_pylist()
                numbers += part.column(1).to_pylist()
                texts += part.column(2).to_pylist()
                held += sum(part.column(3).to_pylist())
                if held >= BLOCK_CHARS:
                    yield block_paths(ids, numbers, texts, hashes, hot, hash_bits)
                    ids, numbers, texts, held = [], [], [], 0
                    give_back()
        if texts:
            yield block_paths(ids, numbers, texts, hashes, hot, hash_bits)
        ids, numbers, texts = [], [], []
        hashes.clear()
        give_back()

    paths = rows.withColumn("chars", F.length("text")).mapInArrow(run, "at long, doc long, row long, start int, n int, hashes binary")
    return paths.repartition("at").sortWithinPartitions("at", "doc", "row", "start").mapInArrow(_compare, _FRAGMENT_SCHEMA)


def compacted(found: DataFrame, repeated: bool = False) -> DataFrame:
    """Fragments joined through nodes that don't branch into long spans, of the same columns; repeated says that rows may repeat.

    An arc leads from a fragment to the one that goes on where it ends. If the source goes on there too the node has one edge in and one
    out; if not, the node is another source's as well, and both names of it branch. A fragment without such an arc, or at a node that
    branches, heads a path; a document's fragments are numbered by the heads among those before them.
    """
    if repeated:
        found = found.groupBy("doc", "row", "start").agg(F.max(F.struct("n", "s_doc", "s_row", "s_start")).alias("p")).select("doc", "row", "start", "p.*")
    parts = materialize(found.select(*_FRAGMENT), "fragments")
    node = ["s_doc", "s_row", "s_start"]
    ends = parts.select("doc", "row", (F.col("start") + F.col("n")).alias("start"), F.col("s_doc").alias("e_doc"), F.col("s_row").alias("e_row"), (F.col("s_start") + F.col("n")).alias("e_start"))
    straight = (F.col("s_doc") == F.col("e_doc")) & (F.col("s_row") == F.col("e_row")) & (F.col("s_start") == F.col("e_start"))
    arcs = materialize(parts.join(ends, ["doc", "row", "start"], "left").withColumn("straight", F.coalesce(straight, F.lit(False))), "arcs")
    bent = arcs.where("not straight and e_doc is not null")
    branching = bent.select(*node).unionByName(bent.select(F.col("e_doc").alias("s_doc"), F.col("e_row").alias("s_row"), F.col("e_start").alias("s_start"))).distinct()
    tested = arcs.drop("e_doc", "e_row", "e_start").join(branching.withColumn("branching", F.lit(True)), node, "left")
    head = F.when(F.col("straight") & F.col("branching").isNull(), 0).otherwise(1)
    path = F.sum(head).over(W.partitionBy("doc", "row").orderBy("start").rowsBetween(W.unboundedPreceding, 0))
    n = F.max(F.col("start") + F.col("n")) - F.min("start")
    return tested.withColumn("path", path).groupBy("doc", "row", "path").agg(F.min("start").alias("start"), n.alias("n"), *[F.min(c).alias(c) for c in node]).select(*_FRAGMENT)


def _keyed(docs: DataFrame) -> tuple[DataFrame, int, bool]:
    """(doc, row, text of every row, their number, whether ids repeat): row tells apart the rows of one doc. It is 0 where ids don't repeat; rows without an id are stored with a number."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.count("*").alias("n"))
    seen = ids.agg(F.sum("n").alias("rows"), F.count(F.when(F.col("doc").isNull(), 1)).alias("none"), F.count(F.when(F.col("doc").isNotNull() & (F.col("n") > 1), 1)).alias("repeated")).first()
    doc = F.col("doc_id").cast("long")
    row = F.xxhash64(text_or_empty()) if seen["repeated"] else F.lit(0).cast("long")
    named = docs.select(doc.alias("doc"), row.alias("row"), text_or_empty().alias("text")).where("doc is not null")
    if not seen["none"]:
        return named, seen["rows"] or 0, seen["repeated"] > 0
    bare = docs.where(doc.isNull()).select(F.lit(_NONE).cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    return named.unionByName(materialize(bare, "without-id")), seen["rows"], seen["repeated"] > 0


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words that stay, given the spans of windows that repeat."""
    if not spans:
        return words
    edge = np.zeros(len(words) + WINDOW + 1, np.int64)
    first = np.array([p["start"] for p in spans], np.int64)
    last = np.minimum(first + np.array([p["n"] for p in spans], np.int64) - 1 + WINDOW, len(words))
    ok = first < last
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, last[ok], -1)
    gone = np.cumsum(edge)[: len(words)] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


_LOOKED = "doc long, row long, own boolean, start int, n int, s_doc long, s_row long, s_start int, digest binary, n_words long, n_removed long, kept_sha256 string, text string"
_SPAN = "array<struct<own:boolean,start:int,n:int,s_doc:bigint,s_row:bigint,s_start:int>>"


def looked_up(keyed: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """Two sorts of rows: what stays of each document, if all its spans are right (own is null), and a digest of the words of each
    span, in its document (own) and at its source (not own)."""
    names = _LOOKED.replace(",", "").split()[::2]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                for doc, row, text, wanted in zip(*(part.column(k).to_pylist() for k in range(4))):
                    words, wanted = _words(text), wanted or []
                    for p in wanted:
                        digest = hashlib.sha256(b" ".join(words[p["start"] : p["start"] + p["n"] + WINDOW - 1])).digest()
                        out.append((doc, row, p["own"], p["start"], p["n"], p["s_doc"], p["s_row"], p["s_start"], digest, None, None, None, None))
                    left = kept_words(words, [p for p in wanted if p["own"]])
                    joined = b" ".join(left)
                    out.append((doc, row, *[None] * 7, len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    own = spans.select("doc", "row", F.struct(F.lit(True).alias("own"), "start", "n", "s_doc", "s_row", "s_start").alias("p"))
    source = spans.select("s_doc", "s_row", "s_start", "n").distinct()
    source = source.select(F.col("s_doc").alias("doc"), F.col("s_row").alias("row"), F.struct(F.lit(False).alias("own"), F.col("s_start").alias("start"), "n", "s_doc", "s_row", "s_start").alias("p"))
    wanted = own.unionByName(source).groupBy("doc", "row").agg(F.collect_list("p").alias("wanted"))
    return keyed.join(wanted, ["doc", "row"], "left").select("doc", "row", "text", F.col("wanted").cast(_SPAN)).mapInArrow(run, _LOOKED)


def told_apart(keyed: DataFrame, wrong: DataFrame) -> DataFrame:
    """Of spans whose words aren't their source's: the windows that do repeat, compared by their words with all others of such spans and
    of their sources. Where windows of one hash change from some words to others, the last of the former is a source of such a span, so
    an earlier one of the same words is among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words = _words(text)
                at = sorted({(k, p["own"]) for p in wanted for k in range(p["start"], p["start"] + p["n"])})
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array([k for k, _ in at], pa.int32()), pa.array([o for _, o in at], pa.bool_()), pa.array([b" ".join(words[k : k + WINDOW]) for k, _ in at], pa.binary())], ["doc", "row", "start", "own", "words"])

    own = wrong.select("doc", "row", F.struct(F.lit(True).alias("own"), "start", "n").alias("p"))
    source = wrong.select(F.col("s_doc").alias("doc"), F.col("s_row").alias("row"), F.struct(F.lit(False).alias("own"), F.col("s_start").alias("start"), "n").alias("p"))
    wanted = own.unionByName(source).groupBy("doc", "row").agg(F.collect_set("p").alias("wanted"))
    windows = materialize(keyed.dropDuplicates(["doc", "row"]).join(wanted, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(run, "doc long, row long, start int, own boolean, words binary"), "windows")
    first = windows.groupBy("words").agg(F.min(F.struct("doc", "row", "start")).alias("first"))
    again = windows.where("own").join(first, "words").where(F.struct("doc", "row", "start") > F.col("first"))
    return again.select("doc", "row", "start", F.lit(1).alias("n"), F.col("first.doc").alias("s_doc"), F.col("first.row").alias("s_row"), F.col("first.start").alias("s_start"))


def remove_repeats(docs: DataFrame, with_text: bool = False, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, the text of the words that stay. Fewer hash_bits make hashes of different
    windows meet, which costs time and changes nothing."""
    keyed, n, repeated = _keyed(docs)
    spans = materialize(compacted(fragments(keyed, n, hash_bits), repeated), "spans")
    looked = materialize(looked_up(keyed, spans, with_text), "looked-up")
    digests = looked.where("own is not null")
    source = digests.where("not own").select("s_doc", "s_row", "s_start", "n", F.col("digest").alias("s_digest")).distinct()
    wrong = digests.where("own").join(source, ["s_doc", "s_row", "s_start", "n"]).where("digest <> s_digest").select(*_FRAGMENT)
    wrong = materialize(wrong, "wrong")
    results = looked.where("own is null")
    if not wrong.isEmpty():
        right = spans.join(wrong, _FRAGMENT, "left_anti").unionByName(told_apart(keyed, wrong))
        touched = wrong.select("doc", "row").distinct()
        again = looked_up(keyed.join(touched, ["doc", "row"], "left_semi"), right.join(touched, ["doc", "row"], "left_semi"), with_text).where("own is null")
        results = results.join(touched, ["doc", "row"], "left_anti").unionByName(again)
    doc_id = F.when(F.col("doc") != F.lit(_NONE).cast("long"), F.col("doc")).alias("doc_id")
    return results.select(doc_id, "n_words", "n_removed", "kept_sha256", *["text"] * with_text)


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)
), m AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM w) WHERE r > 1
), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM m
), p AS (
  SELECT d.doc_id, d.n, d.word, d.pos, g.p IS NOT NULL AS gone
  FROM (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d) d LEFT JOIN g ON d.doc_id = g.doc_id AND d.pos = g.p
), s AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM p GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
