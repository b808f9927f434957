"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models of one form and one open vocabulary: the target's counts come from documents labelled as good, the
background's from all documents. Each document gets the mean, over its tokens, of the background's loss less the target's: higher
means more like the target. What a document itself added to the counts is taken out while it is scored. Counts cover every token of the corpus and grow with it; nothing is cut off, sampled or hashed to a
fixed size, and no model is ever held in one place.

Documents are spread over chunks of bounded text. A chunk's distinct grams go out once, sorted by hash and cut into ranges; each
range adds up all chunks' counts and answers a chunk only for the grams that others have too. The chunk's documents then meet their
own chunk's answers and are scored there. So a frequent gram costs a row a chunk, not a row a use, and the text crosses the network
once, both passes sharing that shuffle.

Null, empty and blank texts have no tokens: losses and score are 0. Documents without a label only count as background. No label at
all leaves an empty target model: every document is scored against the smoothing alone. Rows that repeat a doc_id are scored each;
null doc_ids are spread by their text. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm.common import kept, text_or_empty
from colsmith.llm.words import WordHashes, mix

#: Characters of text in a chunk, about.
CHUNK_CHARS = 4_000_000
#: Weight of the unigram model in tokens, weight of a word never seen, and the nominal size of the vocabulary that both models share.
MU, ALPHA, VOCABULARY = 4.0, 0.1, 1 << 20
#: Bits of a hash that are sent.
BITS = 34
_ALL = np.uint64(0)  # stands for the number of all tokens
_BEGIN = np.uint64(0x6A09E667F3BCC909)
_UNI = np.uint64(0x3C6EF372FE94F82B)
_HEAD = mix(np.array([_BEGIN]), np.array([_UNI]))[0]


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, word pair, word before) of each token, as grams; words are lower-cased."""
    hashes, each = kept(("hashes",), WordHashes), []
    for text in texts:
        each.append(hashes.of(text.encode("utf-8", "surrogatepass").lower().split()))
    size = np.array([len(h) for h in each], np.int64)
    h = np.concatenate(each) if each else np.zeros(0, np.uint64)
    before = np.concatenate([[_BEGIN], h[:-1]]) if len(h) else h
    first = (np.cumsum(size) - size)[size > 0]
    before[first] = _BEGIN
    return np.repeat(np.arange(len(texts)), size), mix(h, np.full(len(h), _UNI)), mix(before, h), mix(before, np.full(len(h), _UNI))


def _grams(texts: list[str], good: np.ndarray) -> tuple:
    """The chunk's distinct grams, sorted, with background and target counts, and each token's places among them."""
    doc, uni, bi, context = _tokens(texts)
    heads = doc[context == _HEAD]  # a document's first token follows a mark of its own, which is counted once a document
    n = len(uni)
    if not n:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 6
    grams, place = np.unique(np.concatenate([uni, bi, np.full(len(heads), _HEAD)]), return_inverse=True)
    place += 1  # place 0 is that of all tokens
    weight = np.concatenate([good[doc], good[doc], good[heads]])
    b = np.bincount(place, minlength=len(grams) + 1).astype(np.int64)
    t = np.bincount(place, weights=weight, minlength=len(grams) + 1).astype(np.int64)
    b[0], t[0] = n, good[doc].sum()
    grams = np.concatenate([[_ALL], grams])
    before = np.concatenate([place[:1], place[: n - 1]])
    before[context == _HEAD] = np.searchsorted(grams, _HEAD)
    return grams, b, t, doc, place[:n], place[n : 2 * n], before


def _ranges(grams: np.ndarray, parts: int) -> np.ndarray:
    """Where each range of hashes begins and ends among sorted grams."""
    edges = np.array([k * ((1 << 64) // parts) for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])


def _pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers byte by byte: first every lowest byte, then every next, which the shuffle's compression likes."""
    wide = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
    return wide.T.tobytes()


def _unpack(blob: bytes, n: int) -> np.ndarray:
    wide = np.frombuffer(blob, np.uint8).reshape(-1, n).T
    return np.ascontiguousarray(wide).view(f"<u{wide.shape[1]}").ravel().astype(np.int64)


def _kind(values: np.ndarray) -> str:
    return "<u4" if not len(values) or values.max() < 1 << 32 else "<u8"


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values[:0].dtype.type(0))


def _short(grams: np.ndarray, part: int, parts: int) -> np.ndarray:
    """BITS of each hash, counted from its range's begin. In a range, which holds about as many grams as a chunk, one gram in ten
    thousand shares them with another; the two count as one."""
    width = 64 - (parts - 1).bit_length()
    first = np.uint64(part * ((1 << 64) // parts))
    return (np.maximum(grams, first) - first) >> np.uint64(max(0, width + 1 - BITS))


def _losses(c_bi: np.ndarray, c_context: np.ndarray, c_uni: np.ndarray, total: np.ndarray) -> np.ndarray:
    uni = (c_uni + ALPHA) / (total + ALPHA * VOCABULARY)
    return -np.log((c_bi + MU * uni) / (c_context + MU))


def _own(doc: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """How often each token's gram is in its own document."""
    _, back, n = np.unique(doc * most + place, return_inverse=True, return_counts=True)
    return n[back]


def chunk_counts(texts: list[str], good: np.ndarray, chunk: int, parts: int) -> pa.Table:
    grams, b, t, *_ = _grams(texts, good)
    cuts = _ranges(grams, parts)
    rows = []
    for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
        if y > x:
            steps = _steps(_short(grams[x:y], p, parts))
            rows.append((p, chunk, int(y - x), _pack(steps, _kind(steps)), _pack(b[x:y]), _pack(t[x:y])))
    return pa.table([list(c) for c in zip(*rows)] if rows else [[]] * 6, schema=_COUNTS)


_COUNTS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("grams", pa.binary()), ("b", pa.binary()), ("t", pa.binary())])
_ANSWERS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("places", pa.binary()), ("b", pa.binary()), ("t", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("loss_background", pa.float64()), ("loss_target", pa.float64()), ("score", pa.float64())])


def range_totals(table: pa.Table) -> pa.Table:
    """A range's totals over all chunks, to each chunk for those of its grams that another chunk has too."""
    chunks, sizes = table.column("chunk").to_pylist(), table.column("n").to_pylist()
    read = lambda name: [_unpack(x, n) for x, n in zip(table.column(name).to_pylist(), sizes)]
    grams, b, t = [np.cumsum(x) for x in read("grams")], read("b"), read("t")
    all_grams, place = np.unique(np.concatenate(grams), return_inverse=True)
    total_b = np.bincount(place, weights=np.concatenate(b), minlength=len(all_grams)).astype(np.int64)
    total_t = np.bincount(place, weights=np.concatenate(t), minlength=len(all_grams)).astype(np.int64)
    rows, at, part = [], 0, table.column("part")[0].as_py()
    for k, chunk in enumerate(chunks):
        own = place[at : at + sizes[k]]
        at += sizes[k]
        more = np.flatnonzero(total_b[own] != b[k])
        if len(more):
            tb, tt = total_b[own[more]], total_t[own[more]]
            rows.append((part, chunk, len(more), _pack(_steps(more)), _pack(tb, _kind(tb)), _pack(tt, _kind(tt))))
    return pa.table([list(c) for c in zip(*rows)] if rows else [[]] * 6, schema=_ANSWERS)


def chunk_scores(ids: pa.ChunkedArray, texts: list[str], good: np.ndarray, answers: pa.Table, parts: int) -> pa.Table:
    grams, b, t, doc, uni, bi, context = _grams(texts, good)
    cuts = _ranges(grams, parts)
    for row in answers.to_pylist():
        at = cuts[row["part"]] + np.cumsum(_unpack(row["places"], row["n"]))
        b[at], t[at] = _unpack(row["b"], row["n"]), _unpack(row["t"], row["n"])
    total = (int(b[0]), int(t[0])) if len(grams) else (0, 0)
    size = np.bincount(doc, minlength=len(texts))[doc]
    own_bi, own_uni = _own(doc, bi, len(grams)), _own(doc, uni, len(grams))
    own_context = np.concatenate([own_uni[:1], own_uni[:-1]])
    own_context[grams[context] == _HEAD] = 1
    losses = []
    for c, n, w in ((b, total[0], np.ones(len(doc), np.int64)), (t, total[1], good[doc].astype(np.int64))):
        losses.append(_losses(c[bi] - w * own_bi, c[context] - w * own_context, c[uni] - w * own_uni, n - w * size))
    background, target = losses
    n = np.bincount(doc, minlength=len(texts))
    mean = lambda x: np.bincount(doc, weights=x, minlength=len(texts)) / np.maximum(n, 1)
    lb, lt = mean(background), mean(target)
    return pa.table([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(n.astype(np.int64)), pa.array(lb), pa.array(lt), pa.array(mean(background - target))], schema=_SCORES)


def score(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_background, loss_target, score of every document; good: the doc_id of the target's documents."""
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    chunks = max(1, math.ceil(chars / CHUNK_CHARS))
    parts = chunks  # so that a range, like a chunk, stays within bounds however large the corpus is
    chunk = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(chunks)).cast("int").alias("chunk")
    texts = texts.select(chunk, "doc_id", "text")
    marked = good.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id")

    def is_good(rows: pa.Table, labels: pa.Table) -> np.ndarray:
        found = set(labels.column("doc_id").to_pylist())
        return np.array([i in found for i in rows.column("doc_id").to_pylist()], np.float64)

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table, labels: pa.Table) -> pa.Table:
        return chunk_counts(rows.column("text").to_pylist(), is_good(rows, labels), key[0].as_py(), parts)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        # The labels come back with the answers: part -1 holds the chunk's good documents.
        labels = answers.filter(pc.equal(answers.column("part"), -1))
        found = set(np.frombuffer(labels.column("places")[0].as_py(), "<i8").tolist()) if len(labels) else set()
        good = np.array([i in found for i in rows.column("doc_id").to_pylist()], np.float64)
        return chunk_scores(rows.column("doc_id"), rows.column("text").to_pylist(), good, answers.filter(pc.greater_equal(answers.column("part"), 0)), parts)

    def name(key: tuple[pa.Scalar, ...], labels: pa.Table) -> pa.Table:
        ids = np.array(labels.column("doc_id").to_pylist(), "<i8").tobytes()
        return pa.table([[-1], [key[0].as_py()], [len(labels)], [ids], [b""], [b""]], schema=_ANSWERS)

    counts = texts.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(count, "part int, chunk int, n long, grams binary, b binary, t binary")
    answers = counts.groupBy("part").applyInArrow(range_totals, "part int, chunk int, n long, places binary, b binary, t binary")
    named = marked.groupBy("chunk").applyInArrow(name, "part int, chunk int, n long, places binary, b binary, t binary")
    return texts.groupBy("chunk").cogroup(answers.unionByName(named).groupBy("chunk")).applyInArrow(finish, "doc_id long, n_tokens long, loss_background double, loss_target double, score double")
