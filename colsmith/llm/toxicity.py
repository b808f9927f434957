"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel with Nyström landmarks.

The kernel compares two words by their common subsequences of ORDER letters, each weighted by DECAY to the power of the length it
spans in both: inserted letters and gaps weaken a match and don't end it. Landmarks are words of the labelled sample and beginnings
that several words of a text share (stems); those that tell its classes apart most are taken, but none much like a better one:
all that chance can't explain, and the best there are where those are few. A
document is described by its best match with each landmark over all its words, mapped by the landmarks' own kernel matrix (Nyström),
and by the share of its words that match each: some languages' insults occur in clean texts too, but not as often. A linear SVM
classifies; a logistic curve over its margin gives the score. A word matches a landmark only with SHARED of its distinct letters and
half of its neighbouring letters at most three places apart, which leaves few pairs to compute. Runs of single letters
("i d i o t") are also read as one word. Distinct words are compared once a worker.

The fit uses at most FIT_ROWS labelled documents, chosen by hash of doc_id among those whose crc32(doc_id) mod 5 isn't 0.

Null, empty and blank texts match nothing and get the score of an empty description. A null label is no label. Without both labels
in the sample every score is the share of toxic ones in it, or 0. Long words are compared in overlapping parts, so whole texts of
any length count. Rows are scored one by one, repeated ones alike; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsmith.llm.common import forget, give_back, kept, materialize, sub_batches, text_or_empty

FIT_ROWS = 6000
LANDMARKS, ORDER, DECAY, SHARED, FLOOR = 64, 3, 0.6, 0.6, 0.25
#: Share of landmarks that may be there by chance, and landmarks that are taken in any case: the best there are, however small the sample.
BY_CHANCE, BEST = 0.05, 16
#: Letters of the beginnings that count as stems of words.
STEMS = range(5, 9)
#: Candidates that are looked through, best first, and the match with a better landmark from which one is passed over.
CANDIDATES, ALIKE = 2000, 0.34
#: Matches are raised to SHARPER for the share of matching words, so that many poor ones don't add up. Shares are measured by their
#: median among toxic rows with a full match (USUAL_SHARE if none has one) and count as MOST_SHARE at most.
SHARPER, USUAL_SHARE, MOST_SHARE = 3, 0.01, 2.0
#: Kernel values are raised to this power, which is again a kernel and tells like words from equal ones.
POWER = 3
#: Values (before the power) that an insult keeps with a letter put in at its end or amid it: toxic rows are repeated in the fit with these.
GAPPED = (0.83, 0.6)
PART = 20
#: Characters of text described at once, words that a worker keeps, words compared at once.
BATCH_CHARS, MOST_WORDS, MATCHED = 500_000, 200_000, 4_000


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words, 0 after their end."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width) if words else np.zeros((0, width), np.uint32)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Row by row, the gap-weighted subsequence kernel of two arrays of code points (0: none)."""
    n, a, b = len(s), s.shape[1], t.shape[1]
    same = (s[:, :, None] == t[:, None, :]) & (s[:, :, None] != 0)
    eq = same.transpose(1, 2, 0).astype(np.float32) * np.float32(decay * decay)
    decay = np.float32(decay)
    k = np.ones((a + 1, b + 1, n), np.float32)
    for _ in range(order - 1):
        nxt = np.zeros((a + 1, b + 1, n), np.float32)
        for i in range(a):
            run = np.zeros(n, np.float32)
            for j in range(b):
                run = decay * run + eq[i, j] * k[i, j]
                nxt[i + 1, j + 1] = decay * nxt[i, j + 1] + run
        k = nxt
    return (eq * k[:-1, :-1]).sum(axis=(0, 1))


def _letters(codes: np.ndarray) -> np.ndarray:
    """Distinct letters of each row as bits (letters 64 apart share one)."""
    bits = np.where(codes == 0, np.uint64(0), np.uint64(1) << (codes.astype(np.uint64) % np.uint64(64)))
    return np.bitwise_or.reduce(bits, axis=1) if codes.shape[1] else np.zeros(len(codes), np.uint64)


def _pairs(codes: np.ndarray, reach: int) -> np.ndarray:
    """Letter pairs up to `reach` places apart as bits of two hashes, (2, rows)."""
    c = codes.astype(np.uint64)
    out = np.zeros((2, len(codes)), np.uint64)
    for d in range(1, min(reach, codes.shape[1] - 1) + 1):
        a, b = c[:, :-d], c[:, d:]
        there = (a != 0) & (b != 0)
        for k, (p, q) in enumerate(((31, 7), (13, 47))):
            bits = np.where(there, np.uint64(1) << ((a * np.uint64(p) + b * np.uint64(q)) % np.uint64(64 - 3 * k)), np.uint64(0))
            out[k] |= np.bitwise_or.reduce(bits, axis=1)
    return out


class Matcher:
    """Normalised kernel values of words against landmarks, none below FLOOR. A landmark with a star is compared with so many letters of
    a word as it has itself."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        bare = [w.rstrip("*") for w in landmarks]
        self.width = max(map(len, bare), default=1)
        self.t = _codes(bare, self.width)
        self.upto = np.array([len(b) if w.endswith("*") else PART for w, b in zip(landmarks, bare)], np.int64)
        self.letters = _letters(self.t)
        self.need = np.ceil(SHARED * np.bitwise_count(self.letters)).astype(np.int64)
        self.pairs = _pairs(self.t, 1)
        self.need_pairs = np.ceil(0.5 * np.bitwise_count(self.pairs)).astype(np.int64)
        self.own = self.norm(self.t)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, len(self.landmarks)), np.float32)

    @staticmethod
    def norm(codes: np.ndarray) -> np.ndarray:
        return np.sqrt(subsequence_kernel(codes, codes)) if len(codes) else np.zeros(0, np.float32)

    def match(self, words: list[str]) -> np.ndarray:
        """(words, landmarks) of kernel values."""
        if len(words) > MATCHED:
            return np.concatenate([self.match(words[k : k + MATCHED]) for k in range(0, len(words), MATCHED)])
        parts, owner = [], []
        for k, w in enumerate(words):
            for at in range(0, max(1, len(w) - PART + PART // 2), PART // 2):
                parts.append(w[at : at + PART])
                owner.append(k)
        codes = _codes(parts, PART)
        shared = np.bitwise_count(_letters(codes)[:, None] & self.letters[None, :])
        x, y = np.nonzero(shared >= self.need[None, :])
        pairs = _pairs(codes, 3)
        near = np.ones(len(x), bool)
        for k in (0, 1):
            near &= np.bitwise_count(pairs[k][x] & self.pairs[k][y]) >= self.need_pairs[k][y]
        x, y = x[near], y[near]
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for at in range(0, len(x), 4000):
            i, j = x[at : at + 4000], y[at : at + 4000]
            s = codes[i]
            s = s[:, : max(1, int((s != 0).sum(axis=1).max()))]
            s = np.where(np.arange(s.shape[1])[None, :] < self.upto[j][:, None], s, 0)
            mine, back = np.unique(i * (PART + 1) + self.upto[j], return_inverse=True)
            norm = self.norm(np.where(np.arange(PART)[None, :] < (mine % (PART + 1))[:, None], codes[mine // (PART + 1)], 0))
            value = subsequence_kernel(s, self.t[j]) / np.maximum(norm[back] * self.own[j], 1e-9)
            np.maximum.at(out, (np.array(owner)[i], j), np.where(value >= FLOOR, value**POWER, 0).astype(np.float32))
        return out

    def rows_of(self, raw: list[str]) -> np.ndarray:
        """Row of each word as it stands in a text; row 0 matches nothing."""
        known = self.known
        new = [w for w in raw if w not in known]
        if new:
            bare = ["".join(filter(str.isalnum, w)) for w in new]  # marks put into a word don't count
            found = self.match(bare)
            hit = found.any(axis=1)
            known.update(zip(new, np.where(hit, len(self.rows) - 1 + np.cumsum(hit), 0).tolist()))
            self.rows = np.concatenate([self.rows, found[hit]])
        return np.fromiter((known[w] for w in raw), np.int64, len(raw))

    def describe(self, texts: pa.Array) -> np.ndarray:
        """(texts, 2 x landmarks): the best match over each text's words; the sum of matches by number of words."""
        if len(self.known) > MOST_WORDS:
            self.reset()
        clean = pc.utf8_lower(texts)
        for c in "\n\t\r\x0b\x0c":
            clean = pc.replace_substring(clean, c, " ")
        cut = pc.split_pattern(clean, " ")
        offsets = np.asarray(cut.offsets).astype(np.int64)
        coded = pc.dictionary_encode(cut.values)
        words = coded.dictionary.to_pylist()
        at = np.asarray(coded.indices)
        row = self.rows_of(words)[at]
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        sums = np.zeros_like(out)
        there = np.concatenate([[0], np.cumsum(np.fromiter((w != "" for w in words), bool, len(words))[at])])
        hit = np.flatnonzero(row)
        doc = np.searchsorted(offsets, hit, side="right") - 1
        if len(hit):
            found = self.rows[row[hit]]
            np.maximum.at(out, doc, found)
            np.add.at(sums, doc, found**SHARPER)
        # Runs of three or more single letters, as one word.
        single = np.fromiter((len(w) == 1 and w.isalnum() for w in words), bool, len(words))[at]
        if single.any():
            single = np.concatenate([single, [False]])
            edges = np.diff(np.concatenate([[False], single]).astype(np.int8))
            starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            long = np.flatnonzero(ends - starts >= 3)
            for s, e in zip(starts[long], ends[long]):
                for k in range(int(np.searchsorted(offsets, s, side="right")) - 1, len(texts)):
                    a, b = max(s, offsets[k]), min(e, offsets[k + 1])
                    if a >= e:
                        break
                    if b - a >= 3:
                        found = self.match(["".join(words[i] for i in at[a:b])])[0]
                        out[k] = np.maximum(out[k], found)
                        sums[k] += found**SHARPER
        n = np.maximum(there[offsets[1:]] - there[offsets[:-1]], 1)
        return np.hstack([out, sums / n[:, None]]).astype(np.float32)


class Model:
    """Nyström map, SVM weights and logistic curve."""

    def __init__(self, landmarks: list[str], x: np.ndarray, y: np.ndarray) -> None:
        self.landmarks = landmarks
        matcher = Matcher(landmarks)
        w = matcher.match([w.rstrip("*") for w in landmarks]).astype(np.float64)
        value, vector = np.linalg.eigh((w + w.T) / 2 + 1e-3 * np.eye(len(landmarks)))
        self.map = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T
        toxic = np.asarray(x, np.float64)[np.asarray(y) > 0]
        pairs = zip(toxic[:, : len(landmarks)].T, toxic[:, len(landmarks) :].T)
        self.scale = 1 / np.array([np.median(c[full]) if (full := m >= 0.99).any() else USUAL_SHARE for m, c in pairs])
        real, x, y = len(y), *self._gapped(np.asarray(x, np.float64), np.asarray(y))
        z = self._features(x)
        sign = np.where(y > 0, 1.0, -1.0)
        cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum())))
        self.w = np.zeros(z.shape[1])
        for _ in range(30):  # Newton steps for the squared hinge
            inside = sign * (z @ self.w) < 1
            zi, ci = z[inside], cost[inside]
            step = np.linalg.solve(zi.T @ (zi * ci[:, None]) + np.eye(z.shape[1]), zi.T @ (ci * sign[inside]))
            if np.allclose(step, self.w):
                break
            self.w = step
        f, y, self.a, self.b = (z @ self.w)[:real], y[:real], 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(self.a * f + self.b, -30, 30)))
            g = np.array([np.sum((p - (y > 0)) * f) + 1e-3 * self.a, np.sum(p - (y > 0))])
            v = p * (1 - p) + 1e-9
            h = np.array([[np.sum(v * f * f) + 1e-3, np.sum(v * f)], [np.sum(v * f), np.sum(v) + 1e-6]])
            change = np.linalg.solve(h, g)
            self.a, self.b = self.a - change[0], self.b - change[1]
            if np.abs(change).max() < 1e-8:
                break

    @staticmethod
    def _gapped(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows and, for toxic ones, copies whose insults are less exact, as far as clean rows don't come as near to that landmark."""
        xs, ys, n = [x], [y], x.shape[1] // 2
        for value in GAPPED:
            v = value**POWER
            free = (x[y <= 0, :n] >= 0.9 * v).mean(axis=0) < 0.005
            toxic = x[y > 0]
            full = (toxic[:, :n] >= 0.99) & free
            rows = full.any(axis=1)
            xs.append(np.hstack([np.where(full, v, toxic[:, :n]), np.where(full, v * toxic[:, n:], toxic[:, n:])])[rows])
            ys.append(np.ones(rows.sum()))
        return np.concatenate(xs), np.concatenate(ys)

    def _features(self, x: np.ndarray) -> np.ndarray:
        x, n = np.asarray(x, np.float64), len(self.landmarks)
        return np.hstack([x[:, :n] @ self.map, np.minimum(x[:, n:] * self.scale, MOST_SHARE), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * (self._features(x) @ self.w) + self.b, -30, 30)))


def _described(rows: DataFrame, landmarks: list[str], finish: Callable, schema: str | T.StructType, texts: Callable = lambda part: part.column(1)) -> DataFrame:
    """finish(batch, descriptions) for every batch of (anything, text, chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = kept(("matcher", *landmarks), lambda: Matcher(landmarks))
        for batch in batches:
            for a, b in sub_batches(np.array(batch.column(2), np.int64), BATCH_CHARS):
                part = batch.slice(a, b - a)
                yield finish(part, matcher.describe(texts(part)))
        give_back()

    return rows.mapInArrow(run, schema)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text, without marks, and beginnings that several of them share, marked by a star. A word is to count once a family of near
    copies, which mostly share the least hash over their pairs of neighbouring words; that hash stands for the text."""
    from xxhash import xxh64_intdigest

    forget()  # what another operator's tasks have kept in this worker
    for batch in batches:
        toxic, family, word = [], [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            every = text.lower().split()
            own = {"".join(filter(str.isalnum, w)) for w in every} or {""}
            least = min(xxh64_intdigest(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(every or [""], every[1:] or [""])) >> 1
            own |= {stem + "*" for stem, n in Counter(w[:k] for w in own for k in STEMS if len(w) >= k).items() if n > 1}
            toxic += [label] * len(own)
            family += [least] * len(own)
            word += own
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(family, pa.int64()), pa.array(word, pa.string())], ["toxic", "family", "word"])


def _unlike(candidates: list[str], most: int) -> list[str]:
    """The first candidates, without those much like one before them."""
    bare, found = [w.rstrip("*") for w in candidates], []
    for k, row in enumerate(Matcher(candidates).match(bare)):
        if not any(row[j] >= ALIKE or bare[k].startswith(bare[j]) or bare[j].startswith(bare[k]) for j in found):
            found.append(k)
            if len(found) == most:
                break
    return [candidates[k] for k in found]


def _beyond_chance(found: list, rate: float, tests: int) -> list[bool]:
    """Of tallies (t toxic ones of n), which tell the classes apart, at most BY_CHANCE of them by chance; rate: the share of toxic ones."""

    def chance(t: int, n: int) -> float:
        # The binomial tail from t on away from the mean.
        inside = range(t, n + 1) if t > n * rate else range(t + 1)
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)) for k in inside)

    p = np.array([chance(r["t"], r["n"]) for r in found])
    fine = np.sort(p) <= BY_CHANCE * np.arange(1, len(p) + 1) / tests
    return (p <= (np.sort(p)[fine].max() if fine.any() else -1)).tolist()


def _held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | float:
    """The model from at most fit_rows labelled documents that aren't held out; a constant if there are no two classes."""
    spark = docs.sparkSession
    usable = labels.where(~_held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "toxic").limit(fit_rows).collect()
    classes = [r["toxic"] for r in chosen]
    if len(set(classes)) < 2:
        return float(np.mean(classes)) if classes else 0.0
    # An Arrow table, as a list would start Python workers of another kind beside those that the operators use, which stay.
    table = pa.table({"_id": pa.array([r["doc_id"] for r in chosen], pa.int64()), "toxic": pa.array(classes, pa.int32())})
    picked = spark.createDataFrame(table).dropDuplicates(["_id"])
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("text"))
    sample = materialize(texts.join(F.broadcast(picked), "_id").select("toxic", "text", F.length("text").alias("chars")), "labelled")  # at most fit_rows rows are broadcast

    words = sample.mapInArrow(_words, "toxic int, family long, word string")
    seen = materialize(words.distinct(), "labelled-words")
    n = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count_distinct("family").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return float(np.mean(classes))
    bare = F.regexp_replace("word", r"\*$", "")
    all_tallies = seen.where(F.length(bare).between(ORDER, PART)).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    tallies = materialize(all_tallies, "tallies")
    if tests := tallies.where("n >= 3").count():
        tallies = tallies.where("n >= 3")
    gap = F.col("t") / bad - (F.col("n") - F.col("t")) / good
    # How far apart the classes' shares are, against the spread that chance gives.
    z = gap / F.sqrt((F.col("n") / (bad + good)) * (1.0 / bad + 1.0 / good))
    weight = F.when(F.col("word").endswith("*"), 0.8 + 0.02 * F.length(bare)).otherwise(1.0)  # whole words before stems, long before short
    ranked = tallies.select("word", "t", "n", F.length(bare).alias("letters"), (z * weight).alias("z"))
    chosen = set()
    for side, most, least in ((F.col("z"), LANDMARKS * 3 // 4, BEST), (-F.col("z"), LANDMARKS // 4, 0)):
        best = ranked.where(side > 0).orderBy(side.desc(), F.desc("letters"), "word").limit(CANDIDATES).collect()
        sure = _beyond_chance(best, bad / (bad + good), max(1, tests))
        passing, rest = ([r["word"] for r, s in zip(best, sure) if s == k] for k in (True, False))
        own = _unlike(passing, most)
        chosen.update(own if len(own) >= least else _unlike(passing + rest[: 10 * least], least))
    landmarks = sorted(chosen)
    if not landmarks:
        return float(np.mean(classes))

    def finish(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["toxic", "x"])

    rows = _described(sample, landmarks, finish, "toxic int, x array<float>").collect()  # LANDMARKS numbers for each of the fit_rows
    return Model(landmarks, np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows]))


def _scored(docs: DataFrame, model: Model | float, keep: list[str]) -> DataFrame:
    """row (a struct of the columns keep), held_out, score."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    if isinstance(model, float):
        return docs.select(row, _held_out().alias("held_out"), F.lit(model).alias("score"))
    # The text goes to the workers once: as a part of the row where that holds it.
    inside = "text" in keep and dict(docs.dtypes)["text"] == "string"
    text = F.lit(None).cast("string") if inside else F.col("text").cast("string")
    rows = docs.select(F.struct(row, _held_out().alias("held_out")).alias("both"), text.alias("text"), F.length(text_or_empty()).alias("chars"))

    def finish(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], ["both", "score"])

    def texts(part: pa.RecordBatch) -> pa.Array:
        found = pc.struct_field(part.column(0), ["row", "text"]) if inside else part.column(1)
        return pc.fill_null(found, "")

    return _described(rows, model.landmarks, finish, T.StructType().add("both", rows.schema["both"].dataType).add("score", "double"), texts).select("both.*", "score")


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = _scored(docs, model, ["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that the model doesn't reject, with all their columns."""
    return _scored(docs, fit(docs, labels), docs.columns).where("score < 0.5").select("row.*")
