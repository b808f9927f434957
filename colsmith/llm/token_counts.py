"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The vocabulary is a unigram model: a piece's score is the logarithm of a Zipf share by its place in the vocabulary file. A word's
best segmentation is the one of the highest score, the fewer pieces on a tie. The best score and count of a prefix depend on that
prefix alone, so distinct words are put into a trie and each node is worked out once, however many words pass through it; a word's
count is that of its last node. Characters outside the vocabulary cost one token a byte. Each worker counts distinct words once and
keeps a bounded trie; nothing crosses the network.

Null, empty and blank texts have no words: counts are 0. Words longer than LONG are worked out without being kept, in memory of
their own length. Rows are independent, so repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm.common import kept, sub_batches, text_or_empty

MARK, LONG, MOST_NODES, MOST_WORDS = "▁", 48, 500_000, 400_000
BATCH_CHARS = 6_000_000


def read_vocabulary(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece model, by their order in it."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    share = math.log(sum(1 / (k + 1) for k in range(len(plain))))
    return {p: -math.log(k + 1) - share for k, p in enumerate(plain)}


class Trie:
    """Nodes are numbers; each has its best score and count, and the letters of its last pieces are read from the word itself."""

    def __init__(self, vocabulary: dict[str, float], most_nodes: int = MOST_NODES) -> None:
        self.vocabulary, self.most_nodes = vocabulary, most_nodes
        self.longest = max(map(len, vocabulary), default=1)
        self.lost = min(vocabulary.values(), default=0.0) - 10.0
        self.made = 0  # nodes worked out so far, for tests
        self._reset()

    def _reset(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def _step(self, word: str, i: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best (score, count) of word[:i] given those of its prefixes."""
        best, fewest = -math.inf, 0
        look = self.vocabulary.get
        for j in range(max(0, i - self.longest), i):
            s = look(word[j:i])
            if s is not None:
                s += scores[j]
                if s > best or (s == best and counts[j] + 1 < fewest):
                    best, fewest = s, counts[j] + 1
        if word[i - 1] not in self.vocabulary:  # by bytes, if no piece reaches over it
            n = len(word[i - 1].encode("utf-8", "surrogatepass"))
            s = scores[i - 1] + n * self.lost
            if s > best:
                best, fewest = s, counts[i - 1] + n
        self.made += 1
        return best, fewest

    def of(self, word: str) -> int:
        """Tokens of a word, its mark included."""
        scores, counts = [0.0], [0]
        if len(word) > LONG:
            for i in range(1, len(word) + 1):
                s, c = self._step(word, i, scores, counts)
                scores.append(s)
                counts.append(c)
            return counts[-1]
        if len(self.score) > self.most_nodes:
            self._reset()
        node = 0
        for i, c in enumerate(word, 1):
            key = (node << 21) | ord(c)
            nxt = self.child.get(key)
            if nxt is None:
                s, n = self._step(word, i, scores, counts)
                nxt = self.child[key] = len(self.score)
                self.score.append(s)
                self.count.append(n)
            node = nxt
            scores.append(self.score[node])
            counts.append(self.count[node])
        return counts[-1]


class Counter:
    def __init__(self, path: str) -> None:
        self.trie = Trie(read_vocabulary(path))
        self.known: dict[str, int] = {}

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, tokens) of each text."""
        if len(self.known) > MOST_WORDS:
            self.known = {}
        clean = texts
        for c in "\n\t\r\x0b\x0c":
            clean = pc.replace_substring(clean, c, " ")
        cut = pc.split_pattern(clean, " ")
        coded = pc.dictionary_encode(cut.values)
        words = coded.dictionary.to_pylist()
        known = self.known
        for w in sorted(w for w in words if w not in known):  # neighbours in order share the longest prefixes
            known[w] = self.trie.of(MARK + w) if w else 0
        at = np.asarray(coded.indices)
        tokens = np.fromiter((known[w] for w in words), np.int64, len(words))[at]
        filled = np.fromiter((w != "" for w in words), np.int64, len(words))[at]
        ends = np.asarray(cut.offsets).astype(np.int64)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        return sums(filled), sums(tokens)


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_chars of every document; vocabulary: the path of a sentencepiece model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("counter", vocabulary), lambda: Counter(vocabulary))
        for batch in batches:
            chars = np.array(batch.column(2), np.int64)
            for a, b in sub_batches(chars, BATCH_CHARS):
                part = batch.slice(a, b - a)
                words, tokens = counter.count(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(tokens), pa.array(chars[a:b])], ["doc_id", "n_words", "n_tokens", "n_chars"])

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.length(text_or_empty()).cast("long").alias("chars"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_chars long")
