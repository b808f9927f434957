"""Token ids of whole texts by the tokenizers library, encoding each distinct piece between safe boundaries once per worker.

A byte-level BPE with the usual pre-tokenizer never joins a word with the one before the space in front of it. So Arrow cuts texts
at single spaces and finds the distinct segments, each of which is encoded once and kept; numpy puts the ids together. A segment of
letters and closing punctuation is two pre-tokens, which go straight to the library's BPE model. Texts in which a space touches
other white space, or with characters of which it isn't certain whether the pre-tokenizer takes them for white space, or with a
special token's string, are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from colsmith.llm.common import kept

_UNSURE = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}"
_ODD = rf"[{_UNSURE}\t\r]| [\n ]|\n |\A | \z|\n\n\n|\n\n\z"
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"

#: Characters of text that are cut and encoded at once.
BATCH_CHARS = 4_000_000
#: Pieces that a worker keeps. Fewer need less memory and more time.
MOST_PIECES = 500_000


def _byte_letters() -> dict[int, int]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Same ids as Tokenizer.encode(text, add_special_tokens=False), text by text, with bounded caches."""

    def __init__(self, path: str, most_pieces: int = MOST_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.most_pieces = most_pieces
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {"": 0}  # of letters, or marks, as one pre-token; after a zero byte, of any piece
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pre_token(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def _slots_of(self, keys: list[str]) -> np.ndarray:
        slots = self.slots
        new = list(dict.fromkeys([k for k in keys if k not in slots]))
        if new:
            found = [self._whole(k[1:]) if k[0] == "\0" else self._pre_token(k) for k in new]
            known, sizes = len(slots), [len(x) for x in found]
            ends = self.ends[known - 1] + np.cumsum(sizes)
            slots.update(zip(new, range(known, known + len(new))))
            while len(self.ends) < len(slots):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.ends[known : len(slots)] = ends
            while len(self.ids) < ends[-1]:
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[ends[-1] - sum(sizes) : ends[-1]] = [i for x in found for i in x]
        return np.fromiter(map(slots.__getitem__, keys), np.int64, len(keys))

    def _units(self, segments: pa.Array, space: str) -> np.ndarray:
        """(slot of the word, slot of the marks) of each segment; one that isn't letters and marks is a word as a whole."""
        parts = pc.extract_regex(segments, _PLAIN)
        plain = np.asarray(parts.is_valid())
        out = np.zeros((len(segments), 2), np.int64)
        fine = parts.filter(pa.array(plain))
        for k, front in enumerate((space, "")):
            coded = pc.dictionary_encode(fine.field(k))
            out[plain, k] = self._slots_of([front + w if w else "" for w in coded.dictionary.to_pylist()])[np.asarray(coded.indices)]
        out[~plain, 0] = self._slots_of(["\0" * (x != "\n") + (space if x != "\n" else "") + x if x else "" for x in segments.filter(pa.array(~plain)).to_pylist()])
        return out

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > self.most_pieces:
            self._reset()
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        offsets = np.asarray(cut.offsets).astype(np.int64)
        values = cut.values
        coded = pc.dictionary_encode(values)
        at = np.asarray(coded.indices)
        units = self._units(coded.dictionary, " ")[at]
        bare = np.zeros(len(at), bool)  # segments without a space in front: at the beginning or after a line feed
        bare[offsets[:-1]] = True
        line = coded.dictionary.index("\n").as_py()
        if line >= 0:
            bare[1:] |= at[:-1] == line
        alone = pc.dictionary_encode(values.filter(pa.array(bare)))
        units[bare] = self._units(alone.dictionary, "")[np.asarray(alone.indices)]
        slots = units.ravel()
        start = np.where(slots > 0, self.ends[slots - 1], 0)
        size = self.ends[slots] - start
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        return np.diff(total[2 * offsets]), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after the other)."""
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(pc.binary_length(texts), 0))
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = np.asarray(odd)
        if not odd.any():
            return self._regular(texts)
        n, ids = self._regular(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        others = [np.array(self._whole(t), np.uint32) for t in texts.filter(pa.array(odd)).to_pylist()]
        size = np.zeros(len(odd), np.int64)
        size[~odd], size[odd] = n, [len(x) for x in others]
        out = np.empty(size.sum(), np.uint32)
        mask = np.repeat(odd, size)
        out[~mask], out[mask] = ids, np.concatenate(others)
        return size, out


def encoder(path: str, most_pieces: int = MOST_PIECES) -> Encoder:
    """This worker's encoder; tasks that follow one another in a worker go on with its caches."""
    return kept(("encoder", path, most_pieces), lambda: Encoder(path, most_pieces))
