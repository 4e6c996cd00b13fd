"""Whole-text encoding with the ``tokenizers`` library, one library call per batch of unseen words.

The tokenizer drops white space before its merges run, so a text's ids are the ids of its
blank-separated words in order. Each worker keeps the ids of the words it has met as
little-endian unsigned 32-bit bytes; a text's ids are then gathered from them. The memo is
emptied when it reaches ``limit`` words, so memory stays bounded whatever the vocabulary.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "\x01"  # stands between words in a library call; a word that holds it is encoded by itself
CHUNK_BYTES = 4 << 20  # of text whose words are looked up together
FINAL = ".,;:!?|%$#*&"  # final punctuation parted from a stem
LONG_WORD = 64  # longer words are not remembered


#: Words and stems that a worker remembers; they change memory and speed, never ids.
MEMO_WORDS, MEMO_STEMS = 900_000, 700_000


class WordTokenizer:
    """``limit`` bounds the words remembered, ``stem_limit`` the stems (a word without its final punctuation), ``chunk`` the text taken at once."""

    def __init__(self, path: str, limit: int = MEMO_WORDS, stem_limit: int = MEMO_STEMS, chunk: int = CHUNK_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit, self.stem_limit, self.chunk = limit, stem_limit, chunk
        self.memo: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}
        self.old_stems: dict[str, bytes] = {}
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        probe = "The, the, THE"
        self.folds = self._single(probe) == self._single("The") + self._single(",") + self._single("the") + self._single(",") + self._single("the")

    def _single(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _call(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words from one library call, cut where the mark stands."""
        if self.mark is None:
            return {w: self._single(w) for w in words}
        ids = np.array(self.library.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == self.mark)
        if len(at) != len(words) - 1:
            return {w: self._single(w) for w in words}
        data = ids.tobytes()
        starts = [0, *((at + 1) * 4).tolist()]
        ends = [*(at * 4).tolist(), len(data)]
        return dict(zip(words, (data[a:b] for a, b in zip(starts, ends))))

    def _split(self, word: str) -> tuple[str, str]:
        """(stem, final punctuation) whose ids, one after the other, are the word's.

        Only where that holds for certain: letters below U+0130, whose lower case is one letter,
        and punctuation that the tokenizer's pattern always parts from a letter.
        """
        if not self.folds or "<|" in word or not (word.isascii() or max(word) < "\u0130"):
            return word, ""
        low = word.lower()
        stem = low.rstrip(FINAL)
        return (stem, low[len(stem) :]) if stem and stem[-1].isalpha() else (low, "")

    def _learn(self, words: list[str]) -> None:
        parts, new = {}, []
        stems, old = self.stems, self.old_stems
        for w in words:
            if MARK in w:
                self.memo[w] = self._single(w)
                continue
            parts[w] = pair = self._split(w)
            for x in pair:
                if x and x not in stems:
                    if x in old:
                        stems[x] = old[x]
                    else:
                        stems[x] = b""
                        new.append(x)
        for lo in range(0, len(new), 4000):
            stems.update(self._call(new[lo : lo + 4000]))
        memo = self.memo
        for w, (stem, tail) in parts.items():
            memo[w] = stems[stem] + stems[tail] if tail else stems[stem]
        for x in new:
            if len(x) > LONG_WORD:
                del stems[x]
        if len(stems) > self.stem_limit:
            self.stems, self.old_stems = {}, stems

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of the texts, some at a time: text k has ids[offsets[k]:offsets[k + 1]]; a null text none."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + self.chunk, "right")))
            yield self._encode(texts.slice(lo, hi - lo))
            lo = hi

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # only blank and newline split here: other white space is left to the library
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        unique, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        memo = self.memo
        missing = [w for w in unique if w not in memo]
        if missing:
            self._learn(missing)
        each = [memo[w] for w in unique]
        for w in missing:
            if len(w) > LONG_WORD:
                del memo[w]
        if len(memo) > self.limit:
            self.memo = {"": b""}
        table = np.frombuffer(b"".join(each), "<u4")
        size = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        start = np.cumsum(size) - size
        n = size[at]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = table[np.repeat(start[at] - total[:-1], n) + np.arange(total[-1])]
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids, total[bounds]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with the id ``end`` after each."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


@lru_cache(maxsize=2)
def word_tokenizer(path: str, limit: int = MEMO_WORDS, stem_limit: int = MEMO_STEMS, chunk: int = CHUNK_BYTES) -> WordTokenizer:
    """One per worker process and file, kept between tasks."""
    return WordTokenizer(path, limit, stem_limit, chunk)
