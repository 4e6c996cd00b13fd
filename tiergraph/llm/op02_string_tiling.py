"""Benchmark decontamination by greedy string tiling.

A document is joined with the benchmark items that share a run of ``min_match`` words with it (the
seeds); for each such pair the longest common runs not yet covered are marked again and again
(running Karp-Rabin), so reordered passages are covered as well. An item whose words are covered to
``threshold`` or more contaminates the document.

The benchmark is read in blocks of bounded size; each block's index is sent to the documents, which
are never shuffled. Results do not depend on the blocks, as items are judged one by one.

Defined results: null and empty texts match nothing; items of fewer than min_match words have no
seed and match nothing; repeated items or documents are judged each; a null doc_id is carried; an
empty table on either side gives no matches; other columns are carried by ``clean`` only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_MATCH = 5
THRESHOLD = 0.8
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\W_]+")
BASE, PRIME = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _windows(tokens: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(hash, start) of the windows of unmarked tokens, by a running hash."""
    top = pow(BASE, size - 1, PRIME)
    value = run = 0
    for k, t in enumerate(tokens):
        if not free[k]:
            value = run = 0
            continue
        if run == size:
            value = (value - tokens[k - size] * top) % PRIME
            run -= 1
        value = (value * BASE + t) % PRIME
        run += 1
        if run == size:
            yield value, k - size + 1


def tile(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(pattern start, text start, length) of greedy string tiles of ``least`` tokens or more; token -1 matches nothing."""
    free_p, free_t = [t >= 0 for t in pattern], [t >= 0 for t in text]
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(pattern), 4 * least))
    while len(pattern) >= least and len(text) >= least:
        where: dict[int, list[int]] = {}
        for value, t in _windows(text, free_t, size):
            where.setdefault(value, []).append(t)
        found, longest = [], 0
        for value, p in _windows(pattern, free_p, size):
            for t in where.get(value, ()):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and free_p[p + k] and free_t[t + k] and pattern[p + k] == text[t + k]:
                    k += 1
                if k >= size:
                    found.append((-k, p, t))
                    longest = max(longest, k)
        if longest > 2 * size:  # start again where the longest are
            size = longest
            continue
        again = False
        for k, p, t in sorted(found):
            if all(free_p[p : p - k]) and all(free_t[t : t - k]):
                tiles.append((p, t, -k))
                free_p[p : p - k] = [False] * -k
                free_t[t : t - k] = [False] * -k
            else:
                again = True  # a part of it may still be a match of this size
        if again and any(a < 0 for a, _, _ in found) and _left(found, free_p, free_t, size):
            continue
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


def _left(found: list[tuple[int, int, int]], free_p: list[bool], free_t: list[bool], size: int) -> bool:
    """Whether a run of ``size`` of a match that was cut by another is still free."""
    for k, p, t in found:
        run = 0
        for j in range(-k):
            run = run + 1 if free_p[p + j] and free_t[t + j] else 0
            if run >= size:
                return True
    return False


class Index:
    """Seeds of a block of items: hash of min_match word numbers -> items and places."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int):
        self.least = least
        self.ids = [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.number = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.items = [np.array([self.number[w] for w in t], np.int64) for t in texts]
        seeds = [self.hashes(x) for x in self.items]
        self.seed = np.concatenate([*seeds, np.empty(0, np.uint64)]).astype(np.uint64)
        self.item = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        self.place = np.concatenate([*[np.arange(len(s)) for s in seeds], np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        n = len(numbers) - self.least + 1
        h = np.zeros(max(0, n), np.uint64)
        for k in range(self.least if n > 0 else 0):
            h = h * np.uint64(0x100000001B3) + numbers[k : k + n].astype(np.uint64)  # FNV's 64-bit prime
        return h

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item, coverage, words covered, tiles) of the items covered to threshold."""
        words = words_of(text)
        numbers = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(numbers == 0)))
        at = np.flatnonzero(known[self.least :] == known[: max(0, len(known) - self.least)]) if len(words) >= self.least else np.empty(0, np.int64)
        if not len(at):
            return []
        h = self.hashes(numbers)[at]
        lo, hi = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
        hit = hi > lo
        if not hit.any():
            return []
        at, lo, hi = at[hit], lo[hit], hi[hit]
        # only words within a seed can be in a tile: the others become -1, a run of them one
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + self.least, -1)
        inside = np.cumsum(inside)[:-1] > 0
        short = np.where(inside, numbers, -1)[inside | np.concatenate(([True], inside[:-1]))].tolist()
        spread = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))
        out = []
        for item in np.unique(self.item[spread]).tolist():
            own = self.items[item]
            places = np.unique(self.place[spread][self.item[spread] == item])
            reach = np.zeros(len(own) + 1, np.int64)
            np.add.at(reach, places, 1)
            np.add.at(reach, places + self.least, -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < threshold * len(own):  # seeds bound what tiles can cover
                continue
            tiles = tile(own.tolist(), short, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(own):
                out.append((item, covered / len(own), covered, len(tiles)))
        return out


def blocks(benchmark: DataFrame, least: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """Indexes of up to block_words words each, read partition by partition."""
    some, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        n = len(words_of(r[1]))
        if some and size + n > block_words:
            yield Index(some, least)
            some, size = [], 0
        some.append((r[0], r[1]))
        size += n
    if some:
        yield Index(some, least)


MATCHES = "doc_id long, item_id long, coverage double, words_covered long, n_tiles long"


def find(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item whose words it covers to threshold."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCHES)
    for k, index in enumerate(blocks(benchmark, min_match, block_words)):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(d, index.ids[i], c, n, k) for d, t in zip(ids, batch.column("text").to_pylist()) for i, c, n, k in index.matches(t, threshold)]
                cols = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "coverage", "words_covered", "n_tiles"])

        found = slim.mapInArrow(run, MATCHES)
        out = found if k == 0 else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that no item contaminates, all columns as they are."""
    at = docs.columns.index("text")
    for index in blocks(benchmark, min_match, block_words):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                keep = [not index.matches(t, threshold) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
