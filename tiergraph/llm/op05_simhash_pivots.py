"""SimHash near-duplicates with a pivot distance table.

The table has one row a distinct fingerprint: its Hamming distances to ``PIVOTS`` reference
fingerprints, computed once, stored, and carried with the fingerprint. A candidate pair goes if any
coordinate differs by more than the bound (triangle inequality); survivors are verified.

Which pairs are candidates is not decided by the table. One coordinate of a 64-bit fingerprint has a
standard deviation of 4, so cells wide enough for 4 differing bits hold most rows and their
neighbours: a split by one pivot leaves 0.84 of the rows in a cell and makes 1.68 rows of each, and no
number of pivots ends in small cells. So candidates share bits (``near_duplicates``, exact: ``max_bits``
differing bits leave ``GROUPS - max_bits`` of ``GROUPS`` groups of bits equal) or the strongest
projections of several groups (``keep_one``). A bucket gives the edges of a spanning forest, one less
than its nodes, never all its pairs. Equal fingerprints are one node from the start.

``near_duplicates`` links fingerprints of max_bits differing bits or fewer; a bucket of more than
``BUCKET_ROWS`` fingerprints is dealt again by the bits that they don't share yet, so no bucket is one
task's work. ``keep_one`` links texts whose sets of word shingles have a Jaccard similarity of
``similarity`` or more. A wide SimHash finds most of the groups; then ``crossing`` names every pair that
may still join two groups, by filters that lose no pair. Both kinds of pairs are verified on the sets
themselves, so the components are those of all pairs (equal XXH64 are taken for equal shingles).

Defined results: a null or wordless text has fingerprint zero and no shingles, and all such texts are
copies of each other; a null doc_id gets a fingerprint and a component but is never the component's id
unless the whole component is null; rows that repeat a doc_id count as they come; an empty table gives
no rows; other columns are not read, and keep_one carries them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.llm.common import free_name, give_back, lower_ascii, sized
from tiergraph.llm.common import restart as cut_lineage

GROUPS = 7
PIVOTS = 16
#: Distinct fingerprints that one bucket, and so one task, compares at most.
BUCKET_ROWS = 32_768
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
GOLDEN = 0x9E3779B97F4A7C15  # 2^64 divided by the golden ratio


def _bit_rows() -> np.ndarray:
    """256 x 8: the bits of a byte, lowest first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a whole text, ASCII-lower-cased already, repeats included."""
    import xxhash

    spans = [m.span() for m in WORD.finditer(text)]
    if not spans:
        return np.empty(0, np.uint64)
    joined = b" ".join([text[a:b] for a, b in spans])
    size = np.array([b - a for a, b in spans])
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    h = xxhash.xxh64_intdigest
    if len(spans) < shingle:
        return np.array([h(joined, 42)], np.uint64)
    return np.array([h(joined[a:b], 42) for a, b in zip(start[: len(start) - shingle + 1].tolist(), end[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, shingle: int, bit_rows: np.ndarray) -> int:
    """SimHash of a whole text over its word shingles."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bit_rows for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(lower_ascii(F.col("text")), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit_rows = _bit_rows()
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"", shingle, bit_rows) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return _texts(docs).mapInArrow(run, "doc_id long, fp long")


def group_masks(free: list[int], groups: int = GROUPS) -> list[int]:
    """The bits at the places ``free`` in ``groups`` runs of near equal width."""
    cuts = [len(free) * k // groups for k in range(groups + 1)]
    return [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]


def choices(shared: int, max_bits: int) -> list[int]:
    """Masks that hold ``shared`` and some groups of the other bits.

    Any two fingerprints that are equal under ``shared`` and differ in max_bits or fewer are equal
    under one of them.
    """
    free = [b for b in range(64) if not shared >> b & 1]
    groups = min(len(free), max_bits + 3 if not shared else max_bits + 2)
    return [shared | sum(some) for some in combinations(group_masks(free, groups), groups - max_bits)]


def _signed(mask: int) -> int:
    return mask if mask < 1 << 63 else mask - (1 << 64)


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints that spread over the cube: odd multiples of the golden ratio's bits."""
    return [(GOLDEN * (2 * k + 1)) % (1 << 64) for k in range(n)]


def distances(fp: Column, n: int = PIVOTS) -> list[Column]:
    """Hamming distances of fp to the references, eight to a long, a byte each."""
    d = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long") for p in pivots(n)]
    packed = []
    for lo in range(0, n, 8):
        word = d[lo]
        for k, x in enumerate(d[lo + 1 : lo + 8], 1):
            word = word.bitwiseOR(F.shiftleft(x, 8 * k))
        packed.append(word)
    return packed


def pivot_table(prints: DataFrame) -> DataFrame:
    """fp, first (least doc_id), d0, d1 (its distances): one row a distinct fingerprint, stored."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return cut_lineage(nodes.select("fp", "first", *[d.alias(f"d{k}") for k, d in enumerate(distances(F.col("fp")))]))


def forest(fps: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the graph of pairs with at most max_bits differing bits.

    table holds each fingerprint's distances to the references. What a node reaches is chained, so
    that no node has many edges.
    """
    left = np.arange(1, len(fps))
    queue, edges = [0], []
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        if not len(left):
            continue
        survive = left[(np.abs(table[left] - table[at]) <= max_bits).all(axis=1)]
        hit = survive[np.bitwise_count(fps[survive] ^ fps[at]) <= max_bits].tolist()
        if hit:
            edges += zip([at, *hit[:-1]], hit)
            queue += hit
            left = left[~np.isin(left, hit)]
    return edges


def by_bucket(rows: DataFrame, key: list[str], edges: Callable[[np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """a, b: rows (arrays of all columns, as longs) that ``edges`` joins within a bucket, whose rows come to one task in turn."""
    names, n = [*key, *[c for c in rows.columns if c not in key]], len(key)
    dealt = rows.select(*[F.col(c).cast("long") for c in names]).repartition(*key).sortWithinPartitions(*key)

    def buckets(found: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((found[1:, :n] != found[:-1, :n]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(found)]))
        many = np.flatnonzero(ends - starts > 1)
        pairs = [(a + i, a + j) for a, b in zip(starts[many].tolist(), ends[many].tolist()) for i, j in edges(found[a:b])]
        at = np.array(pairs, np.int64).reshape(-1, 2)
        sides = [pa.FixedSizeListArray.from_arrays(pa.array(found[at[:, s]].ravel()), len(names)).cast(pa.list_(pa.int64())) for s in (0, 1)]
        return pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            found = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]).astype(np.int64)
            if not len(found):
                continue
            last = np.flatnonzero((found[:, :n] != found[-1, :n]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut == 0 and (not held or (held[0][0, :n] == found[-1, :n]).all()):
                held.append(found)
                continue
            if held or cut:
                yield buckets(np.concatenate([*held, found[:cut]]))
            held = [found[cut:].copy()]
        if held:
            yield buckets(np.concatenate(held))
        give_back()

    return dealt.mapInArrow(run, "a array<long>, b array<long>")


def deal(rows: DataFrame, masks: list[int], max_bits: int) -> DataFrame:
    """rows (mask, fp and more) with part under every choice that follows their mask, one of ``masks``."""
    ways = [(_signed(m), _signed(c)) for m in masks for c in choices(m, max_bits)]
    table = F.broadcast(rows.sparkSession.createDataFrame(ways, "mask long, choice long"))  # choices, not data
    rest = [c for c in rows.columns if c not in ("mask", "part")]
    dealt = rows.join(table, "mask").select(F.col("choice").alias("mask"), F.col("fp").bitwiseAND(F.col("choice")).alias("part"), *rest)
    return dealt.distinct() if masks != [0] else dealt  # several ways lead to one choice


def links(nodes: DataFrame, max_bits: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """a, b (fp and first each): edges between rows of a pivot table that connect what max_bits connects."""
    # arrays of longs go to Python, so that a null first goes as a flag
    slim = nodes.select(F.lit(0).cast("long").alias("mask"), "fp", F.col("first").isNull().cast("long").alias("none"), F.coalesce("first", F.lit(0)).alias("first"), "d0", "d1")
    edges = None
    dealt = deal(slim, [0], max_bits)
    few = nodes.count() <= bucket_rows
    while True:
        crowded = None
        if not few:
            # a mask of 64 - d bits leaves 2 to the d fingerprints a bucket, so this ends
            crowded = cut_lineage(dealt.groupBy("mask", "part").count().where(F.col("count") > bucket_rows).select("mask", "part"))
            masks = [r[0] & (1 << 64) - 1 for r in crowded.select("mask").distinct().collect()]  # choices, not data
            few = not masks
        found = forests(dealt if few else dealt.join(crowded, ["mask", "part"], "left_anti"), max_bits)
        edges = found if edges is None else edges.union(found)
        if few:
            return edges.distinct()
        dealt = cut_lineage(deal(dealt.join(crowded, ["mask", "part"], "left_semi"), masks, max_bits))


def forests(dealt: DataFrame, max_bits: int) -> DataFrame:
    """a, b: the edges of a spanning forest of each bucket (mask, part)."""

    def edges(rows: np.ndarray) -> list[tuple[int, int]]:
        table = np.ascontiguousarray(rows[:, 5:7]).view(np.int8)
        return forest(np.ascontiguousarray(rows[:, 2]).view(np.uint64), table, max_bits)

    found = by_bucket(dealt.select("mask", "part", "fp", "none", "first", "d0", "d1"), ["mask", "part"], edges)
    side = lambda s: node(F.when(F.col(s)[3] == 0, F.col(s)[4]), F.col(s)[2]).alias(s)
    return found.select(side("a"), side("b"))


def node(first: Column, *name: Column) -> Column:
    """A node of components(): ordered by its least doc_id, none last, then by its name."""
    return F.struct(first.isNull().alias("none"), first.alias("first"), *[x.alias(f"n{k}") for k, x in enumerate(name)])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: smallest node reachable, by alternating large-star and small-star steps.

    The least neighbour of each node is aggregated with partial minima and stored, then joined with
    the edges; both sides of such a join are shuffled by it alone, so that a node with very many
    edges is a skewed join, which Spark's adaptive execution splits. The rounds needed grow with the
    logarithm of the longest path.
    """
    pairs = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        heads = pairs.select(F.col("b").alias("child")).distinct()
        # stars only: every child has one parent, and no parent is a child
        if pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and pairs.join(heads, pairs["a"] == heads["child"], "left_semi").isEmpty():
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
        both = pairs.union(pairs.select("b", "a"))
        least = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
        large = cut_lineage(both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("root").alias("a"), "b").where("a <> b").distinct())
        low = cut_lineage(large.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        small = large.join(low, F.col("b") == F.col("node")).select(F.col("root").alias("r"), "a", "b")
        ends = F.explode(F.array(F.struct(F.col("r").alias("a"), F.col("b").alias("b")), F.struct(F.col("r").alias("a"), F.col("a").alias("b")))).alias("e")
        pairs = cut_lineage(small.select(ends).select("e.a", "e.b").where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    prints = cut_lineage(fingerprints(docs, shingle))
    nodes = pivot_table(prints)
    roots = components(links(nodes, max_bits)).select(F.col("node.n0").alias("linked"), F.col("root.first").alias("least"))
    # a node without a first may have a root with one, or be alone
    named = cut_lineage(nodes.join(roots, nodes["fp"] == F.col("linked"), "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# --- similarity of shingle sets: wide projections -----------------------------------------------

#: Projections of a wide SimHash, in groups of GROUP; a group's strongest projection and its sign are one symbol.
WIDE, GROUP = 512, 16
#: Keys of a text, each of SYMBOLS symbols (5 bits each).
KEYS, SYMBOLS = 24, 3
#: Bits of the wide fingerprint that are carried, and the share of them in which candidates may differ beyond what is expected.
CARRIED, SLACK = 256, 3.0
#: Rows that one wide bucket compares at most; leaders of a larger one; groups by which its other rows are dealt again.
WIDE_ROWS, LEADERS, AGAIN = 8_192, 8, 6
#: Sets that may have one shingle before it goes to the end of the order; the order is made from one text of COUNTED.
CROWD, COUNTED = 1_000, 50
#: The order is made anew, ORDERS times at most, where more than so many pairs a set meet at crowded first shingles.
ORDERS, MEET = 3, 100


def projections(hashes: np.ndarray) -> np.ndarray:
    """WIDE sums over the shingles of weights from -255 to 255, uniform and independent by shingle."""
    out = np.zeros(WIDE, np.int64)
    lanes = (np.arange(1, WIDE // 8 + 1, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
    for lo in range(0, len(hashes), 4096):
        some = hashes[lo : lo + 4096]
        x = (some[:, None] ^ (some[:, None] >> np.uint64(29))) * lanes[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)  # an odd number whose bits are spread
        x ^= x >> np.uint64(32)
        out += 2 * x.view(np.uint8).sum(axis=0, dtype=np.uint32).astype(np.int64) - 255 * len(some)
    return out


def key_groups(keys: int = KEYS, size: int = SYMBOLS, seed: int = 17) -> list[list[int]]:
    """The groups that each key reads."""
    pick = np.random.default_rng(seed)
    return [sorted(pick.choice(WIDE // GROUP, size, replace=False).tolist()) for _ in range(keys)]


def symbols(sums: np.ndarray) -> np.ndarray:
    """The strongest projection of each group, with its sign: WIDE / GROUP numbers below 2 x GROUP."""
    grouped = sums.reshape(-1, GROUP)
    at = np.abs(grouped).argmax(axis=1)
    return at * 2 + (grouped[np.arange(len(at)), at] > 0)


def wide_bits(sums: np.ndarray) -> np.ndarray:
    """The carried bits of the wide fingerprint as longs."""
    return np.packbits(sums[:CARRIED] > 0, bitorder="little").view("<i8")


def bound_bits(similarity: float) -> int:
    """Carried bits in which fingerprints of two sets of this Jaccard similarity differ at most, but for a chance of some 0.001."""
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(CARRIED * angle + SLACK * (CARRIED * angle * (1 - angle)) ** 0.5)


WIDE_NAMES = [f"w{k}" for k in range(CARRIED // 64)]


PARITY_NAMES = [f"p{k}" for k in range(4)]


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """Four longs: whether the shingles that fall on a bit are odd in number. Two sets differ in at least as many shingles as bits."""
    return np.packbits(np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1, bitorder="little").view("<i8")


def first_shingles(hashes: np.ndarray, similarity: float, late: np.ndarray) -> np.ndarray:
    """The first shingles of a set (in ascending order, those of ``late`` after all others), as longs.

    Sets of the similarity share at least ``similarity`` times the size of either, so one of these: no
    more of a set's shingles stay out of them than that, less one.
    """
    if len(late) and len(hashes):
        is_late = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
        hashes = np.concatenate([hashes[~is_late], hashes[is_late]])
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1].view(np.int64)


def frequent(docs: DataFrame, shingle: int, crowd: int, one_of: int = COUNTED) -> np.ndarray:
    """Shingles, ascending, that more than half of ``crowd`` texts have, going by one distinct text of ``one_of``: the end of the order.

    Any order of the shingles loses no pair, so what this guesses wrong costs time only.
    """
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_of)) == 0).select(F.lit(None).cast("long").alias("doc_id"), "text").distinct()
    token = F.explode("shingles").alias("token")
    counts = shingle_sets(some.withColumn("key", F.lit("")), shingle, "key").select(token).groupBy("token").count()
    often = counts.where(F.col("count") >= max(3, crowd // (2 * one_of))).select("token").collect()  # an order, not data
    return np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64))


def wide_prints(docs: DataFrame, shingle: int, key: Column, similarity: float = 0.8, late: np.ndarray = np.empty(0, np.uint64)) -> DataFrame:
    """doc_id, key, the wide fingerprint and the symbols of every whole text; its set's digest, parity bits, size and first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, syms, digests, sizes, begin = [], [], [], [], []
            for t in batch.column("text"):
                hashes = np.unique(shingle_hashes(t.as_py() or b"", shingle))
                sums = projections(hashes)
                words.append(np.concatenate([wide_bits(sums), parity_bits(hashes)]))
                syms.append(symbols(sums).astype(np.int8).tobytes())
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sizes.append(len(hashes))
                begin.append(first_shingles(hashes, similarity, late))
            table = np.array(words, np.int64).reshape(-1, len(longs))
            arrays = [batch.column("doc_id"), batch.column("key"), *[pa.array(table[:, k]) for k in range(len(longs))], pa.array(syms, pa.binary())]
            arrays += [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(begin, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", *longs, "symbols", "digest", "size", "begin"])
        give_back()

    longs = [*WIDE_NAMES, *PARITY_NAMES]
    names = ", ".join(f"{w} long" for w in longs)
    return _texts(docs, key.alias("key")).mapInArrow(run, f"doc_id long, key string, {names}, symbols binary, digest binary, size long, begin array<long>")


def shingle_sets(docs: DataFrame, shingle: int, key: str, of: Callable[[np.ndarray], np.ndarray] = lambda hashes: hashes.view(np.int64)) -> DataFrame:
    """key, shingles (what ``of`` gives of the set of a whole text's shingle hashes, in ascending order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [of(np.unique(shingle_hashes(t.as_py() or b"", shingle))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    return _texts(docs, F.col(key).alias("key")).select("key", "text").mapInArrow(run, "key string, shingles array<long>")


def spanning(words: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """Index pairs of a least spanning forest, by differing bits, of the pairs that differ in at most ``bound``."""
    n = len(words)
    out, near, best, free = [], np.zeros(n, np.int64), np.full(n, bound + 1, np.int64), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        free[at] = False
        d = np.bitwise_count(words ^ words[at]).sum(axis=1, dtype=np.int64)
        closer = free & (d < best)
        best[closer], near[closer] = d[closer], at
        rest = np.flatnonzero(free)
        at = int(rest[best[rest].argmin()])
        if best[at] <= bound:
            out.append((int(near[at]), at))
    return out


def _key(groups: list[int], *before: Column) -> Column:
    return F.xxhash64(*before, *[F.substring(F.col("symbols"), g + 1, 1) for g in groups])


def wide_links(nodes: DataFrame, similarity: float, most: int = WIDE_ROWS) -> DataFrame:
    """a, b (wide fingerprints as arrays): pairs of nodes that may have the similarity, a forest of each bucket.

    Of a bucket of more than ``most`` rows a few are leaders, the others are each paired with their
    nearest leader within the bound, and rows without one are dealt again by one more symbol of
    several groups. So no bucket is one task's work, and a large group of near copies takes one pass.
    Pairs may be missed, here and by the keys: ``crossing`` finds what they leave unlinked.
    """
    bound = bound_bits(similarity)
    me = F.array(*WIDE_NAMES)
    keyed = nodes.select(F.explode(F.array(*[_key(g, F.lit(k)) for k, g in enumerate(key_groups())])).alias("key"), *WIDE_NAMES, "symbols")
    few, edges, level = nodes.count() <= most, None, 0
    while True:
        crowded = None if few else cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"))
        few = few or crowded.isEmpty()
        plain = (keyed if few else keyed.join(crowded, "key", "left_anti")).select("key", *WIDE_NAMES)
        found = by_bucket(plain, ["key"], lambda rows: spanning(np.ascontiguousarray(rows[:, 1:]).view(np.uint64), bound))
        found = found.select(*[F.slice(s, 2, len(WIDE_NAMES)).alias(s) for s in ("a", "b")])
        edges = found if edges is None else edges.union(found)
        if few:
            return edges.distinct()
        level += 1
        inside = keyed.join(crowded, "key", "left_semi")
        seeds = [F.min(F.struct(F.xxhash64(F.lit(s), *WIDE_NAMES), me.alias("w")))["w"] for s in range(LEADERS)]
        leaders = sized(inside.groupBy("key").agg(F.array_distinct(F.array(*seeds)).alias("leaders")), width=40 + LEADERS * CARRIED // 8)
        differ = lambda x: sum((F.bit_count(F.col(w).bitwiseXOR(x[k])) for k, w in enumerate(WIDE_NAMES)), F.lit(0))
        nearest = F.array_min(F.transform("leaders", lambda x: F.struct(differ(x).alias("d"), x.alias("w"))))
        led = cut_lineage(inside.join(leaders, "key").withColumn("near", nearest).drop("leaders"))
        hit = F.col("near.d") <= bound
        edges = edges.union(led.where(hit & (F.col("near.d") > 0)).select(F.col("near.w").alias("a"), me.alias("b")))
        more = key_groups(AGAIN, 1, seed=17 + level)
        again = F.explode(F.array(*[_key(g, F.col("key"), F.lit(g[0])) for g in more])).alias("key")
        keyed = cut_lineage(led.where(~hit).select(again, *WIDE_NAMES, "symbols"))


def row_key() -> Column:
    """A string that rows of documents share if they have the same doc_id (or none) and the same text (or none)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return F.sha2(F.concat(F.col("doc_id").isNull().cast("string"), F.lit("|"), parts[0], F.lit("|"), F.col("text").isNull().cast("string"), F.lit("|"), parts[1]), 256)


def texts_of(docs: DataFrame, keys: DataFrame, shingle: int, *of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, shingles (see shingle_sets) of the rows of docs whose key is in ``keys``, stored."""
    key = free_name(docs.columns, "key")
    needed = sized(keys.toDF("needed").distinct(), width=80)
    texts = docs.select("doc_id", "text", row_key().alias(key)).join(needed, F.col(key) == F.col("needed"), "left_semi")
    return cut_lineage(shingle_sets(texts, shingle, key, *of).dropDuplicates(["key"]))


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b: ids of nodes) that have the similarity, by their whole sets."""
    both = pairs
    for s in ("a", "b"):
        both = both.join(nodes.select(F.col("id").alias(s), F.col("key").alias(f"{s}_key")), s)
    both = cut_lineage(both)
    sets = texts_of(docs, both.select(F.explode(F.array("a_key", "b_key"))), shingle)
    for s in ("a", "b"):
        both = both.join(sets.select(F.col("key").alias(f"{s}_key"), F.col("shingles").alias(f"{s}_set")), f"{s}_key")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return cut_lineage(both.where(common >= similarity * (F.size("a_set") + F.size("b_set") - common) - 1e-9).select("a", "b"))


def ordered(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, crowd: int, late: np.ndarray = np.empty(0, np.uint64)) -> tuple[DataFrame, DataFrame]:
    """nodes with their first shingles (begin) in an order that is good for all, and token, n: those shingles that several groups have.

    Any one order of all shingles loses no pair. ``late`` is the end of the order that nodes have. Where
    too many pairs meet at shingles that more than ``crowd`` sets have among their first, those go to the
    end too, which changes the sets that have them there only.
    """
    bearable = MEET * nodes.count()
    for k in range(ORDERS):
        tokens = nodes.select("group", F.explode("begin").alias("token")).groupBy("token")
        tokens = cut_lineage(tokens.agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token", "n"))
        if k == ORDERS - 1 or (tokens.where(F.col("n") > crowd).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0) <= bearable:
            break
        crowded = [r[0] for r in tokens.where(F.col("n") > crowd).select("token").collect()]  # an order, not data
        new = np.setdiff1d(np.array(crowded, np.int64).view(np.uint64), late)
        if not len(new):
            break
        late = np.union1d(late, new)
        listed = F.broadcast(nodes.sparkSession.createDataFrame([(int(x),) for x in new.view(np.int64)], "token long"))
        changed = sized(nodes.select("key", F.explode("begin").alias("token")).join(listed, "token", "left_semi").select("key").distinct(), width=80)
        begin = texts_of(docs, changed, shingle, lambda hashes, late=late: first_shingles(hashes, similarity, late))
        anew = nodes.drop("begin").join(changed, "key", "left_semi").join(begin.withColumnRenamed("shingles", "begin"), "key")
        # stored: a round reads them twice, so that plans would double with each
        nodes = cut_lineage(nodes.join(changed, "key", "left_anti").unionByName(anew))
    return nodes, tokens


def crossing(nodes: DataFrame, tokens: DataFrame, similarity: float, crowd: int = CROWD) -> DataFrame:
    """a, b (ids), a_group, b_group: every pair of nodes of two groups that may have the similarity.

    Such a pair shares some of its first shingles, and each pair meets once at each of them. What they
    share beyond is at most what follows the first shingles of one of them, and what follows the first
    shared one in either. Sizes and parity bits drop pairs before they are counted. A shingle that
    many sets have is dealt over several places.
    """
    places = F.ceil(F.col("n") / crowd)
    # most shingles are of one group and go here, before their rows get the other columns
    live = cut_lineage(nodes.select("id", F.posexplode("begin").alias("at", "token")).join(sized(tokens, width=16), "token"))
    beside = nodes.select("id", "group", "size", (F.col("size") - F.size("begin")).alias("after"), *PARITY_NAMES)
    live = live.join(beside, "id").withColumn("left", F.col("size") - F.col("at"))
    names = ["id", "group", "size", "left", "after", *PARITY_NAMES]
    a = live.select("token", F.pmod(F.xxhash64("id"), places).alias("place"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = live.select("token", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place"), *[F.col(c).alias(f"b_{c}") for c in names])
    both = F.col("a_size") + F.col("b_size")
    differ = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITY_NAMES), F.lit(0))
    fits = (F.col("a_group") != F.col("b_group")) & (F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-9)
    fits &= differ * (1 + similarity) <= (1 - similarity) * both + 1e-9
    met = a.join(b.hint("merge"), ["token", "place"]).where((F.col("a_id") < F.col("b_id")) & fits)
    met = met.groupBy("a_id", "b_id", "a_group", "b_group", both.alias("both"), F.greatest("a_after", "b_after").alias("after"))
    met = met.agg(F.count(F.lit(1)).alias("common"), F.max(F.least("a_left", "b_left")).alias("left"))
    met = met.where(F.least(F.col("common") + F.col("after"), F.col("left")) * (1 + similarity) >= similarity * F.col("both") - 1e-9)
    return cut_lineage(met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_group", "b_group"))


def grouped(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with their group (least id reachable over found) for the one that they had."""
    roots = components(found).select(F.col("node").alias("id"), F.col("root").alias("group"))
    return nodes.drop("group").join(sized(roots, width=16), "id", "left").withColumn("group", F.coalesce("group", "id"))


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = WIDE_ROWS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Nodes (a set of shingles: the key of its first row, that row's doc_id) and verified links (a, b: keys) that connect what all links connect."""
    late = frequent(docs, shingle, crowd)
    prints = cut_lineage(wide_prints(docs, shingle, row_key(), similarity, late))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", *WIDE_NAMES, *PARITY_NAMES, "symbols", "size", "begin")).alias("least")
    nodes = prints.groupBy("digest").agg(least).select("least.*").withColumnRenamed("doc_id", "first")
    nodes = cut_lineage(nodes.drop("none").withColumn("id", F.monotonically_increasing_id()))
    wide = cut_lineage(nodes.groupBy(*WIDE_NAMES).agg(F.min("id").alias("one"), F.min("symbols").alias("symbols")))
    # texts of one wide fingerprint are tried with one of them, and that one with others
    pairs = wide_links(wide, similarity, most)
    for s in ("a", "b"):
        pairs = pairs.join(wide.select(F.array(*WIDE_NAMES).alias(s), F.col("one").alias(f"{s}_one")), s).drop(s)
    same = nodes.join(wide.drop("symbols"), WIDE_NAMES).where("id <> one").select("one", "id")
    pairs = pairs.select("a_one", "b_one").union(same).toDF("a", "b")
    found = verified(docs, nodes, pairs, shingle, similarity)
    slim = grouped(nodes.drop(*WIDE_NAMES, "symbols", "first"), found)
    # every pair of two groups; one of each two groups first, which spares the others if it holds
    slim, tokens = ordered(docs, slim, shingle, similarity, crowd, late)
    pairs = crossing(slim, tokens, similarity, crowd)
    total = pairs.count()
    one = cut_lineage(pairs.groupBy(F.least("a_group", "b_group"), F.greatest("a_group", "b_group")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))
    if total:
        found = cut_lineage(found.union(verified(docs, nodes, one, shingle, similarity)))
    if total > one.count():
        groups = grouped(slim.select("id"), found)
        for s in ("a", "b"):
            pairs = pairs.drop(f"{s}_group").join(groups.select(F.col("id").alias(s), F.col("group").alias(f"{s}_group")), s)
        pairs = pairs.where("a_group <> b_group").select("a", "b").join(one, ["a", "b"], "left_anti")
        found = cut_lineage(found.union(verified(docs, nodes, pairs, shingle, similarity)))
    for s in ("a", "b"):
        found = found.join(nodes.select(F.col("id").alias(s), F.col("key").alias(f"{s}_key")), s)
    return nodes, found.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, one of each component of similar texts: the first by doc_id (none last), then by a hash of id and text.

    So rows that repeat a doc_id with texts that are no copies all stay.
    """
    nodes, found = similar(docs, shingle, similarity)
    firsts = nodes.select("key", node(F.col("first"), F.col("key")).alias("node"))
    edges = found
    for s in ("a", "b"):
        edges = edges.join(firsts.select(F.col("key").alias(s), F.col("node").alias(f"{s}_node")), s).drop(s)
    roots = components(edges.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    keep = cut_lineage(nodes.select("key").join(roots.select(F.col("node.n0").alias("key")), "key", "left_anti"))
    key = free_name(docs.columns, "key")
    kept = docs.withColumn(key, row_key()).join(keep.select(F.col("key").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).select(docs.columns)
