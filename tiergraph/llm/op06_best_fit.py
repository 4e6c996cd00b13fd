"""Best-fit packing planned over a histogram of lengths.

The planner sees counts of lengths, never documents: at most ``capacity`` of them, however large
the corpus. Documents then take the planned slots by joining on their rank within their length.

Defined results: a null text is empty (one piece holding the end id); a null doc_id is kept; repeated
rows are packed once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tiergraph.llm.common import give_back
from tiergraph.llm.tokens import MEMO_STEMS, MEMO_WORDS, with_end, word_tokenizer

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)
PLAN = "length long, rank_lo long, rank_hi long, sequence_lo long, per_sequence long, first_offset long"
#: Parts, at least, into which the rows of one length are dealt for ranking, and rows of a part at most or nearly so.
SALTS, SALT_ROWS = 256, 1 << 20


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, memo: tuple[int, ...] = (MEMO_WORDS, MEMO_STEMS)) -> DataFrame:
    """Pieces of at most capacity ids of each document with its end id; only longer documents are cut.

    memo: words and stems that a worker remembers, and bytes of text that it takes at once; less memory
    costs time and changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(tokenizer_path, *memo)
        for batch in batches:
            lo = 0
            for ids, offsets in coder.encode(batch.column("text")):
                ids, offsets = with_end(ids, offsets, end_id)
                n = np.diff(offsets)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                bounds = np.append(offsets[doc] + start, offsets[-1])
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, len(n)).take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    ],
                    names=PIECES.names,
                )
                lo += len(n)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over {length: count}; rows as in PLAN.

    Sequences with equal room are one group, so a step places a whole count: of ``room`` in the
    fullest group that still takes ``length``, each sequence takes as many as fit before the next
    is begun, as best fit does one by one. Groups split at most once a step; the plan's size
    depends on capacity alone.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, sequences)]
    made = 0

    def put(length: int, rank: int, n: int, first: int, size: int, room: int) -> int:
        """Places up to n pieces in a group of equal room; what is left of the group goes back."""
        fit = room // length
        full = min(n // fit, size)
        if full:
            rows.append((length, rank, rank + full * fit, first, fit, capacity - room))
            if room - fit * length:
                groups[room - fit * length].append((first, full))
            rank, n, first, size = rank + full * fit, n - full * fit, first + full, size - full
        placed = full * fit
        if n and size:  # fewer than fit are left: they share one sequence
            some = min(n, fit)
            rows.append((length, rank, rank + some, first, some, capacity - room))
            if room - some * length:
                groups[room - some * length].append((first, 1))
            placed, first, size = placed + some, first + 1, size - 1
        if size:
            groups[room].append((first, size))
        return placed

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        for room in sorted(r for r in groups if r >= length):
            for first, size in groups.pop(room):
                done = put(length, rank, n, first, size, room) if n else 0
                if not n:
                    groups[room].append((first, size))
                rank, n = rank + done, n - done
            if not n:
                break
        if n:
            fit = capacity // length
            size = -(-n // fit)
            put(length, rank, n, made, size, capacity)
            made += size
    return rows


def rank_within_length(pieces: DataFrame, salts: int = SALTS) -> DataFrame:
    """pieces with rank: 0, 1, ... within each length.

    A length is dealt over ``salts`` parts by hash; ranks within a part are shifted by the counts
    of the parts before it. The shifts are at most capacity x salts rows. salts changes no set of ranks.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    shifts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    shifts = shifts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("shift"))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return salted.withColumn("rank", rank).join(shifts, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("shift")).cast("long")).drop("salt", "shift")


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = F.broadcast(spark.createDataFrame(plan_best_fit(counts, capacity), PLAN))  # sized by capacity, not by rows
    ranked = rank_within_length(pieces, max(SALTS, -(-max(counts.values(), default=0) // SALT_ROWS))).alias("p")
    on = (F.col("p.length") == F.col("plan.length")) & (F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_hi"))
    nth = F.col("rank") - F.col("rank_lo")
    return ranked.join(plan.alias("plan"), on).select(
        *[F.col(f"p.{c}") for c in pieces.columns],
        (F.col("sequence_lo") + F.expr("(rank - rank_lo) div per_sequence")).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("per_sequence")) * F.col("p.length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, memo: tuple[int, ...] = (MEMO_WORDS, MEMO_STEMS)) -> DataFrame:
    """Writes the pieces with their ids to path, then returns each piece's place in a sequence."""
    cut_pieces(docs, tokenizer_path, capacity, end_id, memo).write.parquet(path)
    slim = docs.sparkSession.read.schema(PIECES).parquet(path).drop("ids")
    return assign(slim, capacity)


def sequences(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from the written pieces and their places."""
    pieces = spark.read.schema(PIECES).parquet(path).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    keys = [places[k].eqNullSafe(pieces[k]) for k in ("doc_id", "piece", "ids_crc32")]
    joined = places.join(pieces, keys).select("sequence_id", F.struct("offset", "ids").alias("x"))
    grouped = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list("x")).alias("x"))  # at most capacity ids
    return grouped.select("sequence_id", F.flatten(F.transform("x", lambda x: x["ids"])).alias("ids"))
