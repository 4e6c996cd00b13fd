"""Token-ID output in ORC: run-length encoded ids, row indexes, Bloom filters on document ids.

Defined results: a null text is an empty one (its row holds the end id alone); a null doc_id sorts
first; rows that repeat a doc_id are all kept, ordered by a hash of their text; an empty table gives a
folder without rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tiergraph.llm.tokens import with_end, word_tokenizer

#: Columns of a token file. part and local_start place a document without reading any other file.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """doc_id, part, local_start, n_tokens, ids of docs as they lie in their partitions.

    part is the partition's number and local_start the ids before the document in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = word_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            lo = 0
            for ids, offsets in coder.encode(batch.column("text")):
                if end_id is not None:
                    ids, offsets = with_end(ids, offsets, end_id)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(before + offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    ],
                    names=SCHEMA.names,
                )
                before += int(offsets[-1])
                lo += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Writes docs' ids in ascending doc_id order: file by file, stripe by stripe.

    One range shuffle of the texts orders them before they are encoded, so that ids are never
    shuffled; ranges are cut by doc_id and a hash of the text, so that an id that many rows repeat is
    dealt over many files (copies of one row stay together). Stripes are sized for parallel reads, row indexes hold minima and maxima of every
    index_rows rows, and a Bloom filter on doc_id lets a lookup skip the rest.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))
    ordered = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    (
        encode(ordered, tokenizer_path, end_id)
        .write.option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_rows)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with doc_ids only those, pushed down to stripe statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def part_starts(tokens: DataFrame) -> DataFrame:
    """part, part_start: ids before each file, from one row a file."""
    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    return sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("part_start"))


def token_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, part, local_start, n_tokens, ids_crc32 computed from the ids that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a written folder."""
    tokens = read_tokens(spark, path)
    # one row a file: as small as the file listing that the driver holds anyway
    starts = part_starts(tokens)
    return token_crc(tokens).join(starts, "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
