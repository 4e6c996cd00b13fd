"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; (rank + 1/2) / size of the
source places every source evenly on 0 to 1. Cutting the rows, sorted by that fraction, into equal
runs gives shards whose counts differ by one at most and whose sources follow the mixture.

Both rankings are dealt over buckets of the sort key and shifted by the counts of the buckets
before, so neither a source nor the whole table is ever one task's work.

DataFrame functions only. Defined results: a null source is a source of its own; a null doc_id is
ordered by text alone; repeated rows get a place each; a null text has no bytes (size 1); an empty
table gives no rows; other columns are carried, whatever their names, but shard and slot, which are
made anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiergraph.llm.common import free_prefix

#: Buckets at least, and rows that a bucket, so a task, ranks at most or nearly so.
BUCKETS, BUCKET_ROWS = 256, 1 << 20


def _bucket_shift(rows: DataFrame, by: list[str], p: str) -> DataFrame:
    """by, bucket, before (rows of by in the buckets before), whole (rows of by): at most groups x buckets rows."""
    counts = rows.groupBy(*by, f"{p}bucket").agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return counts.select(*by, f"{p}bucket", (F.sum("n").over(part.orderBy(f"{p}bucket")) - F.col("n")).alias(f"{p}before"), F.sum("n").over(part).alias(f"{p}whole"))


def interleave(rows: DataFrame, shards: int = 16, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """rows (with doc_id, source, size and text_crc32) with shard and slot.

    buckets, a power of two, follows from the count of rows; it changes who ranks them, never a rank.
    """
    if buckets is None:
        buckets = max(BUCKETS, 1 << (rows.count() // BUCKET_ROWS).bit_length())
    p = free_prefix(rows.columns)
    keyed = rows.withColumns(
        {
            f"{p}source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
            # unsigned order of a 63-bit hash; equal rows are interchangeable
            f"{p}order": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32")), 1),
        }
    ).withColumn(f"{p}bucket", F.shiftright(F.col(f"{p}order"), 63 - (buckets.bit_length() - 1)).cast("int"))
    shift = _bucket_shift(keyed, [f"{p}source"], p)
    tie = [f"{p}order", "doc_id", "text_crc32", "size"]
    ranked = keyed.withColumn(f"{p}rank", F.row_number().over(W.partitionBy(f"{p}source", f"{p}bucket").orderBy(*tie)) - 1)
    ranked = ranked.join(shift, [f"{p}source", f"{p}bucket"])
    placed = ranked.withColumn(f"{p}at", (F.col(f"{p}before") + F.col(f"{p}rank") + F.lit(0.5)) / F.col(f"{p}whole")).drop(f"{p}bucket", f"{p}before", f"{p}whole", f"{p}rank")
    placed = placed.withColumn(f"{p}bucket", F.least(F.floor(F.col(f"{p}at") * buckets), F.lit(buckets - 1)).cast("int"))
    whole = F.broadcast(_bucket_shift(placed, [], p))  # one row a bucket
    ordered = placed.withColumn(f"{p}rank", F.row_number().over(W.partitionBy(f"{p}bucket").orderBy(f"{p}at", f"{p}source", *tie)) - 1)
    at = ordered.join(whole, f"{p}bucket").withColumn(f"{p}place", F.col(f"{p}before") + F.col(f"{p}rank"))
    shard = F.floor(F.expr(f"({p}place * {shards}) div {p}whole"))
    # the first place of shard s is the least p with p * shards >= s * whole
    first = F.expr(f"({p}shard * {p}whole + {shards} - 1) div {shards}")
    out = at.drop("shard", "slot").withColumn(f"{p}shard", shard.cast("long")).withColumn("slot", (F.col(f"{p}place") - first).cast("long"))
    return out.withColumn("shard", F.col(f"{p}shard").cast("int")).drop(f"{p}bucket", f"{p}rank", f"{p}before", f"{p}whole", f"{p}place", f"{p}shard", f"{p}at", f"{p}order", f"{p}source")


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and text_crc32: all that the placing reads, so that texts are never shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 17) -> None:
    """Writes docs as one folder a shard, in slot order within each file."""
    text = F.coalesce("text", F.lit(""))
    measured = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", (F.octet_length(text) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = interleave(measured, shards, seed).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
