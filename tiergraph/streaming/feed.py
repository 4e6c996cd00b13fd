"""An extension: a stream of changed files that keeps the hash table and event counts up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """path, content_hash of files as they appear below root."""
    from tiergraph.sources.extract import LANGUAGES

    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").option("maxFilesPerTrigger", per_trigger).load(root)
    return rows.select("path", "modificationTime", F.sha2("content", 256).alias("content_hash"))


def on_change(stream: DataFrame, checkpoint: str, react: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs react on each batch's last state of every path; a batch seen again has the same number, so react can skip it."""

    def batch(df: DataFrame, number: int) -> None:
        react(df.groupBy("path").agg(F.max_by("content_hash", "modificationTime").alias("content_hash")), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(spark: SparkSession, folder: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; what is later than the watermark allows is dropped."""
    rows = spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
