"""Helpers shared by the training-data operators: shared storage, checkpoints, word pattern."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured, a local one if all runs in one process (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or "/tmp/checkpoints/tiergraph").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root; the folder is deleted when the program ends."""
    path = f"{shared_root(spark)}/tiergraph/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if Spark still runs."""
    with contextlib.suppress(Exception):  # the session may have ended
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; Spark deletes it once the result is unreachable."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def restart(df: DataFrame) -> DataFrame:
    """cut_lineage without what Spark guesses of the result's size.

    A checkpoint keeps the guess of the plan that it cuts off, the product of a join's sides. Where
    results are joined with themselves over and over, its digits double with each join: a few rounds
    later they fill the driver's memory. The new frame has the stored rows and a guess of fixed length.
    """
    kept, session = cut_lineage(df), df.sparkSession
    rows = kept._jdf.queryExecution().analyzed().rdd()
    return type(kept)(session._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), session)


#: Bytes that one side of a join may have to be broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 24 << 20


def sized(rows: DataFrame, width: int | Column) -> DataFrame:
    """rows, stored, and marked for broadcast only if their bytes, counted by ``width`` a row, are within BROADCAST_BYTES."""
    kept = cut_lineage(rows)
    size = kept.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    return F.broadcast(kept) if size <= BROADCAST_BYTES else kept.hint("merge")


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Returns a worker's unused memory to the system: workers stay for later stages, and share an executor's memory with them."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_prefix(columns: list[str]) -> str:
    """Underscores with which no column's name begins."""
    p = "__"
    while any(c.startswith(p) for c in columns):
        p += "_"
    return p


def lower_ascii(col):
    """Lower-case A-Z only, so that results do not depend on a Unicode version."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
