"""Project documents: discovery, relevance, reading."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.functions import text as X
from tiergraph.operators.ranking import budget_groups

MAX_DEPTH = 10
READ_CAP = 1 << 20
TOTAL_BUDGET = 200_000
FOLDERS = ["docs", "doc", "design", "adr"]


def discover(spark: SparkSession, root: str) -> DataFrame:
    """SRC16. path, size, modified, content of markdown at the root and, to a depth of ten, in the document folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown}").load(root)
    clean = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = "/" + re.sub(r"^[a-z]+:/+", "/", root).strip("/") + "/"
    rel = F.substring(clean, F.lit(len(base) + 1), F.char_length(clean))
    rows = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content"))
    top = ~F.col("path").contains("/")
    deep = F.substring_index("path", "/", 1).isin(FOLDERS) & (F.size(F.split("path", "/")) <= MAX_DEPTH + 1)
    return rows.where(top | deep)


def relevance() -> dict[str, int]:
    """Scores by words of the path: what a reader needs first."""
    return {"readme": 100, "architecture": 90, "design": 70, "adr": 60, "contributing": 50, "security": 40, "guide": 30}


def scored(docs: DataFrame) -> DataFrame:
    """RK9. docs with relevance, the highest score of a word in the path, 10 without one."""
    low = F.lower("path")
    return docs.withColumn("relevance", F.greatest(F.lit(10), *[F.when(low.contains(w), s).otherwise(0) for w, s in relevance().items()]))


def select_within_budget(docs: DataFrame, budget: int = TOTAL_BUDGET) -> DataFrame:
    """RK9. taken and state of each document: most relevant first, then newest, then by path."""
    one = scored(docs).withColumn("__all", F.lit(1))  # one project's documents
    return budget_groups(one, "__all", "size", [F.desc("relevance"), F.desc("modified"), "path"], budget).drop("__all")


def structured(docs: DataFrame) -> DataFrame:
    """DC1. path and the summary fields of each document, of the first mebibyte."""
    text = F.substring(F.col("content").cast("string"), 1, READ_CAP)
    return docs.select("path", text.alias("text")).select("path", *[c.alias(k) for k, c in X.doc_summary(F.col("text")).items()])


def read_text(docs: DataFrame, path: str) -> str | None:
    """DC1. One document's text, cut at a mebibyte."""
    row = docs.where(F.col("path") == X.safe_scope(path)).select(F.substring(F.col("content").cast("string"), 1, READ_CAP)).first()
    return row[0] if row else None
