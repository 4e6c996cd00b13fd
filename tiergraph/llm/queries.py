"""The driver's queries over the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.llm import op01_orc_tokens as op1
from tiergraph.llm import op02_string_tiling as op2
from tiergraph.llm import op03_warc_fixity as op3
from tiergraph.llm import op04_nb_svm as op4
from tiergraph.llm import op05_simhash_pivots as op5
from tiergraph.llm import op06_best_fit as op6
from tiergraph.llm import op07_rule_ledger as op7
from tiergraph.llm import op08_line_dedup as op8
from tiergraph.llm import op09_license_rules as op9
from tiergraph.llm import op10_interleave as op10
from tiergraph.llm.common import scratch_path, table
from tiergraph.llm.sql import SQL


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python: fewer rows a batch keep its memory small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def op1_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = scratch_path(spark, "tokens")
    op1.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return op1.token_digest(spark, path)


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op2.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica, written as WARC files, against the pages: a replica that lost and changed some records by a fixed rule."""
    small_batches(spark)
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    op3.write_warc(spoiled_replica(pages), path)
    return op3.audit(op3.leaves(pages), op3.read_warc(spark, path))


def spoiled_replica(pages: DataFrame) -> DataFrame:
    """pages as a replica with damage: by a hash of the id, about 1 in 256 has other vowels, and as many are lost."""
    mark = F.sha2(F.col("page_id").cast("string"), 256)
    kept = pages.where(F.coalesce(~mark.startswith("ab"), F.lit(True)))
    return kept.withColumn("html", F.when(mark.startswith("00"), F.translate("html", "aeiou", "eioua")).otherwise(F.col("html")))


def op4_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = op4.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return op4.score(docs, model).select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = op5.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op6.pack(table(spark, sf_dir, "documents"), scratch_path(spark, "pieces"), tokenizer_path(), capacity=2048, end_id=0)


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op7.apply_policy(op7.stored(op7.ledger(table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "only_rule")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_exact", "n_near", "text")


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.scan(table(spark, sf_dir, "documents"))


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op10.interleave(op10.slim(table(spark, sf_dir, "documents")), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_orc_tokens,
            op2_string_tiling,
            op3_warc_fixity,
            op4_nb_svm,
            op5_simhash_pivots,
            op6_best_fit,
            op7_rule_ledger,
            op8_line_dedup,
            op9_license_rules,
            op10_interleave,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
