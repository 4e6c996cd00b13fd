"""Coverage of languages and the gate over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import text as X

FAN_OUT_LIMIT = 10
TOP_CALLEES = 20


def language_coverage(units: DataFrame, resolved: DataFrame, top: int = TOP_CALLEES) -> DataFrame:
    """AG10. One row a language of units (language, file, name, unit_type, code, calls).

    entities counts units; symbol_files the files with units that are no tests; resolved_files those of
    them with an import edge (resolved: source, target) to another file; max_fan_out is the greatest
    number of free functions outside test files that share a name, and its name (the least among
    equals); single_char_callees the names of one character among the top called ones.
    """
    tested = X.is_test_path(F.col("file"))
    by = units.groupBy("language").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct(F.when(~tested, F.col("file"))).alias("symbol_files"))
    files = units.where(~tested).select("language", "file").distinct()
    linked = resolved.where("source <> target").select(F.col("source").alias("file")).distinct()
    done = files.join(linked, "file", "left_semi").groupBy("language").agg(F.count(F.lit(1)).alias("resolved_files"))
    free = units.where(~tested & X.is_function_kind(F.col("unit_type")) & ~F.coalesce(X.is_method(F.col("code")), F.lit(False)))
    same = free.groupBy("language", "name").agg(F.count(F.lit(1)).alias("n"))
    fan = same.groupBy("language").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("max_fan_out_name"), F.max("n").alias("max_fan_out"))
    single = single_char_callees(units.select("language", F.explode("calls").alias("name")), top)
    rows = by.join(done, "language", "left").join(fan, "language", "left").join(single, "language", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.select("language", "entities", "symbol_files", zero("resolved_files"), "max_fan_out_name", zero("max_fan_out"), F.coalesce("single_char_callees", F.array().cast("array<string>")).alias("single_char_callees"))


def single_char_callees(calls: DataFrame, top: int = TOP_CALLEES) -> DataFrame:
    """AG10. language, single_char_callees: of the top names called (language, name), by count then name, those of one character in that order.

    Of each language the top ones are a sorted array that never grows beyond ``top`` after the names are counted.
    """
    counts = calls.groupBy("language", "name").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("language").orderBy(F.desc("n"), "name"))
    ranked = counts.withColumn("rank", rank).where(F.col("rank") <= top).where(F.char_length("name") == 1)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "name")))
    return ranked.groupBy("language").agg(F.transform(ordered, lambda x: x["name"]).alias("single_char_callees"))


def coverage_gate(rows: DataFrame, limit: int = FAN_OUT_LIMIT) -> DataFrame:
    """AG11. language, reason: a failure for a fan-out over the limit, and one for callees of one character."""
    text = lambda c: F.col(c).cast("string")
    tail = F.concat(F.lit(" (language '"), F.col("language"), F.lit("')"))

    def quoted(names: Column) -> Column:
        return F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")

    fan = F.when(
        F.col("max_fan_out") > limit,
        F.concat(F.lit("fan-out "), text("max_fan_out"), F.lit(" for bare name '"), F.coalesce("max_fan_out_name", F.lit("?")), F.lit(f"' exceeds threshold {limit}"), tail),
    )
    single = F.when(F.size("single_char_callees") > 0, F.concat(F.lit("single-character callee names in top-N callees: "), quoted(F.col("single_char_callees")), tail))
    return rows.select("language", F.explode(F.filter(F.array(fan, single), lambda x: x.isNotNull())).alias("reason"))
