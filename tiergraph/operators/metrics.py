"""Size and complexity metrics of files, modules and subsystems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ["lines", "code_units", "complexity_sum", "has_branches_count", "has_loops_count", "has_error_handling_count"]


def file_metrics(units: DataFrame) -> DataFrame:
    """AG4. Metrics of each file (column file) from its units."""
    n = F.count(F.lit(1))
    return units.groupBy("file").agg(
        F.sum(F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(0))).alias("lines"),
        n.alias("code_units"),
        F.sum("complexity").alias("complexity_sum"),
        F.max("complexity").alias("complexity_max"),
        (F.sum("complexity") / n).alias("complexity_avg"),
        F.count_if("has_branches").alias("has_branches_count"),
        F.count_if("has_loops").alias("has_loops_count"),
        F.count_if("has_error_handling").alias("has_error_handling_count"),
    )


def fill_zero(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """AG5. Every file of files (id, parent_id) with its metrics; those without units have zeros."""
    names = [c for c in metrics.columns if c != "file"]
    joined = files.join(metrics, files["id"] == metrics["file"], "left")
    return joined.select(files["id"], files["parent_id"], *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def _average() -> Column:
    return F.when(F.sum("code_units") > 0, F.sum("complexity_sum") / F.sum("code_units")).otherwise(0.0)


def roll_up(children: DataFrame, count_as: str, also: list[str] | None = None) -> DataFrame:
    """AG7, AG8. Metrics of each parent_id: sums, the largest maximum, the average over units, and children counted."""
    aggs = [F.sum(c).alias(c) for c in [*SUMS, *(also or [])]]
    return children.where("parent_id is not null").groupBy("parent_id").agg(
        *aggs, F.max("complexity_max").alias("complexity_max"), _average().alias("complexity_avg"), F.count(F.lit(1)).alias(count_as)
    )


def most_common(rows: DataFrame, by: str, value: str) -> DataFrame:
    """AG18. The most frequent value of each group, the first by name among equals."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def hotspots(rows: DataFrame, n: int, tie: str = "id", tier: str | None = None) -> DataFrame:
    """RK4, RK5. The n most complex rows."""
    rows = rows if tier is None else rows.where(F.col("tier") == tier)
    return rows.orderBy(F.desc("complexity"), F.asc(tie)).limit(n)


def complexity_of(text: Column, field: str = "complexity_max") -> Column:
    """SF14. A numeric JSON field, 0 if missing, not JSON, or not a number (a string of digits is none)."""
    value = F.try_variant_get(F.try_parse_json(text), f"$.{field}", "variant")
    name = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.when(name.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL.*)$"), number).otherwise(0.0)
