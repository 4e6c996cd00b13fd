"""Edges: aggregation of hits, roll-up between tiers, coupling, resolution counts, census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["source_id", "target_id", "rel_type"]


def provenance_rank() -> Column:
    return F.when(F.col("provenance") == "resolved", 1).otherwise(0)


def aggregate(hits: DataFrame, evidence: list[str] | None = None) -> DataFrame:
    """AG1. One edge a (source, target, type): weight counts hits, the best provenance stays, self edges go.

    With evidence, those columns of every hit are kept, sorted.
    """
    aggs = [F.count(F.lit(1)).cast("double").alias("weight"), F.when(F.max(provenance_rank()) == 1, "resolved").otherwise("heuristic").alias("provenance")]
    if evidence:
        aggs.append(F.array_sort(F.collect_list(F.struct(*evidence))).alias("evidence"))
    return hits.where("source_id <> target_id").groupBy(*KEY).agg(*aggs)


def lift(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """AG2, AG3. Weights summed between the owners (child, parent) of both ends; edges within one owner go.

    Edges are summed a source owner and target first, so the second join reads fewer rows.
    """
    a, b = owners.select(F.col("child").alias("source_id"), F.col("parent").alias("__from")), owners.select(F.col("child").alias("target_id"), F.col("parent").alias("__to"))
    half = edges.join(a, "source_id").groupBy("__from", "target_id").agg(F.sum("weight").alias("weight"))
    return half.join(b, "target_id").where("__from <> __to").groupBy(F.col("__from").alias("source_id"), F.col("__to").alias("target_id")).agg(F.sum("weight").alias("weight"))


def coupling(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """AG6. id, fan_in, fan_out: edge rows, not weights, of the given types."""
    rows = edges.where(F.col("rel_type").isin(types)) if types else edges
    ends = rows.select(F.explode(F.array(F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def unresolved_class(spec: Column, internal_prefixes: list[str], declared: Column | None = None) -> Column:
    """SF15. internal if the specifier starts like the repository's own, else external."""
    own = F.lit(False)
    for p in internal_prefixes:
        own = own | spec.startswith(p)
    known = F.lit(False) if declared is None else declared
    return F.when(own & ~known, "internal").otherwise("external")


def unresolved_counts(imports: DataFrame, known: DataFrame, internal_prefixes: list[str]) -> DataFrame:
    """AG9. unresolved_internal, unresolved_external: imports (spec) without a match in known (spec)."""
    left = imports.join(known.select("spec").distinct(), "spec", "left_anti")
    kind = unresolved_class(F.col("spec"), internal_prefixes)
    return left.agg(F.count_if(kind == "internal").alias("unresolved_internal"), F.count_if(kind == "external").alias("unresolved_external"))


def census(edges: DataFrame) -> DataFrame:
    """AG12. Distinct pairs by provenance: resolved, heuristic only, and both together."""
    pairs = edges.where("rel_type = 'imports'").groupBy("source_id", "target_id").agg(F.max(provenance_rank()).alias("best"))
    return pairs.agg(F.count_if(F.col("best") == 1).alias("resolved"), F.count_if(F.col("best") == 0).alias("heuristic_only"), F.count(F.lit(1)).alias("all_pairs"))


def wrong_edge_rate(samples: DataFrame) -> DataFrame:
    """AG13. Share of samples with evidence (has_evidence) that are not verified; 0 without any."""
    n, bad = F.count_if(F.col("has_evidence")), F.count_if(F.col("has_evidence") & ~F.col("verified"))
    return samples.agg(n.alias("evidenced"), bad.alias("wrong"), F.round(F.when(n > 0, bad / n).otherwise(0.0), 6).alias("wrong_edge_rate"))


def sample_edges(pairs: DataFrame, n: int = 0) -> DataFrame:
    """RK11. Distinct pairs in order, the first n of them (0: all)."""
    rows = pairs.select("source_id", "target_id").distinct()
    return rows.orderBy("source_id", "target_id").limit(n) if n else rows


def drop_dangling(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """JN22, SNK6. Edges whose two ends are both among ids (id)."""
    known = ids.select("id").distinct()
    return edges.join(known.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(known.select(F.col("id").alias("target_id")), "target_id", "left_semi")
