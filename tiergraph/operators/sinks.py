"""Maintenance of tables: upserts, cascades, reconciliation, moves. Functions from old and new rows to rows to write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiergraph.functions import text as X


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str] | None = None, keep_old: list[str] | None = None) -> DataFrame:
    """SNK1, SNK3, SNK4, SNK5. new replaces old by keys; a null in keep_if_null and all of keep_old stay as they were."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("o__here"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n__here"))
    cond = None
    for k in keys:
        c = F.col(f"o_{k}") == F.col(f"n_{k}")
        cond = c if cond is None else cond & c
    both = o.join(n, cond, "full_outer")

    def value(c: str):
        first, second = f"n_{c}", f"o_{c}"
        if c in (keep_old or []):
            return F.coalesce(second, first).alias(c)
        if c in (keep_if_null or []) or c in keys:
            return F.coalesce(first, second).alias(c)
        return F.when(F.col("n__here").isNotNull(), F.col(first)).otherwise(F.col(second)).alias(c)

    return both.select(*[value(c) for c in old.columns])


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SNK2. The last row of each key."""
    value = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(value, F.struct(*order)).alias("r")).select("r.*")


def replace_repo(old_entities: DataFrame, old_edges: DataFrame, entities: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """SNK6. Entities upserted; the repository's edges replaced by those whose ends are both in the batch."""
    ids = entities.select("id")
    a, b = ids.select(F.col("id").alias("source_id")), ids.select(F.col("id").alias("target_id"))
    fresh = edges.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi")
    mine = old_entities.where(F.col("repo_id") == repo).select(F.col("id").alias("source_id"))
    others = old_edges.join(mine, "source_id", "left_anti")
    return upsert(old_entities, entities, ["id"], keep_if_null=["summary"]), others.unionByName(fresh.select(others.columns))


def reconcile(entities: DataFrame, edges: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK7. Files not on disk (path) go with their functions, then modules without files, then subsystems without modules, then edges of what went."""
    tier = lambda t: entities.where(F.col("tier") == t)
    files = tier("file").join(on_disk.select("path"), "path", "left_semi").select(entities.columns)
    below = lambda rows, kept: rows.join(kept.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi").select(entities.columns)
    functions = tier("function").join(files.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(entities.columns)
    modules = below(tier("module"), files)
    subsystems = below(tier("subsystem"), modules)
    kept = subsystems.unionByName(modules).unionByName(files).unionByName(functions)
    ids = kept.select("id")
    left = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return kept, left.select(edges.columns)


def subtree(entities: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """SNK8. id of roots (id) and everything below; the tiers fix the depth."""
    level = entities.select("id").join(roots.select("id"), "id", "left_semi")
    out = level
    for _ in range(depth):
        level = entities.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
        out = out.unionByName(level)
    return out.distinct()


def cascade_delete(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """SNK8. entities without the subtrees of roots."""
    return entities.join(subtree(entities, roots), "id", "left_anti").select(entities.columns)


def excluded(entities: DataFrame, paths: list[str]) -> DataFrame:
    """FIL8, SNK9. id of entities at or below an excluded path, and what hangs on them."""
    hit = F.lit(False)
    for p in paths:
        hit = hit | X.under(X.normalize_path(F.col("path")), p.rstrip("/"))
    return subtree(entities, entities.where("path is not null").where(hit).select("id"))


def delete_counts(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """SNK10. entities and relationships that go with ids."""
    known = ids.select("id").distinct()
    touched = edges.join(known.select(F.col("id").alias("source_id"), F.lit(1).alias("s")), "source_id", "left").join(known.select(F.col("id").alias("target_id"), F.lit(1).alias("t")), "target_id", "left")
    e = entities.join(known, "id", "left_semi").agg(F.count(F.lit(1)).alias("entities"))
    return e.crossJoin(touched.where("s is not null or t is not null").agg(F.count(F.lit(1)).alias("relationships")))  # one row each


def move_repo(entities: DataFrame, repo: str, project: str) -> DataFrame:
    """SNK11."""
    return entities.withColumn("project_id", F.when(F.col("repo_id") == repo, project).otherwise(F.col("project_id")))


def clear_summaries(entities: DataFrame, where) -> DataFrame:
    """SNK12. summary emptied where the condition holds (an entity, a repository, a project)."""
    return entities.withColumn("summary", F.when(where, F.lit(None)).otherwise(F.col("summary")))


def invalidate(insights: DataFrame, fresh: DataFrame) -> DataFrame:
    """SNK13. Old insights no longer valid, unless detected again; those keep their first time."""
    stale = insights.withColumn("still_valid", F.lit(False))
    return upsert(stale, fresh, ["id"], keep_old=["detected_at"])


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """SRC12. path, change (added, changed, removed) between two snapshots (path, content_hash)."""
    o, n = old.select("path", F.col("content_hash").alias("o")), new.select("path", F.col("content_hash").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def ndjson(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SNK17. One JSON object a row (value), fields in order, nulls kept."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).where("__rn = 1").drop("__rn")
