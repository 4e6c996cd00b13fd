"""SNK16, SNK17. Small results for people, and for machines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tiergraph.operators.sinks import ndjson

FIELDS = {
    "entities": ["id", "tier", "name", "path", "language", "summary", "parent_id"],
    "relationships": ["source_id", "target_id", "rel_type", "weight", "provenance"],
    "insights": ["id", "category", "severity", "title", "description", "entity_ids", "detected_at"],
    "conventions": ["id", "category", "pattern", "confidence"],
    "impact": ["kind", "id"],
}


def lines(rows: DataFrame, kind: str) -> list[str]:
    """NDJSON of a result that is small by its query's limits."""
    return [r.value for r in ndjson(rows, FIELDS[kind]).collect()]


def plain(rows: DataFrame, columns: list[str] | None = None, width: int = 60) -> str:
    """An aligned table of a small result."""
    columns = columns or rows.columns
    cells = [[*columns], *[["" if v is None else str(v)[:width] for v in r] for r in rows.select(*columns).collect()]]
    size = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    out = ["  ".join(v.ljust(n) for v, n in zip(r, size)).rstrip() for r in cells]
    return "\n".join([out[0], "  ".join("-" * n for n in size), *out[1:]]) if len(out) > 1 else "nothing found"
