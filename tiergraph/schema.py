"""Table schemas and the fixed vocabularies of the graph."""

from __future__ import annotations

SCHEMA_VERSION = 1
TIERS = ["subsystem", "module", "file", "function"]
REL_TYPES = ["contains", "depends_on", "imports", "calls", "implements"]
#: Edges that say one thing needs another.
DEPENDENCY_TYPES = ["imports", "calls", "depends_on", "implements"]
PROVENANCE_RANK = {"heuristic": 0, "resolved": 1}
SEVERITIES = ["critical", "high", "medium", "low"]

METRIC_FIELDS = [
    "lines", "code_units", "complexity_sum", "complexity_max", "has_branches_count", "has_loops_count",
    "has_error_handling_count", "fan_in", "fan_out", "module_count", "file_count",
]


# Schemas as DDL text, which readers and createDataFrame take.
METRICS = ", ".join(f"{f} bigint" for f in METRIC_FIELDS) + ", complexity_avg double"
EVIDENCE = "struct<source_file: string, source_line: bigint, source_end_line: bigint, import_path: string, source_function: string, caller_line: bigint, callee_name: string>"

PROJECTS = "id string, name string, description string, output_dirs array<string>, created_at timestamp, updated_at timestamp"
REPOSITORIES = (
    "id string, project_id string, name string, local_path string, git_url string, default_branch string, last_analyzed_commit string, index_path string, "
    "summarization_unconfigured string, unresolved_internal bigint, unresolved_external bigint, created_at timestamp, updated_at timestamp"
)
ENTITIES = (
    "id string, project_id string, repo_id string, tier string, parent_id string, name string, path string, language string, summary string, summary_commit string, "
    f"metrics struct<{METRICS.replace(' ', ': ').replace(',: ', ', ')}>, created_at timestamp, updated_at timestamp"
)
RELATIONSHIPS = f"source_id string, target_id string, rel_type string, weight double, evidence array<{EVIDENCE}>, provenance string"
INSIGHTS = "id string, project_id string, category string, severity string, title string, description string, entity_ids array<string>, still_valid boolean, detected_at timestamp"
CONVENTIONS = "id string, project_id string, category string, pattern string, description string, confidence double, evidence array<string>, detected_at timestamp"
ANALYSIS_RUNS = "id string, repo_id string, commit_hash string, status string, entities bigint, relationships bigint, error string, started_at timestamp, finished_at timestamp"
FILE_HASHES = "repo_id string, file_path string, content_hash string"
CODE_UNITS = (
    "name string, unit_type string, file string, line bigint, end_line bigint, language string, signature string, code string, docstring string, parent_class string, "
    "calls array<string>, imports array<string>, complexity bigint, has_branches boolean, has_loops boolean, has_error_handling boolean, qualified_name string"
)
