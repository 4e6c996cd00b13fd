"""RF1 to RF3. Building and refreshing a project's graph.

Units of changed files replace the old ones; everything above is computed from the whole unit
table, so an incremental refresh gives what a full one gives.
"""

from __future__ import annotations

import datetime
import subprocess
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.errors import Busy
from tiergraph.functions import text as X
from tiergraph.operators import detect as D
from tiergraph.operators import edges as E
from tiergraph.operators import graph as G
from tiergraph.operators import grouping as P
from tiergraph.operators import metrics as M
from tiergraph.operators import sinks as K
from tiergraph.plans.store import Store
from tiergraph.sources import config as C
from tiergraph.sources import extract as S
from tiergraph.sources import directory as Y
from tiergraph.sources import manifests as R

CONFIG_NAMES = ["tiergraph.yml", "tiergraph.yaml", "tiergraph.json"]


@dataclass(frozen=True)
class RefreshStats:
    added: int
    changed: int
    removed: int
    entities: int
    relationships: int


def head_commit(path: str) -> str | None:
    """SRC12. The checkout's commit; none where there is no git or no repository."""
    try:
        out = subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return out.stdout.strip() or None


def snapshot(store: Store, repo_id: str, files: DataFrame) -> DataFrame:
    """SRC12. Changes of files against the stored hashes."""
    old = store.read("file_hashes").where(F.col("repo_id") == repo_id).select(F.col("file_path").alias("path"), "content_hash")
    return K.snapshot_diff(old, files.select("path", "content_hash"))


def is_stale(store: Store, project: str) -> bool:
    """RF1. A repository never analysed, at another commit, or, without commits, with changed files."""
    for r in store.repos(project).collect():  # repositories of one project
        if r.last_analyzed_commit is None:
            return True
        head = head_commit(r.local_path)
        if head is not None and head != r.last_analyzed_commit:
            return True
        if head is None and not snapshot(store, r.id, S.scan(store.spark, r.local_path)).isEmpty():
            return True
    return False


def _root_texts(store: Store, root: str) -> dict[str, str]:
    """Texts of the manifest and settings files at a repository's root, a handful of small files, and of package.json files below."""
    names = "{Gemfile,pyproject.toml,requirements.txt,package.json,composer.json,go.mod,pom.xml,build.gradle*,mix.exs,*.csproj,Package.swift,Cargo.toml,tsconfig.json,jsconfig.json,pnpm-workspace.yaml,webpacker.yml,shakapacker.yml,tiergraph.*}"
    files = store.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    base = "/" + root.strip("/") + "/"
    clean = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    rel = F.substring(clean, F.lit(len(base) + 1), F.char_length(clean)).alias("name")
    rows = files.where(F.col("length") <= R.CAP).select(rel, F.col("content").cast("string").alias("text"))
    rows = rows.where(~F.col("name").rlike(r"(^|/)(\.[^/]*|node_modules|vendor|target)/"))
    return {r.name: r.text for r in rows.collect()}


def lock(store: Store, project: str) -> str:
    """RF3. Takes the project's lock file, or says that a refresh is under way."""
    p = store._path(f"{store.root}/locks/{project}")
    if not store._fs.createNewFile(p):
        raise Busy(f"project {project!r} is being refreshed")
    return f"locks/{project}"


def unlock(store: Store, name: str) -> None:
    store._fs.delete(store._path(f"{store.root}/{name}"), False)


def refresh(store: Store, project: str, full: bool = False) -> RefreshStats:
    """RF2. Brings every repository of a project up to date, then its insights and conventions."""
    held = lock(store, project)
    try:
        stats = [analyze_repo(store, r, full) for r in store.repos(project).collect()]  # repositories of one project
        link_across(store, project)
        detect(store, project)
        return RefreshStats(*(sum(getattr(s, f) for s in stats) for f in ("added", "changed", "removed", "entities", "relationships")))
    finally:
        store.clear_scratch()
        unlock(store, held)


def analyze_repo(store: Store, repo, full: bool = False) -> RefreshStats:
    spark = store.spark
    started = datetime.datetime.now()
    texts = _root_texts(store, repo.local_path)
    settings = next((C.parse(texts[n]) for n in CONFIG_NAMES if n in texts), C.RepoConfig())
    files = S.scan(spark, repo.local_path, settings.exclude)
    if settings.languages:
        files = files.where(F.col("language").isin(settings.languages))
    diff = store.settle(snapshot(store, repo.id, files))  # not cached: Spark would take a later scan of the same folder for this one
    changes = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}  # three kinds
    mine = F.col("repo_id") == repo.id
    if not changes and not full:
        n = store.read("entities").where(mine).count()
        store.update_repo(repo.id, last_analyzed_commit=head_commit(repo.local_path) or "files")
        return RefreshStats(0, 0, 0, n, 0)
    old_units = store.read("code_units")
    todo = files if full else files.join(diff.where("change <> 'removed'").select("path"), "path", "left_semi")
    fresh = S.code_units(todo).withColumn("repo_id", F.lit(repo.id))
    keep = old_units.where(mine & F.lit(not full)).join(diff.select(F.col("path").alias("file")), "file", "left_anti").select(old_units.columns)
    units_all = old_units.where(~mine).unionByName(keep).unionByName(fresh.select(old_units.columns))
    hashes = store.read("file_hashes").where(~mine).unionByName(files.select(F.lit(repo.id).alias("repo_id"), F.col("path").alias("file_path"), "content_hash"))
    store.publish(code_units=units_all, file_hashes=hashes)
    units = store.read("code_units").where(mine).drop("repo_id")
    paths = [r[0] for r in store.read("file_hashes").where(mine).select("file_path").collect()]  # one repository's file names
    paths += Y.package_files(spark, repo.local_path)
    folders, depth, _ = R.detect_subsystems(repo.name, texts, [*paths, *texts])
    folders = settings.subsystems or folders
    subs = spark.createDataFrame(list(folders.items()) or [(".", repo.name)], "folder string, name string")
    scanned = files.select("path", "language")
    placed = store.settle(P.place_files(P.file_paths(units, scanned, settings.exclude), subs, settings.module_depth or depth))
    rid = repo.id.replace("/", "-").replace(":", "-")
    tiers = P.entities(placed, subs, repo.project_id, rid).withColumn("repo_id", F.lit(repo.id))
    tiers = store.settle(tiers)
    tests = store.settle(cfg_tests(files))
    funs = (P.functions(units, tiers, tests) if settings.preserve_function_entities else tiers.limit(0))
    funs = store.settle(funs)
    js = R.js_config(texts, R.workspace_members(texts, [*paths, *texts]), [*paths, *texts])
    resolved = P.resolved_imports(units, tiers, repo.name, js, store.settle)
    edges = store.settle(P.relationships(units, tiers, funs, resolved, store.settle))  # read by metrics, flows and the write
    batch = tiers.unionByName(funs)
    e_old, r_old = store.read("entities"), store.read("relationships")
    wide = batch.select(*[F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in e_old.dtypes])
    wide = wide.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    gone = e_old.where(mine).join(batch.select("id"), "id", "left_anti").select("id")
    kept_old = e_old.join(gone, "id", "left_anti").select(e_old.columns)
    entities = K.upsert(kept_old, wide, ["id"], keep_if_null=["summary", "summary_commit"], keep_old=["created_at"])
    ids = e_old.where(mine).select("id").unionByName(batch.select("id")).distinct()
    others = r_old.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(r_old.columns)
    fresh_edges = E.drop_dangling(edges, batch)
    fresh_edges = fresh_edges.select(*[F.col(c) if c in fresh_edges.columns else F.lit(None).cast(t).alias(c) for c, t in r_old.dtypes])
    metrics = tier_metrics(units, tiers, edges)
    m_old = store.read("metrics").join(ids, "id", "left_anti")
    complexity = funs.select("id", "name", "path").join(units.select("name", F.col("file").alias("path"), "complexity"), ["name", "path"]).groupBy("id").agg(F.max("complexity").alias("complexity"))
    flow = store.settle(G.flow_edges(batch, edges))
    flows = G.flow_traces(batch, flow, store.settle(G.entry_points(batch, flow))).withColumn("repo_id", F.lit(repo.id))
    f_old = store.read("flows").where(~mine)
    store.publish(
        entities=entities,
        relationships=others.unionByName(fresh_edges),
        metrics=m_old.unionByName(metrics.withColumn("project_id", F.lit(repo.project_id)).select(m_old.columns)),
        functions_complexity=store.read("functions_complexity").join(ids, "id", "left_anti").unionByName(complexity),
        flows=f_old.unionByName(flows.select(f_old.columns)),
        inline_tests=store.read("inline_tests").where(~mine).unionByName(tests.select(F.lit(repo.id).alias("repo_id"), "file").distinct()),
    )
    left = P.unresolved_counts(units, resolved, tiers, js).first()
    store.update_repo(repo.id, last_analyzed_commit=head_commit(repo.local_path) or "files", unresolved_internal=left.internal, unresolved_external=left.external)
    n_e, n_r = store.read("entities").where(mine).count(), store.read("relationships").count()
    store.record_run({"id": uuid.uuid4().hex, "repo_id": repo.id, "commit_hash": head_commit(repo.local_path), "status": "completed", "entities": n_e, "relationships": n_r, "started_at": started, "finished_at": datetime.datetime.now()})
    return RefreshStats(changes.get("added", 0), changes.get("changed", 0), changes.get("removed", 0), n_e, n_r)


def cfg_tests(files: DataFrame) -> DataFrame:
    """SRC13. file, name of functions compiled for tests only."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, n) for p, c in zip(pdf["path"], pdf["content"]) for n in S.cfg_test_functions(bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["file", "name"])

    return files.where("language = 'Rust'").select("path", "content").mapInPandas(run, "file string, name string")


def tier_metrics(units: DataFrame, tiers: DataFrame, edges: DataFrame) -> DataFrame:
    """AG4 to AG8. Metrics of files, modules and subsystems, with coupling."""
    files = tiers.where("tier = 'file'").select("id", "parent_id", "path")
    own = M.file_metrics(units.where("unit_type <> 'file_imports_marker'"))
    by_id = own.join(files.select(F.col("path").alias("file"), "id"), "file").drop("file").withColumnRenamed("id", "file")
    f = M.fill_zero(files.select("id", "parent_id"), by_id)
    parents = tiers.select("id", "parent_id")
    m = M.roll_up(f, "file_count").withColumnRenamed("parent_id", "id").join(parents, "id")
    s = M.roll_up(m, "module_count", ["file_count"]).withColumnRenamed("parent_id", "id")
    fans = E.coupling(edges, ["imports", "calls", "depends_on"])
    zero = lambda df, tier, missing: df.withColumns({c: F.lit(0) for c in missing} | {"tier": F.lit(tier)})
    all_ = zero(f.drop("parent_id"), "file", ["file_count", "module_count"]).unionByName(zero(m.drop("parent_id"), "module", ["module_count"])).unionByName(zero(s, "subsystem", []))
    return all_.join(fans, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("fan_in", "fan_out", "file_count", "module_count")})


def link_across(store: Store, project: str) -> None:
    """JN17, JN22. depends_on between subsystems of different repositories of a project."""
    e, r = store.read("entities").where(F.col("project_id") == project), store.read("relationships")
    subs = e.where("tier = 'subsystem'").select("id", "name", "repo_id")
    if subs.select("repo_id").distinct().count() < 2:
        return
    from tiergraph.operators.resolve import cross_repo

    files = e.where("tier = 'file'").select(F.col("path").alias("file"), "repo_id", F.col("parent_id").alias("mid"))
    mods = e.where("tier = 'module'").select(F.col("id").alias("mid"), F.col("parent_id").alias("subsystem_id"))
    imports = store.read("code_units").select("repo_id", "file", F.explode("imports").alias("spec")).join(files, ["repo_id", "file"]).join(mods, "mid").select("subsystem_id", "spec")
    found = E.drop_dangling(cross_repo(imports, subs), subs).withColumns({"rel_type": F.lit("depends_on"), "provenance": F.lit("heuristic"), "evidence": F.lit(None).cast(dict(r.dtypes)["evidence"])})
    keys = ["source_id", "target_id", "rel_type"]
    store.publish(relationships=r.join(found.select(keys), keys, "left_anti").select(r.columns).unionByName(found.select(r.columns)))


def detect(store: Store, project: str) -> None:
    """IN1 to IN6, CV1 to CV3, SNK3, SNK4, SNK13. Insights and conventions of a project; old insights are invalid unless found again."""
    e = store.settle(store.read("entities").where(F.col("project_id") == project))
    m = store.read("metrics").where(F.col("project_id") == project)
    r = G.project_edges(store.read("relationships"), e, project)
    name = e.select("id", "name")
    files = m.where("tier = 'file'").select("id", F.col("complexity_max").cast("double").alias("value"))
    funs = store.read("functions_complexity").join(e.select("id"), "id", "left_semi").select("id", F.col("complexity").cast("double").alias("value"))
    mods = m.where("tier = 'module'").select("id", F.col("file_count").alias("files"))
    r = store.settle(r)
    fans = E.coupling(r.where("rel_type <> 'contains'"))
    coupled = e.where("tier = 'module'").select("id").join(fans, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    inside = store.read("inline_tests").select("repo_id", F.col("file").alias("path"), F.lit(True).alias("inline"))
    held = e.where("tier = 'module'").select(F.col("id").alias("module"), F.col("name").alias("module_name"))
    tests = e.where("tier = 'file'").select("id", F.col("parent_id").alias("module"), "repo_id", "path", "language").join(held, "module").join(inside, ["repo_id", "path"], "left")

    def rows(found: DataFrame, category: str, title: str, text) -> DataFrame:
        return found.join(name, "id").select(
            F.concat_ws(":", F.lit(project), F.lit("insight"), F.lit(category), "id").alias("id"), F.lit(project).alias("project_id"), F.lit(category).alias("category"), "severity",
            F.concat(F.lit(title + ": "), "name").alias("title"), text.alias("description"), F.array("id").alias("entity_ids"), F.lit(True).alias("still_valid"), F.current_timestamp().alias("detected_at"),
        )

    ratio = F.format_string("%.1f times the mean", F.col("ratio"))
    found = rows(D.hotspots(files), "complexity_hotspot", "Complexity hotspot", ratio)
    found = found.unionByName(rows(D.hotspots(funs), "function_hotspot", "Complex function", ratio))
    found = found.unionByName(rows(D.coupling_insights(coupled), "high_coupling", "High coupling", F.format_string("%s is in the top %d%% of modules (rank %d of %d)", "axis", "pct", "rank", "total")))
    gaps = D.coverage_gaps(tests).withColumnRenamed("module", "id")
    found = found.unionByName(rows(gaps, "coverage_gap", "Low test coverage", F.format_string("%d test file(s) and %d of other folders, out of %d file(s)", "direct", "across", "files")))
    found = found.unionByName(rows(D.god_modules(mods), "god_module", "Oversized module", F.format_string("%d files, %.1f times the mean", F.col("files"), F.col("ratio"))))
    rust = e.where("tier = 'file'").agg(D.rust_share(e).alias("s")).first().s
    if (rust or 0) <= 0.5:
        depends = r.where("rel_type = 'depends_on'").join(e.where("tier = 'module'").select(F.col("id").alias("source_id")), "source_id", "left_semi")
        loops = D.cycles(depends.select("source_id", "target_id"))
        found = found.unionByName(
            loops.select(
                F.concat_ws(":", F.lit(project), F.lit("insight"), F.lit("circular_dependency"), "nodes").alias("id"), F.lit(project).alias("project_id"), F.lit("circular_dependency").alias("category"), F.lit("high").alias("severity"),
                F.concat(F.lit("Circular dependency of "), F.col("length").cast("string"), F.lit(" modules")).alias("title"), F.col("nodes").alias("description"), F.split("nodes", ",").alias("entity_ids"), F.lit(True).alias("still_valid"), F.current_timestamp().alias("detected_at"),
            )
        )
    found = store.settle(found)
    old = store.read("insights")
    here = F.col("project_id") == project
    insights = old.where(~here).unionByName(K.invalidate(old.where(here), found.select(old.columns)))
    names = e.where("tier in ('function', 'module')").select("name")
    paths = e.where("tier = 'file'").select("path")

    def convention(df: DataFrame, category: str, title) -> DataFrame:
        return df.select(F.lit(f"conv-{project}-{category}").alias("id"), F.lit(project).alias("project_id"), F.lit(category).alias("category"), title.alias("pattern"), F.lit(None).cast("string").alias("description"), F.col("confidence").cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("evidence"), F.current_timestamp().alias("detected_at"))

    c_old = store.read("conventions")
    new = convention(D.naming_convention(names).where("title <> 'none'"), "naming", F.col("title")).unionByName(convention(D.test_layout(paths), "testing", F.col("layout"))).unionByName(convention(D.directory_depth(paths), "structure", F.col("title")))
    conventions = K.upsert(c_old, new.select(c_old.columns), ["id"], keep_old=["detected_at"])
    store.publish(insights=insights, conventions=conventions)


def reconcile(store: Store, repo_id: str) -> dict[str, int]:
    """SNK7. Drops what is no longer on disk."""
    repo = store.repo(repo_id)
    e, r = store.read("entities"), store.read("relationships")
    mine = F.col("repo_id") == repo_id
    kept, _ = K.reconcile(e.where(mine), r, S.scan(store.spark, repo.local_path))
    gone = store.settle(e.where(mine).join(kept.select("id"), "id", "left_anti").select("id"))
    n = gone.count()
    edges = r.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(r.columns)
    store.publish(entities=e.join(gone, "id", "left_anti").select(e.columns), relationships=edges)
    store.clear_scratch()
    return {"entities_removed": n}
