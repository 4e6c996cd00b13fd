"""Entities from code units: files, modules, subsystems, functions, and the edges between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.errors import InvalidInput
from tiergraph.functions import text as X
from tiergraph.operators import edges as E
from tiergraph.operators import resolve as V

MAX_ID = 512
EVIDENCE_FIELDS = ["source_file", "source_line", "source_end_line", "import_path", "source_function", "caller_line", "callee_name"]


def entity_id(project: str, repo: str, tier: str, path: Column) -> Column:
    """project:repo:tier:path, with a normalised path, 512 bytes at most."""
    if ":" in project or ":" in repo:
        raise InvalidInput("project and repository names may not contain ':'")
    full = F.concat(F.lit(f"{project}:{repo}:{tier}:"), X.normalize_path(path))
    return F.when(F.octet_length(full) <= MAX_ID, full).otherwise(F.concat(F.lit(f"{project}:{repo}:{tier}:sha-"), F.sha2(path, 256)))


def function_id(file_id: Column, name: Column) -> Column:
    """One id a name and file: functions of the same name in a file are one entity."""
    return F.concat(F.lit("fn-"), F.substring(F.sha2(F.concat_ws("\u0000", file_id, name), 256), 1, 16))


def file_paths(units: DataFrame, scanned: DataFrame, exclude: list[str]) -> DataFrame:
    """GP1. path, language of units' files and scanned ones (path, language), without excluded paths."""
    both = units.select(F.col("file").alias("path"), "language").unionByName(scanned.select("path", "language"))
    files = both.where(F.col("path").isNotNull()).groupBy("path").agg(F.min("language").alias("language"))
    for p in exclude:
        files = files.where(~X.under(F.col("path"), p.strip("/")))
    return files


def place_files(files: DataFrame, subsystems: DataFrame, depth: int) -> DataFrame:
    """GP2, JN15, JN16. files with subsystem (longest folder of subsystems (folder, name) that holds them, else '.') and module path."""
    rows = files.withColumn("row_id", F.col("path"))
    keys = subsystems.where("folder <> '.'").select(F.col("folder").alias("key"), F.col("folder").alias("target"))
    placed = V.longest_prefix(rows, keys, "path", "/").withColumn("subsystem", F.coalesce("target", F.lit(".")))
    inner = F.when(F.col("subsystem") == ".", F.col("path")).otherwise(F.substring(F.col("path"), F.char_length("subsystem") + 2, F.char_length("path")))
    below = V.module_path(inner, depth)
    module = F.when(below == "", F.col("subsystem")).when(F.col("subsystem") == ".", below).otherwise(F.concat("subsystem", F.lit("/"), below))
    return placed.select("path", "language", "subsystem", module.alias("module"))


def entities(placed: DataFrame, subsystems: DataFrame, project: str, repo: str) -> DataFrame:
    """GP1 to GP3. File, module and subsystem entities with parents and languages."""
    sub_id, mod_id = entity_id(project, repo, "subsystem", F.col("subsystem")), entity_id(project, repo, "module", F.col("module"))
    names = subsystems.select(F.col("folder").alias("subsystem"), F.col("name").alias("subsystem_name"))

    def rows(df: DataFrame, tier: str, id_: Column, parent: Column, name: Column, path: Column, language: Column) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(project).alias("project_id"), F.lit(repo).alias("repo_id"), F.lit(tier).alias("tier"), parent.alias("parent_id"), name.alias("name"), path.alias("path"), language.alias("language"))

    none = F.lit(None).cast("string")
    files = rows(placed, "file", entity_id(project, repo, "file", F.col("path")), mod_id, X.basename(F.col("path")), F.col("path"), F.col("language"))
    lang = F.mode("language", deterministic=True)
    mods = placed.groupBy("subsystem", "module").agg(lang.alias("language"))
    modules = rows(mods, "module", mod_id, sub_id, X.basename(F.col("module")), F.col("module"), F.col("language"))
    subs = placed.groupBy("subsystem").agg(lang.alias("language")).join(names, "subsystem", "left")
    subs = rows(subs, "subsystem", sub_id, none, F.coalesce("subsystem_name", F.lit(repo)), F.col("subsystem"), F.col("language"))
    return subs.unionByName(modules).unionByName(files)


def functions(units: DataFrame, files: DataFrame, test_functions: DataFrame) -> DataFrame:
    """GP8. Function entities of the preservable units of files, without test files' and test functions (file, name)."""
    kept = units.where(X.is_preservable(F.col("unit_type")) & ~X.is_test_path(F.col("file"))).join(test_functions, ["file", "name"], "left_anti")
    f = files.where("tier = 'file'").select(F.col("id").alias("file_id"), F.col("path").alias("file"), "project_id", "repo_id")
    rows = kept.join(f, "file").groupBy(function_id(F.col("file_id"), F.col("name")).alias("id"), "project_id", "repo_id", F.col("file_id").alias("parent_id"), "name", F.col("file").alias("path"))
    return rows.agg(F.min("language").alias("language")).select("id", "project_id", "repo_id", F.lit("function").alias("tier"), "parent_id", "name", "path", "language")


def contains(rows: DataFrame) -> DataFrame:
    """Hits of contains edges from parents."""
    return rows.where("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("rel_type"), F.lit("resolved").alias("provenance"))


def resolved_imports(units: DataFrame, files: DataFrame, repo: str, js: dict, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """JN4 to JN10. importing, spec, language, target (a file's id, or null) of every import that units name, each once.

    JavaScript: ordered candidates. Rust: a key, else super and self from the importing file, else the
    longest key that leading :: segments make. Other languages: a key, else such segments.
    """
    f = files.where("tier = 'file'").select("id", "path")
    raw = units.select(F.col("file").alias("importing"), "language", F.explode("imports").alias("spec")).distinct()
    rows = settle(raw.withColumn("row_id", F.xxhash64("importing", "language", "spec")))
    is_js = F.col("language").isin("JavaScript", "TypeScript")
    a = V.js_imports(rows.where(is_js), f, js)
    keys = V.import_keys(f, repo).withColumnRenamed("file_id", "target")
    near = (F.col("language") == "Rust") & (F.col("spec").startswith("super::") | F.col("spec").startswith("self::"))
    exact = rows.where(~is_js & near).join(keys.withColumnRenamed("key", "spec"), "spec").select("row_id", "target")
    b = V.rust_relative(rows.where(near).join(exact.select("row_id"), "row_id", "left_anti"), f)
    c = V.longest_prefix(rows.where(~is_js & ~near), keys, "spec", "::").where("target is not null").select("row_id", "target")
    found = settle(a).unionByName(exact).unionByName(settle(b)).unionByName(settle(c))
    return settle(rows.join(found, "row_id", "left").drop("row_id"))


def import_hits(units: DataFrame, files: DataFrame, resolved: DataFrame) -> DataFrame:
    """JN4 to JN12. imports hits between the files of units: one a unit and import that resolves, one a unit and call that names a file.

    A call (JavaScript's aside) names the only file of that stem, mod left out, else the only file that
    defines a function of that name; such hits are heuristic. A file is no hit of itself.
    """
    f = files.where("tier = 'file'").select(F.col("path").alias("file"), F.col("id").alias("file_id"))
    source = units.join(f, "file").withColumnRenamed("file_id", "source_id")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    targets = resolved.where("target is not null").select(F.col("importing").alias("file"), "language", F.col("spec").alias("import_path"), F.col("target").alias("target_id"))
    by_import = source.withColumn("import_path", F.explode("imports")).join(targets, ["file", "language", "import_path"])
    by_import = by_import.select("source_id", "target_id", F.lit("imports").alias("rel_type"), F.lit("resolved").alias("provenance"), F.col("file").alias("source_file"), F.col("line").alias("source_line"), F.col("end_line").alias("source_end_line"), "import_path", text.alias("source_function"), number.alias("caller_line"), text.alias("callee_name"))
    stem = F.regexp_replace(X.basename(F.col("file")), r"(?<=.)\.[^.]*$", "")
    stems = V.unique_key(f.select(stem.alias("callee"), "file_id").where("callee not in ('', 'mod')"), "callee", "file_id").select("callee", F.col("file_id").alias("by_stem"))
    defined = source.select(F.explode(F.array("name", "qualified_name")).alias("callee"), "source_id").distinct()
    owners = V.unique_key(defined, "callee", "source_id").select("callee", F.col("source_id").alias("by_name"))
    calls = source.where(~F.col("language").isin("JavaScript", "TypeScript")).withColumn("callee", F.explode("calls"))
    calls = calls.join(stems, "callee", "left").join(owners, "callee", "left").withColumn("target_id", F.coalesce("by_stem", "by_name")).where("target_id is not null")
    by_call = calls.select("source_id", "target_id", F.lit("imports").alias("rel_type"), F.lit("heuristic").alias("provenance"), F.col("file").alias("source_file"), number.alias("source_line"), number.alias("source_end_line"), text.alias("import_path"), text.alias("source_function"), F.col("line").alias("caller_line"), F.col("callee").alias("callee_name"))
    return by_import.unionByName(by_call).where("source_id <> target_id")


def unresolved_counts(units: DataFrame, resolved: DataFrame, files: DataFrame, js: dict) -> DataFrame:
    """AG9. internal, external: imports of units without a target, one row.

    Internal ones are relative, or bare JavaScript names whose first segment is a folder in a source root and no declared dependency.
    """
    spec = F.col("spec")
    first = F.substring_index(spec, "/", 1)
    paths = files.where("tier = 'file'").select("path")
    below = None
    for r in js["roots"]:
        some = paths.where(F.col("path").startswith(f"{r}/") & F.substring("path", len(r) + 2, 1 << 20).contains("/")).select(F.split_part(F.substring("path", len(r) + 2, 1 << 20), F.lit("/"), F.lit(1)).alias("first"))
        below = some if below is None else below.unionByName(some)
    left = units.select("file", "language", F.explode("imports").alias("spec")).join(resolved.where("target is null").select(F.col("importing").alias("file"), "language", "spec"), ["file", "language", "spec"])
    is_js = F.col("language").isin("JavaScript", "TypeScript")
    near = spec.startswith(".") | (~is_js & (spec.startswith("super::") | spec.startswith("self::") | spec.isin("super", "self")))
    if below is not None:
        known = below.distinct().withColumn("rooted", F.lit(True))
        left = left.withColumn("first", first).join(F.broadcast(known), "first", "left")  # top folders of source roots
        near = near | (is_js & ~spec.startswith("/") & ~first.isin(js["declared"]) & F.coalesce("rooted", F.lit(False)))
    return left.agg(F.count_if(near).alias("internal"), F.count_if(~near).alias("external"))


def function_hits(units: DataFrame, functions_: DataFrame, resolved: DataFrame) -> DataFrame:
    """JN13, JN14. calls hits from each function to all functions of a called name but itself, and its imports hits to files.

    Units are those that functions came from: of function kinds, outside test files; a test function has no entity.
    A name that very many functions share is called in all of them, as the graph wants it.
    """
    some = units.where(X.is_function_kind(F.col("unit_type")) & ~X.is_test_path(F.col("file")))
    own = V.unit_functions(some, functions_.select("id", "name", F.col("path").alias("parent_id"))).withColumnRenamed("function_id", "source_id")
    called = own.select("source_id", F.explode("calls").alias("callee_name"), F.col("file").alias("source_file"), F.col("line").alias("caller_line"))
    calls = called.join(functions_.select(F.col("id").alias("target_id"), F.col("name").alias("callee_name")), "callee_name").where("source_id <> target_id")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    calls = calls.select("source_id", "target_id", F.lit("calls").alias("rel_type"), F.lit("heuristic").alias("provenance"), "source_file", number.alias("source_line"), number.alias("source_end_line"), text.alias("import_path"), F.col("source_id").alias("source_function"), "caller_line", "callee_name")
    targets = resolved.where("target is not null").select(F.col("importing").alias("file"), "language", F.col("spec").alias("import_path"), F.col("target").alias("target_id"))
    file_of = functions_.select(F.col("id").alias("source_id"), F.col("parent_id").alias("own_file"))
    imports = own.withColumn("import_path", F.explode("imports")).join(targets, ["file", "language", "import_path"]).join(file_of, "source_id").where("target_id <> own_file")
    imports = imports.select("source_id", "target_id", F.lit("imports").alias("rel_type"), F.lit("resolved").alias("provenance"), F.col("file").alias("source_file"), F.col("line").alias("source_line"), number.alias("source_end_line"), "import_path", F.col("source_id").alias("source_function"), number.alias("caller_line"), text.alias("callee_name"))
    return calls.unionByName(imports)


def relationships(units: DataFrame, tiers: DataFrame, functions_: DataFrame, resolved: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All edges of a repository: contains, imports, the depends_on roll-ups of files' imports, then what functions call and import.

    settle may store what several branches read.
    """
    imports = settle(E.aggregate(import_hits(units, tiers, resolved), EVIDENCE_FIELDS))
    owners = tiers.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")).where("parent is not null")
    mods = settle(E.lift(imports, owners))
    subs = E.lift(mods, owners)
    depends = lambda df: df.select("source_id", "target_id", F.lit("depends_on").alias("rel_type"), "weight", F.lit("resolved").alias("provenance"))
    holds = E.aggregate(contains(tiers.unionByName(functions_)))
    of_functions = E.aggregate(function_hits(units, functions_, resolved), EVIDENCE_FIELDS)
    return holds.unionByName(imports, allowMissingColumns=True).unionByName(depends(mods), allowMissingColumns=True).unionByName(depends(subs), allowMissingColumns=True).unionByName(of_functions, allowMissingColumns=True)
