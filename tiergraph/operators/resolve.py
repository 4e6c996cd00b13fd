"""Resolution joins: imports and calls to files and functions, files to subsystems.

Ordered candidates are exploded with their priority and joined by equality; the best that exists is
a minimum, so no prefix or pattern is tried row against row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import text as X

# What a specifier without an extension may stand for, in order.
EXTENSIONS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
INDEX_FILES = ["index.js", "index.ts", "index.jsx", "index.tsx", "index.mjs"]


def units_to_files(units: DataFrame, files: DataFrame) -> DataFrame:
    """JN4. units (file path) with file_id."""
    return units.join(files.select(F.col("path").alias("file"), F.col("id").alias("file_id")), "file")


# Extensions that a module key leaves out.
KEY_EXTENSIONS = [".rs", ".py", ".ts", ".js"]


def import_keys(files: DataFrame, repo: str) -> DataFrame:
    """JN5. key, file_id: the path of each file, crate::a::b and repo::a::b for src/a/b.rs and src/a/b/mod.rs.

    A path counts before a module key of the same text; among equal module keys the least file id counts.
    """
    bare = F.regexp_replace("path", r"^src/", "")
    for e in KEY_EXTENSIONS:
        bare = F.when(F.regexp_replace("path", r"^src/", "").endswith(e), F.regexp_replace(F.regexp_replace("path", r"^src/", ""), f"\\{e}\\z", "")).otherwise(bare)
    module = F.replace(F.regexp_replace(bare, r"/mod\z", ""), F.lit("/"), F.lit("::"))
    key = lambda how, c: F.struct(F.lit(how).alias("how"), c.alias("key"))
    named = [key(1, F.when(module != "", F.concat(F.lit(f"{head}::"), module))) for head in ("crate", repo)]
    keyed = files.select(F.col("id").alias("file_id"), F.explode(F.array(key(0, F.col("path")), *named)).alias("k")).where("k.key is not null")
    return keyed.groupBy("k.key").agg(F.min_by("file_id", F.struct("k.how", "file_id")).alias("file_id"))


def segments_prefixes(spec: Column, sep: str) -> Column:
    """All prefixes of spec by whole segments, longest last."""
    parts = F.split(spec, f"\\Q{sep}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def longest_prefix(rows: DataFrame, keys: DataFrame, spec: str, sep: str) -> DataFrame:
    """JN6, JN15. rows with target and matched: the longest whole-segment prefix of spec among keys (key, target)."""
    prefixes = rows.select("row_id", F.explode(segments_prefixes(F.col(spec), sep)).alias("key")).distinct()
    best = prefixes.join(keys, "key").groupBy("row_id").agg(F.max_by(F.struct("target", "key"), F.char_length("key")).alias("best"))
    return rows.join(best, "row_id", "left").select(*rows.columns, F.col("best.target").alias("target"), F.col("best.key").alias("matched"))


def rust_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """JN7. row_id, target of imports (row_id, importing, spec) that begin with super:: or self::.

    The importing file's module is its path below src, a mod.rs being its folder's and lib.rs the crate's
    root; each leading super is a step up, none above the root. What follows names an item, so the target
    is that module's own file: src/a/b.rs, else src/a/b/mod.rs, and src/lib.rs for the root.
    """
    bare = F.regexp_replace("importing", r"^src/", "")
    for e in KEY_EXTENSIONS:
        bare = F.when(F.regexp_replace("importing", r"^src/", "").endswith(e), F.regexp_replace(F.regexp_replace("importing", r"^src/", ""), f"\\{e}\\z", "")).otherwise(bare)
    segments = F.filter(F.split(bare, "/"), lambda p: p != "")
    own = F.when(F.element_at(segments, -1) == "mod", F.slice(segments, 1, F.size(segments) - 1)).otherwise(segments)
    own = F.when((F.size(own) == 1) & (own[0] == "lib"), F.array().cast("array<string>")).otherwise(own)
    ups = F.size(F.split(F.regexp_extract("spec", r"^((?:super::)*(?:super\z)?)", 1), "super")) - 1
    some = imports.where("startswith(spec, 'super::') or startswith(spec, 'self::')").select("row_id", own.alias("own"), ups.alias("ups")).where("ups <= size(own)")
    path = F.array_join(F.slice("own", 1, F.size("own") - F.col("ups")), "/")
    tried = F.when(path == "", F.array(F.lit("src/lib.rs"))).otherwise(F.array(F.concat(F.lit("src/"), path, F.lit(".rs")), F.concat(F.lit("src/"), path, F.lit("/mod.rs"))))
    found = some.select("row_id", F.posexplode(tried).alias("priority", "path")).join(files.select("path", F.col("id").alias("target")), "path")
    return found.groupBy("row_id").agg(F.min_by("target", "priority").alias("target"))


def candidates(base: Column) -> Column:
    """JN9. base itself, with an extension, as a folder's index; in order."""
    return F.array(base, *[F.concat(base, F.lit(e)) for e in EXTENSIONS + [f"/{i}" for i in INDEX_FILES]])


def alias_bases(spec: Column, aliases: list[tuple[str, list[str]]]) -> Column:
    """What the aliases (key, targets; one configuration file's) make of a specifier, in order.

    A key that is the specifier counts alone; else the longest key with a star whose ends the specifier
    has, the last by name among equally long ones; what the star stands for goes into each target.
    """
    out = F.array().cast("array<string>")
    for key, targets in sorted((a for a in aliases if "*" in a[0]), key=lambda a: (len(a[0]), a[0])):
        before, after = key.split("*", 1)
        middle = F.substring(spec, F.lit(len(before) + 1), F.char_length(spec) - len(before) - len(after))
        made = [F.concat(F.lit(t.split("*", 1)[0]), middle, F.lit(t.split("*", 1)[1])) if "*" in t else F.lit(t) for t in targets]
        out = F.when(spec.startswith(before) & spec.endswith(after) & (F.char_length(spec) >= len(before) + len(after)), F.array(*made)).otherwise(out)
    for key, targets in aliases:
        out = F.when(spec == key, F.array(*[F.lit(t) for t in targets])).otherwise(out)
    return out


def js_imports(imports: DataFrame, files: DataFrame, js: dict) -> DataFrame:
    """JN8, JN10. row_id, target of imports (row_id, importing, spec); js: aliases, packages, declared names and source roots.

    Tried in order: the alias bases; then for ./ and ../ the place from the importing file, for / the
    place from the root, and for bare names the workspace package of the first segment, then the source
    roots unless the first segment is a declared dependency. A base is tried by its candidates; if the
    first that is there is no JavaScript file, there is no target by that base.
    """
    spec = F.col("spec")
    relative = spec.startswith("./") | spec.startswith("../")
    absolute = spec.startswith("/") & ~spec.startswith("//")
    bare = ~spec.startswith(".") & ~absolute & ~relative
    package = F.substring_index(spec, "/", 1)
    rest = F.substring(spec, F.char_length(package) + 1, F.char_length(spec))
    folders = F.create_map(*[F.lit(x) for kv in js["packages"].items() for x in kv]) if js["packages"] else F.lit(None).cast("map<string,string>")
    roots = F.array(*[F.concat(F.lit(f"{r}/"), spec) for r in js["roots"]]).cast("array<string>")
    after = (
        F.when(relative, F.array(X.join_relative(F.col("importing"), spec)))
        .when(absolute, F.array(spec))
        .when(bare & (package != ""), F.concat(F.when(folders[package].isNotNull(), F.array(F.concat(folders[package], rest))).otherwise(F.array()), F.when(package.isin(js["declared"]), F.array()).otherwise(roots)))
        .otherwise(F.array().cast("array<string>"))
    )
    bases = F.concat(alias_bases(spec, js["aliases"]), after)
    tried = imports.select("row_id", F.posexplode(bases).alias("kind", "base")).withColumn("base", X.join_relative(F.lit(""), F.col("base"))).where("base <> ''")
    tried = tried.select("row_id", "kind", F.posexplode(candidates(F.col("base"))).alias("priority", "path"))
    known = tried.join(files.select("path", F.col("id").alias("target")), "path")
    is_js = F.regexp_like("path", F.lit("(" + "|".join(e.replace(".", "[.]") for e in EXTENSIONS) + r")\z"))
    first = known.groupBy("row_id", "kind").agg(F.min_by(F.when(is_js, F.col("target")), "priority").alias("target"))
    return first.where("target is not null").groupBy("row_id").agg(F.min_by("target", "kind").alias("target"))


def unique_key(rows: DataFrame, key: str, target: str) -> DataFrame:
    """JN11, JN12. key, target of the keys that have one target only."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(target).alias(target), F.max(target).alias("__most")).where(F.col(target) == F.col("__most")).drop("__most")


def call_targets(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """JN14. source_id, target_id: a call (source_id, name) to every function (id, name) of that name but itself."""
    return calls.join(functions.select(F.col("id").alias("target_id"), "name"), "name").where("source_id <> target_id").select("source_id", "target_id").distinct()


def unit_functions(units: DataFrame, functions: DataFrame) -> DataFrame:
    """JN13. units with function_id, by name and file."""
    return units.join(functions.select("name", F.col("parent_id").alias("file"), F.col("id").alias("function_id")), ["name", "file"])


def module_path(path: Column, depth: int) -> Column:
    """JN16. The first depth folders of a path."""
    folders = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    return F.array_join(F.slice(folders, 1, depth), "/")


def cross_repo(imports: DataFrame, subsystems: DataFrame) -> DataFrame:
    """JN17. source_id, target_id, weight: imports (subsystem_id, spec) whose first :: segment names another subsystem (id, name)."""
    named = imports.select(F.col("subsystem_id").alias("source_id"), X.crate_name(F.split_part("spec", F.lit("::"), F.lit(1))).alias("name"))
    s = subsystems.select(F.col("id").alias("target_id"), X.crate_name(F.col("name")).alias("name"))
    return named.join(s, "name").where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def find_indexed(requested: DataFrame, files: DataFrame) -> DataFrame:
    """JN23. request, id: the file at that path, else the only file of that base name."""
    exact = requested.join(files.select(F.col("path").alias("request"), F.col("id").alias("exact")), "request", "left")
    only = unique_key(files.select(X.basename(F.col("path")).alias("base"), "id"), "base", "id").withColumnRenamed("id", "only")
    return exact.withColumn("base", X.basename(F.col("request"))).join(only, "base", "left").select("request", F.coalesce("exact", "only").alias("id"))


def paths_to_ids(paths: DataFrame, files: DataFrame) -> DataFrame:
    """JN19."""
    return files.join(paths.select("path").distinct(), "path", "left_semi").select("path", "id")
