"""Traversal: dependencies, impact, blast radius, call paths, flows, bundles.

Entities have id, project_id, parent_id, tier, name, path; edges source_id, target_id, rel_type
and, where used, weight and provenance. Walks are bounded loops of joins over a frontier that only
ever holds what was newly reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiergraph.schema import DEPENDENCY_TYPES

END = ["id", "project_id", "tier", "name", "path"]
#: Rows of a frontier that are fetched, and sent to the edges, instead of being derived again in each later hop.
SMALL_FRONTIER = 20_000


def held(rows: DataFrame) -> DataFrame:
    """rows, made once: as a broadcast of at most SMALL_FRONTIER rows, or kept by the executors if there are more."""
    some = rows.limit(SMALL_FRONTIER + 1).collect()
    if len(some) > SMALL_FRONTIER:
        return rows.persist()
    return F.broadcast(rows.sparkSession.createDataFrame(some, rows.schema))


def outgoing(edges: DataFrame, entities: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """JN1, GR1. Edges of the sources ids (id) with the entity at the other end, in the same project."""
    rows = edges if ids is None else edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    end = entities.select(*[F.col(c).alias(f"other_{c}") for c in END])
    return rows.join(end, F.col("target_id") == F.col("other_id"))


def incoming(edges: DataFrame, entities: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """JN2, GR2."""
    rows = edges if ids is None else edges.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    end = entities.select(*[F.col(c).alias(f"other_{c}") for c in END])
    return rows.join(end, F.col("source_id") == F.col("other_id"))


def project_edges(edges: DataFrame, entities: DataFrame, project: str) -> DataFrame:
    """JN3, FIL6. Edges whose two ends lie in the project."""
    ids = entities.where(F.col("project_id") == project).select("id")
    return edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def resolution_signal(internal: Column, external: Column) -> dict[str, Column]:
    """GR3. Whether an empty answer can be trusted: null counts were never recorded."""
    unknown = internal.isNull() | external.isNull()
    state = F.when(unknown, "unknown").when(internal > 0, "partial").otherwise("complete")
    coverage = F.when(unknown, None).when(internal > 0, 0.0).otherwise(1.0)
    return {"state": state, "coverage": coverage.cast("double"), "caveat": F.when(internal > 0, F.concat(internal.cast("string"), F.lit(" internal imports are unresolved")))}


def impact(entities: DataFrame, edges: DataFrame, paths: DataFrame, follow_contains: bool = True) -> DataFrame:
    """GR4. kind, id of what a change of the files at paths (path) touches.

    kind: file, module, subsystem (the parents), dependent (modules and subsystems within two reverse
    hops of those over every edge type, the parents left out), caller (functions that call a function of the files).
    """
    e = edges if follow_contains else edges.where("rel_type <> 'contains'")
    changed = held(entities.where("tier = 'file'").join(paths.select("path"), "path", "left_semi").select("id", "parent_id"))
    parent = lambda df, tier: held(entities.where(F.col("tier") == tier).select("id", "parent_id").join(df.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi"))
    mods = parent(changed, "module")
    subs = parent(mods, "subsystem")
    seeds = mods.select("id").unionByName(subs.select("id"))
    tiers = entities.where("tier in ('module', 'subsystem')").select(F.col("id").alias("source_id"))
    # the few edges into the frontier first, then the tier of their sources
    into = lambda ids: e.select("source_id", "target_id").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id").distinct().join(tiers, "source_id", "left_semi").select(F.col("source_id").alias("id"))
    one = held(into(seeds))
    two = into(one)
    dependents = one.unionByName(two).distinct().join(seeds, "id", "left_anti")
    functions = entities.where("tier = 'function'").select("id", "parent_id").join(changed.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    callers = edges.where("rel_type = 'calls'").join(functions.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    return tag(changed, "file").unionByName(tag(mods, "module")).unionByName(tag(subs, "subsystem")).unionByName(tag(dependents, "dependent")).unionByName(tag(callers, "caller"))


def owning_file(entities: DataFrame) -> DataFrame:
    """JN18. id, file_id: a file owns itself, a function's file is its parent; other tiers have none."""
    file = F.when(F.col("tier") == "file", F.col("id")).when(F.col("tier") == "function", F.col("parent_id"))
    return entities.select("id", file.alias("file_id")).where("file_id is not null")


def hops(entities: DataFrame, edges: DataFrame, files: DataFrame, max_hops: int = 2, types: list[str] | None = None) -> DataFrame:
    """GR5. file_id, hop: files within max_hops reverse dependency hops of files (id) and their functions; the first hop wins."""
    owner = owning_file(entities)
    back = edges.where(F.col("rel_type").isin(types or DEPENDENCY_TYPES)).select("source_id", "target_id")
    frontier = held(owner.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id"))
    visited, reached = frontier, None
    for hop in range(1, max_hops + 1):
        new = back.join(frontier.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
        frontier = held(new.join(visited, "id", "left_anti").join(owner.select("id"), "id", "left_semi"))
        step = frontier.withColumn("hop", F.lit(hop))
        reached = step if reached is None else reached.unionByName(step)
        visited = visited.unionByName(frontier)
    out = reached.join(owner, "id").join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return out.groupBy("file_id").agg(F.min("hop").cast("bigint").alias("hop"))


def blast_radius(entities: DataFrame, edges: DataFrame, file_id: str, max_hops: int = 2, cap: int = 25) -> DataFrame:
    """GR6. file_id, hop, rel_types, omitted: files that depend on a file, nearest first, cap of them.

    Every dependency type is walked, calls are not reported; a source in no file, or in the file
    itself, ends its walk. omitted counts what the cap left out.
    """
    owner = owning_file(entities)
    back = edges.where(F.col("rel_type").isin(DEPENDENCY_TYPES)).select("source_id", "target_id", "rel_type")
    frontier = held(owner.where(F.col("file_id") == file_id).select("id"))
    visited, hits = frontier, None
    for hop in range(1, max_hops + 1):
        found = back.join(frontier.select(F.col("id").alias("target_id")), "target_id", "left_semi").join(visited.select(F.col("id").alias("source_id")), "source_id", "left_anti")
        # a source counts once, with its first type by name
        found = held(found.groupBy(F.col("source_id").alias("id")).agg(F.min("rel_type").alias("rel_type")))
        placed = held(owner.join(found, "id").where(F.col("file_id") != file_id))
        step = placed.where("rel_type <> 'calls'").select("file_id", "rel_type", F.lit(hop).alias("hop"))
        hits = step if hits is None else hits.unionByName(step)
        visited = visited.unionByName(found.select("id"))
        frontier = placed.select("id")
    files = hits.groupBy("file_id").agg(F.min("hop").cast("bigint").alias("hop"), F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("rel_types"))
    total = files.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("omitted"))
    return files.orderBy("hop", "file_id").limit(cap).crossJoin(F.broadcast(total))  # one row


def direct_dependents(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """GR7. file_id, dependents: other files with a dependency edge into the file or its functions."""
    owner = owning_file(entities)
    e = edges.where(F.col("rel_type").isin(DEPENDENCY_TYPES)).select("source_id", "target_id").distinct()
    pairs = e.join(owner.select(F.col("id").alias("source_id"), F.col("file_id").alias("src")), "source_id").join(owner.select(F.col("id").alias("target_id"), "file_id"), "target_id")
    return pairs.where("src <> file_id").groupBy("file_id").agg(F.countDistinct("src").alias("dependents"))


def call_paths(entities: DataFrame, edges: DataFrame, file_id: str) -> DataFrame:
    """GR8. direction, function_id, other_id: calls of a file's functions both ways, each once."""
    own = entities.where((F.col("tier") == "function") & (F.col("parent_id") == file_id)).select("id")
    calls = edges.where("rel_type = 'calls'")
    out = calls.join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.lit("calls").alias("direction"), F.col("source_id").alias("function_id"), F.col("target_id").alias("other_id"))
    back = calls.join(own.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.lit("called_by").alias("direction"), F.col("target_id").alias("function_id"), F.col("source_id").alias("other_id"))
    return out.unionByName(back).distinct()


def flow_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, target_id: depends_on of any tier, calls between functions."""
    f = entities.where("tier = 'function'").select("id")
    calls = edges.where("rel_type = 'calls'").join(f.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(f.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return edges.where("rel_type = 'depends_on'").select("source_id", "target_id").unionByName(calls.select("source_id", "target_id")).distinct()


def entry_points(entities: DataFrame, flow: DataFrame) -> DataFrame:
    """id: sources nothing points at, and entities named main or handle_*, or in a bin folder."""
    free = flow.select(F.col("source_id").alias("id")).distinct().join(flow.select(F.col("target_id").alias("id")), "id", "left_anti")
    named = entities.where("name = 'main' or startswith(name, 'handle_') or contains(path, '/bin/')").select("id")
    return free.unionByName(named).distinct()


def flow_reach(flow: DataFrame, entries: DataFrame, max_depth: int = 20) -> DataFrame:
    """GR9, as a set. entry_id, id, depth: what each entry reaches, at its least depth.

    The frontier keeps only (entry, node) pairs seen for the first time, so dense graphs don't
    multiply paths; the loop ends when nothing is new.
    """
    frontier = entries.select(F.col("id").alias("entry_id"), "id")
    seen = frontier.withColumn("depth", F.lit(0))
    step = flow.select(F.col("source_id").alias("id"), "target_id")
    checkpointed = not flow.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty()
    for depth in range(1, max_depth + 1):
        new = frontier.join(step, "id").select("entry_id", F.col("target_id").alias("id")).distinct()
        frontier = new.join(seen, ["entry_id", "id"], "left_anti").checkpoint() if checkpointed else new.join(seen, ["entry_id", "id"], "left_anti").persist()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen.withColumn("depth", F.col("depth").cast("bigint"))


def flow_traces(entities: DataFrame, flow: DataFrame, entries: DataFrame, max_depth: int = 20) -> DataFrame:
    """GR9, in walking order. entry_id, step, id, depth, has_cycle of a depth-first walk of each entry.

    Each entry's own subgraph goes to one group. Of the entry's own targets the last by id is walked
    first; below them, the first by id. A node is walked as often as it was pushed before it was first
    walked, and a target that was walked already marks a cycle.
    """
    reach = flow_reach(flow, entries, max_depth).select("entry_id", F.col("id").alias("source_id"))
    sub = reach.join(flow, "source_id").unionByName(entries.select(F.col("id").alias("entry_id"), F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_id")))

    def walk(key, pdf):
        import pandas as pd

        entry, targets = key[0], {}
        for a, b in zip(pdf["source_id"], pdf["target_id"]):
            if b is not None:
                targets.setdefault(a, set()).add(b)
        done, cycle, steps = {entry}, False, [(entry, 0)]
        todo = [(t, 1) for t in sorted(targets.get(entry, ()))]
        while todo:
            node, depth = todo.pop()
            if depth > max_depth:
                continue
            done.add(node)
            steps.append((node, depth))
            for t in sorted(targets.get(node, ()), reverse=True):
                if t in done:
                    cycle = True
                else:
                    todo.append((t, depth + 1))
        return pd.DataFrame({"entry_id": entry, "step": range(len(steps)), "id": [s[0] for s in steps], "depth": [s[1] for s in steps], "has_cycle": cycle})

    return sub.groupBy("entry_id").applyInPandas(walk, "entry_id string, step bigint, id string, depth bigint, has_cycle boolean")


def list_flows(flows: DataFrame, entities: DataFrame, contains: str | None = None, limit: int = 20) -> DataFrame:
    """GR10. Flows whose entry's name holds a text, by entry."""
    rows = flows.join(entities.select(F.col("id").alias("entry_id"), F.col("name").alias("entry_name")), "entry_id")
    rows = rows if contains is None else rows.where(F.lower("entry_name").contains(contains.lower()))
    return rows.orderBy("entry_id").limit(limit)


def callees(edges: DataFrame, entities: DataFrame, function_id: str) -> DataFrame:
    """GR11."""
    rows = edges.where((F.col("rel_type") == "calls") & (F.col("source_id") == function_id))
    return rows.join(entities.where("tier = 'function'").select(F.col("id").alias("target_id"), "name"), "target_id").select("target_id", "name").distinct()


def descendants(entities: DataFrame, root: str) -> DataFrame:
    """GR12. id, depth of everything below root; four tiers are three levels at most."""
    level = entities.where(F.col("parent_id") == root).select("id", F.lit(1).alias("depth"))
    out = level
    for depth in (2, 3):
        level = entities.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return out.withColumn("depth", F.col("depth").cast("bigint"))


def module_children(entities: DataFrame, per_file: int = 50) -> DataFrame:
    """GR13. file_id, function_id of the first per_file functions of each file, by name and id."""
    f = entities.where("tier = 'function'")
    rn = F.row_number().over(W.partitionBy("parent_id").orderBy("name", "id"))
    return f.withColumn("rn", rn).where(F.col("rn") <= per_file).select(F.col("parent_id").alias("file_id"), F.col("id").alias("function_id"), "rn")


def relationships_of(edges: DataFrame, entity_id: str) -> DataFrame:
    """GR14. section, other_id, rel_type: children (contains), imports (other outgoing edges) and incoming."""
    out = edges.where(F.col("source_id") == entity_id)
    section = F.when(F.col("rel_type") == "contains", "children").otherwise("imports")
    back = edges.where(F.col("target_id") == entity_id).select(F.lit("incoming").alias("section"), F.col("source_id").alias("other_id"), "rel_type")
    return out.select(section.alias("section"), F.col("target_id").alias("other_id"), "rel_type").unionByName(back)


def function_calls(edges: DataFrame, members: DataFrame) -> DataFrame:
    """GR15. id, direction, other_id, via_method: calls of a function, or of a type through its methods (owner, method)."""
    calls = edges.where("rel_type = 'calls'").select("source_id", "target_id")
    none = F.lit(None).cast("string")
    both = calls.select(F.col("source_id").alias("id"), F.lit("calls").alias("direction"), F.col("target_id").alias("other_id")).unionByName(
        calls.select(F.col("target_id").alias("id"), F.lit("called_by").alias("direction"), F.col("source_id").alias("other_id"))
    )
    via = both.join(members.select(F.col("method").alias("id"), "owner"), "id").select(F.col("owner").alias("id"), "direction", "other_id", F.col("id").alias("via_method"))
    return both.withColumn("via_method", none).unionByName(via).distinct()


def bundle_edges(entities: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """GR16. source_file, target_file pairs with an end under scope, lifted from any edge; edges within a file go."""
    from tiergraph.functions.text import under

    owner = owning_file(entities)
    e = edges.where("rel_type <> 'contains'").select("source_id", "target_id").distinct()
    lifted = e.join(owner.select(F.col("id").alias("source_id"), F.col("file_id").alias("source_file")), "source_id").join(owner.select(F.col("id").alias("target_id"), F.col("file_id").alias("target_file")), "target_id")
    inside = entities.where("tier = 'file'").where(under(F.col("path"), scope)).select("id", F.lit(True).alias("in"))
    pairs = lifted.where("source_file <> target_file").select("source_file", "target_file").distinct()
    a, b = inside.select(F.col("id").alias("source_file"), F.col("in").alias("a")), inside.select(F.col("id").alias("target_file"), F.col("in").alias("b"))
    return pairs.join(a, "source_file", "left").join(b, "target_file", "left").where("a or b").select("source_file", "target_file")


def pack_bundle(lines: DataFrame, budget: int = 24_000) -> DataFrame:
    """GR16. lines (place, text) with kept: the longest prefix whose characters, a newline each, fit the budget."""
    used = F.sum(F.char_length("text") + 1).over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))  # one bundle's lines
    return lines.withColumn("kept", used <= budget)


def false_zero(files: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """GR17. id, mentioned_by: files without an importer although other files mention them (file_id, by_id)."""
    used = edges.where("rel_type = 'imports'").select(F.col("target_id").alias("id"))
    alone = files.select("id").join(used, "id", "left_anti")
    seen = mentions.where("file_id <> by_id").groupBy(F.col("file_id").alias("id")).agg(F.countDistinct("by_id").alias("mentioned_by"))
    return alone.join(seen, "id")


def compare_resolutions(first: DataFrame, second: DataFrame) -> DataFrame:
    """GR18. verdict, n over two resolvers' answers (source_id, spec, target_id)."""
    b = second.select("source_id", "spec", F.col("target_id").alias("other"))
    both = first.join(b, ["source_id", "spec"], "full_outer")
    verdict = (
        F.when(F.col("target_id").isNull() & F.col("other").isNull(), "both_unresolved").when(F.col("target_id").isNull(), "only_second").when(F.col("other").isNull(), "only_first")
        .when(F.col("target_id") == F.col("other"), "agree").otherwise("differ")
    )
    return both.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
