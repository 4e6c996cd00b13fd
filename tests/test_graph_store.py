"""Registration, refresh, queries and maintenance over stored tables."""

import json

import pytest
from sample import FILES, WEB, write

from tiergraph import cli, output
from tiergraph.api import open_graph
from tiergraph.errors import Busy, Conflict, InvalidInput, NotFound, StaleIndex
from tiergraph.plans import refresh as RF
from tiergraph.plans import summarize as SU


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("graph")
    small = {"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"}  # compiling costs more than running here
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    g = open_graph(spark, f"file://{base}/store")
    g.create_project("demo")
    g.rust = write(base / "rusty", FILES)
    g.web = write(base / "web", WEB)
    g.rust_id = g.add_repo(g.rust)
    g.web_id = g.add_repo(g.web)
    g.first = g.ensure_fresh()
    yield g
    for k, v in before.items():
        spark.conf.set(k, v)


def edges(graph, kind):
    e = {r.id: r.path if r.tier != "function" else f"{r.path}#{r.name}" for r in graph.entities().collect()}
    return {(e[r.source_id], e[r.target_id]) for r in graph.relationships().where(f"rel_type = '{kind}'").collect()}


def test_projects(graph):
    with pytest.raises(Conflict):
        graph.create_project("demo")
    assert graph.create_project("demo", if_absent=True) == "demo" == graph.project()
    with pytest.raises(NotFound):
        graph.project("other")
    assert graph.add_repo(graph.rust) == graph.rust_id


def test_tiers(graph):
    rows = graph.entities().collect()
    by = {(r.tier, r.path): r for r in rows if r.repo_id == graph.rust_id}
    assert {p for t, p in by if t == "subsystem"} == {"core", "tools/cli"}
    assert by["file", "core/src/lib.rs"].parent_id == by["module", "core/src"].id
    assert by["module", "core/src"].parent_id == by["subsystem", "core"].id
    names = {r.name for r in rows if r.tier == "function"}
    assert {"start", "open", "step", "main", "run", "helper"} <= names and "checks_open" not in names and "runs" not in names


def test_imports_resolve(graph):
    got = edges(graph, "imports")
    assert {("core/src/lib.rs", "core/src/store.rs"), ("core/src/store.rs", "core/src/walk.rs"), ("src/app/index.ts", "src/lib/helper.ts"), ("src/app/index.ts", "src/ui/button.tsx"), ("src/only/imports.js", "src/lib/helper.ts")} <= got


def test_calls_and_flows(graph):
    got = edges(graph, "calls")
    assert ("core/src/lib.rs#start", "core/src/store.rs#open") in got and ("tools/cli/src/main.rs#main", "core/src/store.rs#open") in got
    flows = graph.store.read("flows").collect()
    entry = graph.entities(tier="function").where("name = 'start'").first().id
    assert [(r.step, r.depth) for r in sorted((r for r in flows if r.entry_id == entry), key=lambda r: r.step)][0] == (0, 0)
    assert "main" in {r.entry_name for r in graph.flows(limit=100).collect()}


def test_metrics_add_up(graph):
    m = {r.id: r for r in graph.store.read("metrics").collect()}
    e = graph.entities().collect()
    for tier, below in (("module", "file"), ("subsystem", "module")):
        for x in e:
            if x.tier == tier:
                kids = [m[c.id] for c in e if c.parent_id == x.id and c.tier == below]
                for f in ("lines", "code_units", "complexity_sum"):
                    assert m[x.id][f] == sum(k[f] for k in kids)
                assert m[x.id].complexity_max == max(k.complexity_max for k in kids)


def test_questions(graph):
    assert graph.search("store").count() >= 1
    with pytest.raises(InvalidInput):
        graph.search("x")
    assert graph.explore("where is the store opened?").first().path == "core/src/store.rs"
    store = graph.entity_by_path(graph.rust_id, "core/src/store.rs")
    hit = {r.kind for r in graph.impact(["core/src/store.rs"]).collect()}
    assert {"file", "module", "subsystem", "caller"} <= hit
    files = {r.file_id for r in graph.blast_radius(store.id).collect()}
    assert graph.entity_by_path(graph.rust_id, "core/src/lib.rs").id in files
    assert graph.bundle("core").count() >= 2
    with pytest.raises(ValueError):
        graph.bundle("../x")
    assert graph.hotspots(limit=3).count() == 3
    assert graph.doctor()["entities"] != "absent"
    with pytest.raises(NotFound):
        graph.entity("none")


def test_vectors(graph):
    with pytest.raises(StaleIndex):
        graph.semantic_search("x")
    graph.build_vectors()
    assert graph.semantic_search("fn step while").first().name == "step"


def test_insights_and_conventions(graph):
    rows = graph.insights().collect()
    assert all(r.still_valid for r in rows) and {"coverage_gap"} <= {r.category for r in rows}
    assert {r.category for r in graph.conventions().collect()} <= {"naming", "testing", "structure"}


def test_incremental_is_full(graph, tmp_path):
    again = graph.ensure_fresh()
    assert (again.added, again.changed, again.removed) == (0, 0, 0)
    from pathlib import Path

    assert not graph.is_stale()
    Path(graph.web, "src/lib/helper.ts").write_text("export function helper(x) { return renamed(x); }\nexport function renamed(y) { return y; }\n")
    Path(graph.web, "go/helper.go").unlink()
    Path(graph.web, "src/lib/extra.ts").write_text("import './helper';\nexport function extra() { helper(1); }\n")
    assert graph.is_stale()
    stats = graph.ensure_fresh()
    assert (stats.added, stats.changed, stats.removed) == (1, 1, 1)
    state = lambda: (sorted((r.id, r.parent_id, r.path) for r in graph.entities().collect()), sorted(tuple(r)[:4] for r in graph.relationships().select("source_id", "target_id", "rel_type", "weight").collect()), sorted(map(tuple, graph.store.read("metrics").collect())))
    one = state()
    assert "renamed" in {r.name for r in graph.entities(tier="function").collect()} and "other" not in {r.name for r in graph.entities(tier="function").collect()}
    graph.ensure_fresh(full=True)
    assert state() == one


def test_lock(graph):
    held = RF.lock(graph.store, "demo")
    with pytest.raises(Busy):
        graph.ensure_fresh()
    RF.unlock(graph.store, held)


def test_reconcile(graph):
    from pathlib import Path

    Path(graph.web, "go/main.go").unlink()
    n = RF.reconcile(graph.store, graph.web_id)["entities_removed"]
    left = {r.path for r in graph.entities(tier="file").collect()}
    assert n >= 2 and "go/main.go" not in left


def test_directory_tools(graph):
    listed = graph.list_directory(graph.rust_id, "core/src")
    assert [e["path"] for e in listed] == ["lib.rs", "store.rs", "walk.rs"] and all(e["indexed"] for e in listed)
    assert {e["path"] for e in graph.list_directory(graph.rust_id)} >= {"core/", "tools/", "README.md"}
    file = graph.entity_by_path(graph.rust_id, "core/src/walk.rs")
    assert graph.read_file(file.id)["content"] == FILES["core/src/walk.rs"]
    with pytest.raises(InvalidInput):
        graph.read_file(graph.entities(tier="module").first().id)
    with pytest.raises(NotFound):
        graph.read_file("none")


def test_output(graph, capsys):
    rows = output.lines(graph.entities(tier="subsystem"), "entities")
    assert list(json.loads(rows[0])) == output.FIELDS["entities"] and json.loads(rows[0])["parent_id"] is None
    assert output.plain(graph.insights(category="none")) == "nothing found"
    args = cli.parser().parse_args(["--root", "x", "--json", "subsystems"])
    cli.run(graph, args)
    assert json.loads(capsys.readouterr().out.split("\n")[0])["tier"] == "subsystem"
    assert json.loads(NotFound("gone").envelope()) == {"error": {"code": "not_found", "message": "gone"}}


def test_summaries(graph):
    e = graph.entities(tier="function").select("repo_id", "id", "name", "path")
    u = graph.store.read("code_units").select("name", "file", "code")
    rows = e.join(u, (e.path == u.file) & (e.name == u.name)).select("repo_id", "id", e.name, "code")
    got = SU.summarize_functions(rows, SU.first_sentence_client, 400)
    assert got.where("summary is not null").count() == rows.count()

    def silent(prompts):
        raise RuntimeError

    assert SU.outcome(SU.summarize_functions(rows, silent, 400)).first().asDict() == {"summarized": 0, "missing": rows.count()}
    with_text = graph.entities().join(got.withColumnRenamed("summary", "s"), "id", "left").withColumn("summary", SU.F.coalesce("s", "summary"))
    up = {r.id: r for r in SU.roll_up(with_text, "file", SU.first_sentence_client).collect()}
    assert any(r.summary for r in up.values()) and {r.skipped for r in up.values()} <= {None, "no_children", "children_without_summaries"}


def test_moves_and_deletes(graph):
    graph.create_project("second")
    graph.link_repo(graph.web_id, "second")
    assert graph.entities("second").count() > 0 and graph.entities("demo").where(f"repo_id = '{graph.web_id}'").count() == 0
    with pytest.raises(Conflict):
        graph.store.relocate(graph.web_id, graph.rust)
    graph.store.relocate(graph.web_id, graph.web + "-moved")
    assert graph.store.repo(graph.web_id).local_path.endswith("-moved")
    gone = graph.store.delete_project("second")
    assert gone["entities"] > 0 and graph.store.read("entities").where("project_id = 'second'").count() == 0
    assert graph.store.vacuum("entities") > 0 and graph.entities("demo").count() > 0
