"""Every catalogue query against its SQL in DuckDB, and the operators' boundaries."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tiergraph.functions import text as X
from tiergraph.operators import detect as D
from tiergraph.operators import graph as G
from tiergraph.operators import ranking as R
from tiergraph.operators import resolve as V
from tiergraph.operators import sinks as K
from tiergraph.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    if name in SQL:
        ran = duck.execute(SQL[name])
        names = [d[0] for d in ran.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted([tuple(plain(r[i]) for i in at) for r in ran.fetchall()], key=str)
    else:
        assert got


def vals(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hotspot_boundaries(spark):
    rows = spark.createDataFrame([("a", 0.0), ("b", 10.0), ("c", 15.0), ("d", 20.0), ("e", 30.0), ("f", 40.0), ("g", 41.0)] + [(f"z{k}", 0.0) for k in range(9)], "id string, value double")
    mean = rows.agg(F.avg("value")).first()[0]
    got = {r.id: r.severity for r in D.hotspots(rows).collect()}
    want = {}
    for i, v in rows.collect():
        q = v / mean
        if v > 0 and q >= 1.5:
            want[i] = "critical" if q > 4 else "high" if q > 3 else "medium" if q > 2 else "low"
    assert got == want


@pytest.mark.parametrize(("files", "tests", "want"), [(10, 0, "high"), (11, 1, "medium"), (10, 1, None), (1, 1, None)])
def test_coverage_boundaries(spark, files, tests, want):
    rows = [(str(k), "m", "m", f"src/test_{k}.rs" if k < tests else f"src/a{k}.rs", "Rust", False) for k in range(files)]
    df = spark.createDataFrame(rows, "id string, module string, module_name string, path string, language string, inline boolean")
    assert [r.severity for r in D.coverage_gaps(df).collect()] == ([want] if want else [])


def test_coverage_of_other_folders_and_languages(spark):
    rows = [
        ("1", "auth", "auth", "src/auth/login.rs", "Rust", False), ("2", "users", "users", "src/users/people.rs", "Rust", False), ("3", "inner", "inner", "src/inner/a.rs", "rust", True),
        ("4", "conf", "conf", "conf/a.yml", "YAML", False), ("5", "t", "t", "tests/auth_flow_test.rs", "Rust", False), ("6", "t", "t", "tests/people_test.rs", "Rust", False), ("7", "mod", "mod", "src/mod/b.rs", "Rust", False), ("8", "t", "t", "tests/mod_test.rs", "Rust", False),
    ]
    df = spark.createDataFrame(rows, "id string, module string, module_name string, path string, language string, inline boolean")
    assert {r.module: r.severity for r in D.coverage_gaps(df).collect()} == {"mod": "high"}  # three letters attribute nothing


def walk_brute(edges):
    """Cycles as a recursive walk closes them."""
    out_of = {}
    for a, b in sorted(set(edges)):
        out_of.setdefault(a, []).append(b)
    done, found = set(), set()

    def go(a, path):
        for b in out_of.get(a, []):
            if b in path:
                found.add(tuple(sorted(path[path.index(b) :])))
            elif b not in done:
                go(b, [*path, b])
        done.add(a)

    for a in sorted({x for e in edges for x in e}):
        if a not in done:
            go(a, [a])
    return sorted(found)


def test_cycles_of_any_length(spark):
    import random

    long = [(f"n{k:02}", f"n{(k + 1) % 20:02}") for k in range(20)]
    got = D.cycles(spark.createDataFrame([*long, ("z", "n00"), ("q", "q")], "source_id string, target_id string")).collect()
    assert [(r.nodes, r.length) for r in got] == [(",".join(f"n{k:02}" for k in range(20)), 20)]
    rng = random.Random(3)
    for _ in range(200):
        edges = [(a, b) for a, b in ((rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(rng.randrange(14))) if a != b]
        assert [tuple(c) for c in D.back_edge_cycles(edges)] == walk_brute(edges)


def test_blast_quirks(spark):
    e = spark.createDataFrame([(i, "p", p, t, i, i) for i, p, t in [("f1", "m", "file"), ("f2", "m", "file"), ("f3", "m", "file"), ("f4", "m", "file"), ("m", None, "module"), ("a", "f1", "function"), ("b", "f2", "function")]], "id string, project_id string, parent_id string, tier string, name string, path string")
    r = spark.createDataFrame([("b", "a", "calls"), ("f3", "b", "imports"), ("m", "f1", "depends_on"), ("f4", "m", "depends_on"), ("f3", "f1", "imports"), ("f3", "f1", "implements")], "source_id string, target_id string, rel_type string")
    got = vals(G.blast_radius(e, r, "f1"))
    assert got == [("f3", 1, "implements", 0)]  # f2 is reached by calls alone, f4 through a module
    assert vals(G.hops(e, r, spark.createDataFrame([("f1",)], "id string"))) == [("f2", 1), ("f3", 1)]


def js_of(aliases=(), packages=None, declared=(), roots=()):
    return {"aliases": list(aliases), "packages": packages or {}, "declared": list(declared), "roots": list(roots)}


def test_flow_traces_in_walking_order(spark):
    flow = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("d", "b"), ("x", "y")], "source_id string, target_id string")
    entries = spark.createDataFrame([("a",), ("x",)], "id string")
    rows = sorted(G.flow_traces(None, flow, entries).collect(), key=lambda r: (r.entry_id, r.step))
    assert [(r.entry_id, r.id, r.depth, r.has_cycle) for r in rows] == [
        ("a", "a", 0, True), ("a", "c", 1, True), ("a", "d", 2, True), ("a", "b", 3, True), ("a", "e", 2, True), ("a", "b", 1, True), ("x", "x", 0, False), ("x", "y", 1, False),
    ]


def test_import_candidates(spark):
    files = spark.createDataFrame([(str(k), p) for k, p in enumerate(["src/a.ts", "src/b/index.ts", "lib/pkg/x.js", "src/c.tsx", "src/c.js", "src/d/index.js", "src/d/index.ts", "src/e.ts", "src/e.js", "src/e/index.js", "lib/pkg/index.js"])], "id string, path string")
    rows = spark.createDataFrame(
        [(1, "src/a.ts", "./b"), (2, "src/b/index.ts", "../c"), (3, "src/a.ts", "@/c"), (4, "src/a.ts", "pkg/x"), (5, "src/a.ts", "./none"), (6, "src/a.ts", "c"), (7, "src/a.ts", "react"), (8, "src/a.ts", "./d"), (9, "src/a.ts", "./e"), (10, "src/a.ts", "pkg"), (11, "src/a.ts", "exact"), (12, "src/a.ts", "d/x"), (13, "src/a.ts", "//c")],
        "row_id long, importing string, spec string",
    )
    js = js_of([("@/*", ["src/*"]), ("exact", ["src/a"])], {"pkg": "lib/pkg"}, ["d"], ["src"])
    assert dict(map(tuple, V.js_imports(rows, files, js).collect())) == {1: "1", 2: "4", 3: "4", 4: "2", 6: "4", 8: "5", 9: "8", 10: "10", 11: "0"}


def test_the_longest_alias_wins(spark):
    files = spark.createDataFrame([("x", "one/b.js"), ("y", "two/b.js"), ("z", "three/b.js")], "id string, path string")
    rows = spark.createDataFrame([(1, "a.js", "@/ui/b"), (2, "a.js", "@/b")], "row_id long, importing string, spec string")
    js = js_of([("@/*", ["none/*", "three/*"]), ("@/ui/*", ["two/*"])])
    assert dict(map(tuple, V.js_imports(rows, files, js).collect())) == {1: "y", 2: "z"}


def test_rust_relative(spark):
    files = spark.createDataFrame([("s", "src/a/b.rs"), ("m", "src/a/mod.rs"), ("c", "src/c.rs"), ("l", "src/lib.rs")], "id string, path string")
    rows = spark.createDataFrame([(1, "src/a/b.rs", "super::Item"), (2, "src/a/mod.rs", "self::b::f"), (3, "src/a/b.rs", "super::super::c::Item"), (4, "src/c.rs", "super::*"), (5, "src/lib.rs", "super::x"), (6, "src/c/d.rs", "super::E"), (7, "src/c/none.rs", "self::E")], "row_id long, importing string, spec string")
    assert dict(map(tuple, V.rust_relative(rows, files).collect())) == {1: "m", 2: "m", 3: "l", 4: "l", 6: "c"}


def test_upsert_and_reconcile(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "id long, s string, t long")
    new = spark.createDataFrame([(1, None, 2), (3, "c", 2)], "id long, s string, t long")
    assert vals(K.upsert(old, new, ["id"], keep_if_null=["s"], keep_old=["t"])) == [(1, "a", 1), (2, None, 1), (3, "c", 2)]
    assert vals(K.upsert(old, new, ["id"])) == [(1, None, 2), (2, None, 1), (3, "c", 2)]


def test_shed_to_fit():
    rows = [{"path": "a", "source": "x\n" * 50, "depth": "d" * 30}, {"path": "b", "source": "y\n" * 50, "depth": "d" * 30}]
    assert R.shed_to_fit(rows, 1000) == rows
    cut = R.shed_to_fit(rows, 150)
    assert cut[0]["source"] == rows[0]["source"] and cut[1]["truncated"] and cut[1]["depth"] is None
    assert R.shed_to_fit(rows, 2)[0]["source"] in (None, "")


def test_words(spark):
    assert X.query_words("How is the HTTPServer_name of a x built? find using") == ["how", "httpserver_name", "of", "built?"]
    assert X.query_words("the this that importing imports") == [] and X.query_words("auth auth token") == ["auth", "token"]
    assert X.search_words("  Ab c DEF ") == ["ab", "def"]
    assert (X.clamp_limit(None), X.clamp_limit(99), X.clamp_limit(-1)) == (10, 30, 1)
    with pytest.raises(ValueError):
        X.safe_scope("a/../b")
    cases = [("authentication", "auth", True), ("validity", "id", False), ("middleware", "id", False), ("settings_panel", "files", False), ("component", "component", True), ("subcomponent", "component", False), ("orderExportApi/index.js", "order", True), ("selfcheck_metrics.rs", "selfcheck_metrics", True), ("a", "--", False)]
    for s, w, want in cases:
        assert spark.range(1).select(X.word_matches(F.lit(s), w)).first()[0] == want, (s, w)


def test_scores_and_reasons(spark):
    files = spark.createDataFrame([(1, "auth_service.rs", "src/auth/auth_service.rs"), (2, "login.rs", "src/auth/login.rs"), (3, "other.rs", "src/other.rs")], "id long, name string, path string")
    got = {r.id: (r.score, r.reason) for r in R.score_files(files, ["auth", "auth", "service", "src"]).collect()}
    assert got == {1: (5, "name: auth, service; path: src"), 2: (2, "path: auth, src"), 3: (1, "path: src")}
    symbol = spark.createDataFrame([(1, 4), (3, 4), (2, 2)], "file_id long, symbol_score int")
    rows = R.rank(R.score_files(files, ["auth", "login"]), symbol, 2).collect()
    assert [(r.id, r.total, r.reason, r.not_shown) for r in rows] == [(1, 4, "name: auth; symbol: exact name match", 1), (3, 4, "no query-word hit; symbol: exact name match", 1)]


def test_event_stream(spark, sf, tmp_path):
    from tiergraph.streaming.feed import event_counts

    folder = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.parquet(str(folder))
    q = event_counts(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("event_counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from event_counts").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
