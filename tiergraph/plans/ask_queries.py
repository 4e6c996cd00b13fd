"""Queries over asking the graph: joins, traversal, ranking, search, resolution, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiergraph.functions import text as X
from tiergraph.operators import edges as E
from tiergraph.operators import graph as G
from tiergraph.operators import ranking as R
from tiergraph.operators import resolve as V
from tiergraph.operators import search as S
from tiergraph.operators import sinks as K
from tiergraph.plans.build_queries import edges_of, module_edges, top_edges
from tiergraph.plans.registry import query
from tiergraph.sources import adapters as A
from tiergraph.sources.adapters import read, with_cte

# ---- filters


@query("fil2_keyword_search", with_cte(["ents"], "SELECT id, name FROM ents WHERE contains(lower(name),'0001') OR contains(lower(path),'0001') OR contains(lower(name),'asia') OR contains(lower(path),'asia') ORDER BY name, id LIMIT 30"))
def _(spark, sf):
    return R.keyword(A.entities(spark, sf), X.search_words("0001 ASIA x"), 30).select("id", "name")


@query("fil1_keyword_search_of_tier", with_cte(["ents"], "SELECT id, name FROM ents WHERE tier='file' AND (contains(lower(name),'00012') OR contains(lower(path),'00012')) ORDER BY name, id LIMIT 10"))
def _(spark, sf):
    return R.keyword(A.entities(spark, sf), ["00012"], X.clamp_limit(None), "file").select("id", "name")


@query("fil4_substring_search", with_cte(["ents"], "SELECT id, lower(name) AS name FROM ents WHERE contains(lower(name),'build') OR contains(lower(path),'build') OR contains(lower(COALESCE(summary,'')),'build')"))
def _(spark, sf):
    return R.substring_search(A.entities(spark, sf), "BUILD").select("id", F.lower("name").alias("name"))


@query("fil5_symbol_prefilter", with_cte(["ents"], "SELECT id, name, lower(name) IN ('order_12','order_7') AS exact FROM ents WHERE tier<>'file' AND (contains(lower(name),'order_12') OR contains(lower(name),'order_7')) ORDER BY exact DESC, name, id LIMIT 2000"))
def _(spark, sf):
    return R.symbols(A.entities(spark, sf), ["order_12", "order_7"]).select("id", "name", "exact")


@query("fil7_fil14_scope", with_cte(["ents"], "SELECT id FROM ents WHERE (path='ASIA' OR starts_with(path,'ASIA/')) AND NOT (path='ASIA/'||(SELECT min(n_name) FROM nation) OR contains(path,'/1')) AND tier<>'function'"))
def _(spark, sf):
    e = A.entities(spark, sf).where("tier <> 'function'")
    return e.where(X.under(F.col("path"), X.safe_scope("/ASIA/"))).where(~F.col("path").contains("/1")).select("id")


@query("fil8_snk9_excluded", with_cte(["ents"], "SELECT id FROM ents WHERE path='AFRICA' OR starts_with(path,'AFRICA/') OR starts_with(path,'ASIA/N') AND false"))
def _(spark, sf):
    return K.excluded(A.entities(spark, sf), ["AFRICA/"])


@query("fil9_test_file", r"""SELECT page_id, (regexp_matches(regexp_extract(lower(u),'([^/]*)$',1),'^(tests?|spec)_|_(tests?|spec)([._]|$)|\.(test|spec)\.') OR regexp_matches('/'||lower(u),'/(tests|test|spec|__tests__)/')) AS t FROM (SELECT page_id, CASE page_id%6 WHEN 0 THEN 'a/test_x.py' WHEN 1 THEN 'Tests/b.rs' WHEN 2 THEN 'src/test.rs' WHEN 3 THEN 'src/c_spec.rb' WHEN 4 THEN 'src/d.test.ts' ELSE url END AS u FROM pages)""")
def _(spark, sf):
    u = F.expr("CASE page_id % 6 WHEN 0 THEN 'a/test_x.py' WHEN 1 THEN 'Tests/b.rs' WHEN 2 THEN 'src/test.rs' WHEN 3 THEN 'src/c_spec.rb' WHEN 4 THEN 'src/d.test.ts' ELSE url END")
    return read(spark, sf, "pages").select("page_id", X.is_test_file(u).alias("t"))


@query("fil10_test_path", r"""SELECT page_id, (regexp_matches(regexp_extract(lower(u),'([^/]*)$',1),'^(tests?|spec)_|_(tests?|spec)([._]|$)|\.(test|spec)\.') OR regexp_matches(lower(u),'(^|/)(tests|test|spec|__tests__)(\.[^/]*)?(/|$)')) AS t FROM (SELECT page_id, CASE page_id%6 WHEN 0 THEN 'a/test_x.py' WHEN 1 THEN 'Tests/b.rs' WHEN 2 THEN 'src/test.rs' WHEN 3 THEN 'src/c_spec.rb' WHEN 4 THEN 'src/d.test.ts' ELSE url END AS u FROM pages)""")
def _(spark, sf):
    u = F.expr("CASE page_id % 6 WHEN 0 THEN 'a/test_x.py' WHEN 1 THEN 'Tests/b.rs' WHEN 2 THEN 'src/test.rs' WHEN 3 THEN 'src/c_spec.rb' WHEN 4 THEN 'src/d.test.ts' ELSE url END")
    return read(spark, sf, "pages").select("page_id", X.is_test_path(u).alias("t"))


@query("fil11_unit_kinds", "SELECT event_type, count(*) AS n, lower(event_type) IN ('function','regular_function','method','closure','async_function','struct','class','enum','type','interface','trait') AS kept FROM (SELECT CASE event_id%4 WHEN 0 THEN 'Function' WHEN 1 THEN 'TRAIT' WHEN 2 THEN 'module' ELSE 'closure' END AS event_type FROM events) GROUP BY 1")
def _(spark, sf):
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'Function' WHEN 1 THEN 'TRAIT' WHEN 2 THEN 'module' ELSE 'closure' END")
    return read(spark, sf, "events").groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("n")).withColumn("kept", X.is_preservable(F.col("event_type")))


@query("fil12_method_detection", r"""SELECT doc_id, regexp_matches(regexp_extract(t,'^([^{;]*)',1),'(^|[^A-Za-z0-9_])self([^A-Za-z0-9_]|$)') AS m FROM (SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 'fn f(&self) { '||text WHEN 1 THEN 'fn myself(a: u8) { self.x }' ELSE 'fn g(a); self' END AS t FROM documents)""")
def _(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("fn f(&self) { "), "text")).when(F.col("doc_id") % 3 == 1, "fn myself(a: u8) { self.x }").otherwise("fn g(a); self")
    return read(spark, sf, "documents").select("doc_id", X.is_method(t).alias("m"))


@query("fil13_name_case", r"SELECT p_partkey, contains(n,'_') AND NOT regexp_matches(n,'\p{Lu}') AS snake, regexp_matches(n,'^\p{Ll}') AND regexp_matches(n,'\p{Lu}') AS camel FROM (SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN replace(p_name,' ','_') WHEN 1 THEN 'camel'||p_brand WHEN 2 THEN 'Mixed_'||p_name ELSE 'éa_'||p_brand END AS n FROM part)")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    n = F.when(k == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k == 1, F.concat(F.lit("camel"), "p_brand")).when(k == 2, F.concat(F.lit("Mixed_"), "p_name")).otherwise(F.concat(F.lit("éa_"), "p_brand"))
    return read(spark, sf, "part").select("p_partkey", X.is_snake(n).alias("snake"), X.is_camel(n).alias("camel"))


@query("fil15_missing_summary", with_cte(["ents"], "SELECT id FROM ents WHERE tier='function' AND summary IS NULL AND NOT starts_with(lower(name),'test_')"))
def _(spark, sf):
    return A.entities(spark, sf).where("tier = 'function'").where(X.missing_summary(F.col("summary"), F.col("name"))).select("id")


# ---- graph stand-ins: contains by parent, imports by lineitem, depends_on by nation, calls between orders of one part


def graph_edges(spark, sf) -> DataFrame:
    e = A.entities(spark, sf)
    contains = e.where("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("rel_type"))
    imports = file_imports(spark, sf)
    mods = top_edges(spark, sf, 2).select("source_id", "target_id", F.lit("depends_on").alias("rel_type"))
    # stands for a stored table, so it is made once a query, however often a walk reads it
    return contains.unionByName(imports).unionByName(mods).unionByName(order_calls(spark, sf)).persist()


def held_entities(spark, sf) -> DataFrame:
    """The entity table as a walk reads it, made once a query."""
    return A.entities(spark, sf).persist()


def file_imports(spark, sf) -> DataFrame:
    """Customer k imports the customer seven times its number away, of those there are."""
    c = read(spark, sf, "customer").select("c_custkey")
    t = c.select(F.col("c_custkey").alias("k"))
    return c.join(t, F.col("k") == F.expr("c_custkey * 7 % 1009 + 1")).where("k <> c_custkey").select(F.concat(F.lit("file:"), "c_custkey").alias("source_id"), F.concat(F.lit("file:"), "k").alias("target_id"), F.lit("imports").alias("rel_type"))


def order_calls(spark, sf) -> DataFrame:
    """An order calls the next order that ships the same part from the same supplier."""
    i = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").distinct()
    nxt = F.lead("l_orderkey").over(W.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey"))
    return i.withColumn("nxt", nxt).where("nxt is not null").select(F.concat(F.lit("function:"), "l_orderkey").alias("source_id"), F.concat(F.lit("function:"), "nxt").alias("target_id"), F.lit("calls").alias("rel_type")).distinct()


A.CTE |= {
    "calls": """calls AS (SELECT DISTINCT 'function:'||l_orderkey AS source_id, 'function:'||nxt AS target_id, 'calls' AS rel_type FROM (SELECT l_orderkey, lead(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey) AS nxt FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem)) WHERE nxt IS NOT NULL)""",
    "fimports": "fimports AS (SELECT 'file:'||a.c_custkey AS source_id, 'file:'||b.c_custkey AS target_id, 'imports' AS rel_type FROM customer a JOIN customer b ON b.c_custkey=a.c_custkey*7%1009+1 WHERE a.c_custkey<>b.c_custkey)",
    "g": """g AS (SELECT parent_id AS source_id, id AS target_id, 'contains' AS rel_type FROM ents WHERE parent_id IS NOT NULL UNION ALL SELECT * FROM fimports UNION ALL SELECT source_id, target_id, 'depends_on' FROM top2 UNION ALL SELECT * FROM calls)""",
    "owner": "owner AS (SELECT id, CASE tier WHEN 'file' THEN id ELSE parent_id END AS file_id FROM ents WHERE tier IN ('file','function'))",
    "dep": "dep AS (SELECT DISTINCT source_id, target_id FROM g WHERE rel_type<>'contains')",
}
A.NEEDS |= {"g": ["ents", "fimports", "top2", "calls"], "owner": ["ents"], "dep": ["g"]}


@query("jn1_gr1_dependencies", with_cte(["g"], "SELECT source_id, target_id, rel_type, name, tier FROM g JOIN ents ON target_id=id WHERE source_id IN ('module:3','file:12','function:100')"))
def _(spark, sf):
    ids = spark.createDataFrame([("module:3",), ("file:12",), ("function:100",)], "id string")
    rows = G.outgoing(graph_edges(spark, sf), A.entities(spark, sf), ids)
    return rows.select("source_id", "target_id", "rel_type", F.col("other_name").alias("name"), F.col("other_tier").alias("tier"))


@query("jn2_gr2_dependents", with_cte(["g"], "SELECT source_id, target_id, rel_type, name, tier FROM g JOIN ents ON source_id=id WHERE target_id IN ('module:3','file:12','function:100')"))
def _(spark, sf):
    ids = spark.createDataFrame([("module:3",), ("file:12",), ("function:100",)], "id string")
    rows = G.incoming(graph_edges(spark, sf), A.entities(spark, sf), ids)
    return rows.select("source_id", "target_id", "rel_type", F.col("other_name").alias("name"), F.col("other_tier").alias("tier"))


@query("jn3_project_edges", with_cte(["edges", "ents"], "SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM ents) AND target_id IN (SELECT id FROM ents) UNION ALL SELECT parent_id, id FROM ents WHERE parent_id IS NOT NULL"))
def _(spark, sf):
    e = A.entities(spark, sf)
    rows = edges_of(spark, sf).select("source_id", "target_id").unionByName(e.where("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id")))
    return G.project_edges(rows, e, "p")


@query("gr3_resolution_signal", "SELECT c_custkey, CASE WHEN i IS NULL THEN 'unknown' WHEN i>0 THEN 'partial' ELSE 'complete' END AS state, CASE WHEN i IS NULL THEN NULL WHEN i>0 THEN 0.0 ELSE 1.0 END::DOUBLE AS coverage, CASE WHEN i>0 THEN i||' internal imports are unresolved' END AS caveat FROM (SELECT c_custkey, CASE WHEN c_custkey%4=0 THEN NULL ELSE c_custkey%3 END AS i FROM customer)")
def _(spark, sf):
    i = F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 3)
    return read(spark, sf, "customer").select("c_custkey", *[c.alias(k) for k, c in G.resolution_signal(i, F.lit(0)).items()])


@query(
    "gr4_impact",
    with_cte(
        ["g"],
        """, f AS (SELECT id, parent_id FROM ents WHERE id IN ('file:12','file:40')), m AS (SELECT id, parent_id FROM ents WHERE id IN (SELECT parent_id FROM f)), s AS (SELECT id FROM ents WHERE id IN (SELECT parent_id FROM m)),
 seeds AS (SELECT id FROM m UNION SELECT id FROM s), b AS (SELECT source_id, target_id FROM g JOIN ents ON source_id=id WHERE tier IN ('module','subsystem')),
 one AS (SELECT DISTINCT source_id AS id FROM b WHERE target_id IN (SELECT id FROM seeds)), two AS (SELECT DISTINCT source_id AS id FROM b WHERE target_id IN (SELECT id FROM one))
 SELECT 'file' AS kind, id FROM f UNION ALL SELECT 'module', id FROM m UNION ALL SELECT 'subsystem', id FROM s UNION ALL SELECT 'dependent', id FROM (SELECT id FROM one UNION SELECT id FROM two) WHERE id NOT IN (SELECT id FROM seeds)
 UNION ALL SELECT DISTINCT 'caller', source_id FROM calls WHERE target_id IN (SELECT id FROM ents WHERE tier='function' AND parent_id IN (SELECT id FROM f))""",
    ).replace("\n, f AS", ", f AS"),
)
def _(spark, sf):
    e = held_entities(spark, sf)
    return G.impact(e, graph_edges(spark, sf), e.where("id in ('file:12', 'file:40')").select("path"))


HOPS = """, s0 AS (SELECT id FROM owner WHERE file_id='file:12'), h1 AS (SELECT DISTINCT source_id AS id FROM dep WHERE target_id IN (SELECT id FROM s0) AND source_id NOT IN (SELECT id FROM s0) AND source_id IN (SELECT id FROM owner)),
 h2 AS (SELECT DISTINCT source_id AS id FROM dep WHERE target_id IN (SELECT id FROM h1) AND source_id NOT IN (SELECT id FROM s0 UNION SELECT id FROM h1) AND source_id IN (SELECT id FROM owner))
 SELECT file_id, CAST(min(hop) AS BIGINT) AS hop FROM (SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2) JOIN owner USING (id) WHERE file_id<>'file:12' GROUP BY 1"""


@query("gr5_hop_dependents", with_cte(["dep", "owner"], "").rstrip() + HOPS)
def _(spark, sf):
    return G.hops(held_entities(spark, sf), graph_edges(spark, sf), spark.createDataFrame([("file:12",)], "id string"))


BLAST = """, d AS (SELECT source_id, target_id, rel_type FROM g WHERE rel_type<>'contains'), s0 AS (SELECT id FROM owner WHERE file_id='file:12'),
 f1 AS (SELECT source_id AS id, min(rel_type) AS rel_type FROM d WHERE target_id IN (SELECT id FROM s0) AND source_id NOT IN (SELECT id FROM s0) GROUP BY 1), p1 AS (SELECT f1.*, file_id FROM f1 JOIN owner USING (id) WHERE file_id<>'file:12'),
 f2 AS (SELECT source_id AS id, min(rel_type) AS rel_type FROM d WHERE target_id IN (SELECT id FROM p1) AND source_id NOT IN (SELECT id FROM s0 UNION SELECT id FROM f1) GROUP BY 1), p2 AS (SELECT f2.*, file_id FROM f2 JOIN owner USING (id) WHERE file_id<>'file:12'),
 fs AS (SELECT file_id, CAST(min(hop) AS BIGINT) AS hop, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS rel_types FROM (SELECT file_id, rel_type, 1 AS hop FROM p1 UNION ALL SELECT file_id, rel_type, 2 FROM p2) WHERE rel_type<>'calls' GROUP BY 1)
 SELECT *, (SELECT greatest(count(*)-25,0) FROM fs) AS omitted FROM fs ORDER BY hop, file_id LIMIT 25"""


@query("gr6_blast_radius", with_cte(["g", "owner"], "").rstrip() + BLAST)
def _(spark, sf):
    return G.blast_radius(held_entities(spark, sf), graph_edges(spark, sf), "file:12")


@query("gr6_blast_radius_capped", """WITH b AS (SELECT DISTINCT 'file:'||o_custkey AS file_id FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_suppkey=1)
 SELECT file_id, CAST(1 AS BIGINT) AS hop, 'imports' AS rel_types, (SELECT greatest(count(*)-25,0) FROM b) AS omitted FROM b ORDER BY file_id LIMIT 25""")
def _(spark, sf):
    s = read(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.lit("p").alias("project_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("file").alias("tier"), F.col("s_name").alias("name"), F.col("s_name").alias("path"), F.lit(None).cast("string").alias("summary"))
    return G.blast_radius(held_entities(spark, sf).unionByName(s), edges_of(spark, sf), "supplier:1")


@query("gr7_direct_dependents", with_cte(["dep", "owner"], "SELECT b.file_id AS file_id, count(DISTINCT a.file_id) AS dependents FROM dep JOIN owner a ON source_id=a.id JOIN owner b ON target_id=b.id WHERE a.file_id<>b.file_id GROUP BY 1"))
def _(spark, sf):
    return G.direct_dependents(held_entities(spark, sf), graph_edges(spark, sf))


@query("gr8_call_paths", with_cte(["calls", "ents"], "SELECT DISTINCT 'calls' AS direction, source_id AS function_id, target_id AS other_id FROM calls WHERE source_id IN (SELECT id FROM ents WHERE tier='function' AND parent_id='file:12') UNION ALL SELECT DISTINCT 'called_by', target_id, source_id FROM calls WHERE target_id IN (SELECT id FROM ents WHERE tier='function' AND parent_id='file:12')"))
def _(spark, sf):
    return G.call_paths(A.entities(spark, sf), graph_edges(spark, sf), "file:12")


def _flow(spark, sf) -> DataFrame:
    return top_edges(spark, sf, 2).select("source_id", "target_id")


REACH = """, ep AS (SELECT DISTINCT source_id AS id FROM top2 WHERE source_id NOT IN (SELECT target_id FROM top2)),
 r AS (SELECT id AS entry_id, id, 0 AS depth FROM ep UNION SELECT entry_id, target_id, depth+1 FROM r JOIN top2 ON source_id=r.id WHERE depth<20)
 SELECT entry_id, id, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1,2"""


@query("gr9_entry_points", with_cte(["top2", "ents"], "SELECT DISTINCT source_id AS id FROM top2 WHERE source_id NOT IN (SELECT target_id FROM top2) UNION SELECT id FROM ents WHERE name='main' OR starts_with(name,'handle_') OR contains(path,'/bin/')"))
def _(spark, sf):
    return G.entry_points(A.entities(spark, sf), _flow(spark, sf))


@query("gr9_flow_reach", with_cte(["top2"], "").rstrip() + REACH)
def _(spark, sf):
    flow = _flow(spark, sf).persist()
    return G.flow_reach(flow, G.entry_points(A.entities(spark, sf).where("tier = 'module'"), flow))


@query("gr9_flow_traces")
def _(spark, sf):
    flow = _flow(spark, sf).persist()
    return G.flow_traces(A.entities(spark, sf), flow, G.entry_points(A.entities(spark, sf).where("tier = 'module'"), flow))


@query("gr10_list_flows", with_cte(["top2", "ents"], "SELECT entry_id, name AS entry_name FROM (SELECT DISTINCT source_id AS entry_id FROM top2 WHERE source_id NOT IN (SELECT target_id FROM top2)) JOIN ents ON entry_id=id WHERE contains(lower(name),'a') ORDER BY 1 LIMIT 20"))
def _(spark, sf):
    e = A.entities(spark, sf)
    flow = _flow(spark, sf)
    entries = flow.select(F.col("source_id").alias("entry_id")).distinct().join(flow.select(F.col("target_id").alias("entry_id")), "entry_id", "left_anti")
    return G.list_flows(entries, e, "A").select("entry_id", "entry_name")


@query("gr11_callees", with_cte(["calls", "ents"], "SELECT target_id, name FROM calls JOIN ents ON target_id=id WHERE source_id='function:1'"))
def _(spark, sf):
    return G.callees(graph_edges(spark, sf), A.entities(spark, sf), "function:1")


@query("gr12_descendants", with_cte(["ents"], "SELECT id, CAST(1 AS BIGINT) AS depth FROM ents WHERE parent_id='module:4' UNION ALL SELECT id, 2 FROM ents WHERE parent_id IN (SELECT id FROM ents WHERE parent_id='module:4')"))
def _(spark, sf):
    return G.descendants(A.entities(spark, sf), "module:4")


@query("gr13_module_children", with_cte(["ents"], "SELECT file_id, function_id, rn FROM (SELECT parent_id AS file_id, id AS function_id, row_number() OVER (PARTITION BY parent_id ORDER BY name, id) AS rn FROM ents WHERE tier='function') WHERE rn<=5"))
def _(spark, sf):
    return G.module_children(A.entities(spark, sf), 5)


@query("gr14_relationships_of", with_cte(["g"], "SELECT CASE WHEN rel_type='contains' THEN 'children' ELSE 'imports' END AS section, target_id AS other_id, rel_type FROM g WHERE source_id='file:12' UNION ALL SELECT 'incoming', source_id, rel_type FROM g WHERE target_id='file:12'"))
def _(spark, sf):
    return G.relationships_of(graph_edges(spark, sf), "file:12")


@query("gr15_function_calls", with_cte(["calls"], """, b AS (SELECT source_id AS id, 'calls' AS direction, target_id AS other_id FROM calls UNION ALL SELECT target_id, 'called_by', source_id FROM calls), m AS (SELECT 'type:'||(o_orderkey%50) AS owner, 'function:'||o_orderkey AS method FROM orders)
 SELECT DISTINCT id, direction, other_id, CAST(NULL AS VARCHAR) AS via_method FROM b UNION ALL SELECT DISTINCT owner, direction, other_id, id FROM b JOIN m ON method=id""").replace("\n, b AS", ", b AS"))
def _(spark, sf):
    m = read(spark, sf, "orders").select(F.concat(F.lit("type:"), F.col("o_orderkey") % 50).alias("owner"), F.concat(F.lit("function:"), "o_orderkey").alias("method"))
    return G.function_calls(order_calls(spark, sf), m)


@query("gr16_bundle_edges", with_cte(["dep", "owner"], """SELECT DISTINCT a.file_id AS source_file, b.file_id AS target_file FROM dep JOIN owner a ON source_id=a.id JOIN owner b ON target_id=b.id WHERE a.file_id<>b.file_id
 AND (a.file_id IN (SELECT id FROM ents WHERE tier='file' AND starts_with(path,'ASIA/')) OR b.file_id IN (SELECT id FROM ents WHERE tier='file' AND starts_with(path,'ASIA/')))"""))
def _(spark, sf):
    return G.bundle_edges(held_entities(spark, sf), graph_edges(spark, sf), "ASIA")


@query("gr16_bundle_pack", "SELECT doc_id AS place, sum(length(text)+1) OVER (ORDER BY doc_id) <= 24000 AS kept FROM documents WHERE lang='es'")
def _(spark, sf):
    return G.pack_bundle(read(spark, sf, "documents").where("lang = 'es'").select(F.col("doc_id").alias("place"), "text")).select("place", "kept")


@query("gr17_false_zero", with_cte(["fimports"], """SELECT id, mentioned_by FROM (SELECT 'file:'||c_custkey AS id FROM customer) f JOIN (SELECT 'file:'||(o_custkey) AS m, count(DISTINCT 'file:'||(o_orderkey%1500)) AS mentioned_by FROM orders WHERE o_custkey<>o_orderkey%1500 GROUP BY 1) ON m=id WHERE id NOT IN (SELECT target_id FROM fimports)"""))
def _(spark, sf):
    files = read(spark, sf, "customer").select(F.concat(F.lit("file:"), "c_custkey").alias("id"))
    mentions = read(spark, sf, "orders").select(F.concat(F.lit("file:"), "o_custkey").alias("file_id"), F.concat(F.lit("file:"), F.col("o_orderkey") % 1500).alias("by_id"))
    return G.false_zero(files, file_imports(spark, sf), mentions)


@query("gr18_compare_resolutions", """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'both_unresolved' WHEN a IS NULL THEN 'only_second' WHEN b IS NULL THEN 'only_first' WHEN a=b THEN 'agree' ELSE 'differ' END AS verdict FROM
 (SELECT CASE WHEN o_orderkey%5<>0 THEN o_orderkey%7 END AS a, CASE WHEN o_orderkey%3<>0 THEN o_orderkey%14%7+CASE WHEN o_orderkey%11=0 THEN 1 ELSE 0 END END AS b FROM orders)) GROUP BY 1""")
def _(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.lit("x").alias("spec"), F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END").alias("target_id"))
    other = o.select("source_id", "spec", F.expr("CASE WHEN source_id % 3 <> 0 THEN source_id % 14 % 7 + CASE WHEN source_id % 11 = 0 THEN 1 ELSE 0 END END").alias("target_id"))
    return G.compare_resolutions(o, other)


@query("jn18_owning_file", with_cte(["owner"], "SELECT id, file_id FROM owner"))
def _(spark, sf):
    return G.owning_file(A.entities(spark, sf))


# ---- ranking

TOK = "list_filter(regexp_split_to_array(lower(regexp_replace({c},'([a-z0-9])([A-Z])','\\1 \\2','g')),'[^\\p{{L}}\\p{{N}}]+'), lambda x: x<>'')"


def _hit(c: str, w: str) -> str:
    return f"len(list_filter({TOK.format(c=c)}, lambda x: starts_with(x,'{w}')))>0"


def _any(c: str, w: str) -> str:
    """Some token of the lower-case column starts with some part of the word."""
    return "(" + " OR ".join(_hit(f"lower({c})", p) for p in w.split("_")) + ")"


RANK_WORDS = ["almond", "br", "red", "plum_st"]
SCORE = "+".join(f"CASE WHEN {_any('name', w)} THEN 2 WHEN {_any('path', w)} THEN 1 ELSE 0 END" for w in RANK_WORDS)
IN_NAME = ",".join(f"CASE WHEN {_any('name', w)} THEN '{w}' END" for w in RANK_WORDS)
IN_PATH = ",".join(f"CASE WHEN NOT {_any('name', w)} AND {_any('path', w)} THEN '{w}' END" for w in RANK_WORDS)
REASON = f"COALESCE(NULLIF(concat_ws('; ', 'name: '||NULLIF(concat_ws(', ',{IN_NAME}),''), 'path: '||NULLIF(concat_ws(', ',{IN_PATH}),'')),''),'no query-word hit')"
PARTS = "SELECT p_partkey AS id, p_name AS name, p_brand||'/'||p_type||'/'||p_partkey AS path FROM part"


def _parts(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type", "p_partkey").alias("path"))


@query("rk1_file_score", f"SELECT id, CAST({SCORE} AS BIGINT) AS score, {REASON} AS reason FROM ({PARTS})")
def _(spark, sf):
    return R.score_files(_parts(spark, sf), RANK_WORDS).select("id", F.col("score").cast("bigint").alias("score"), "reason")


@query("rk2_rank_and_cut", f"""WITH s AS (SELECT id, path, {SCORE} AS score, {REASON} AS reason FROM ({PARTS})), y AS (SELECT l_partkey AS id, max(CASE WHEN l_suppkey=7 THEN 4 WHEN l_suppkey%10=0 THEN 2 ELSE 0 END) AS k FROM lineitem GROUP BY 1),
 a AS (SELECT s.id, path, CAST(CASE WHEN k>score THEN k ELSE score END AS BIGINT) AS total, reason||CASE WHEN k>score AND k>=4 THEN '; symbol: exact name match' WHEN k>score THEN '; symbol: name prefix match' ELSE '' END AS reason FROM s LEFT JOIN y ON s.id=y.id) SELECT *, (SELECT greatest(count(*)-30,0) FROM a) AS not_shown FROM a ORDER BY total DESC, path LIMIT 30""")
def _(spark, sf):
    k = F.when(F.col("l_suppkey") == 7, 4).when(F.col("l_suppkey") % 10 == 0, 2).otherwise(0)
    symbol = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("file_id")).agg(F.max(k).alias("symbol_score"))
    return R.rank(R.score_files(_parts(spark, sf), RANK_WORDS), symbol, 30)


@query("rk2_symbol_scores", "SELECT 'file:'||o_custkey AS file_id, max(CASE WHEN o_orderkey=7 THEN 4 WHEN o_orderkey%3=0 OR starts_with(CAST(o_orderkey AS VARCHAR),'12') OR starts_with(CAST(o_orderkey AS VARCHAR),'7') THEN 2 ELSE 0 END) AS symbol_score FROM orders GROUP BY 1 HAVING symbol_score>0")
def _(spark, sf):
    k = F.split_part("name", F.lit("_"), F.lit(2))
    renamed = A.entities(spark, sf).where("tier = 'function'").withColumn("name", F.when(k == "7", "Exact_7").when(k.cast("bigint") % 3 == 0, F.concat(F.lit("Order_"), k)).otherwise(F.concat(F.lit("x_"), k)))
    return R.symbol_scores(renamed, ["exact_7", "order_none", "12"])


@query("rk3_match_set", f"SELECT id FROM ({PARTS}) WHERE {_any('name', 'red')} OR {_any('path', 'red')} UNION SELECT l_partkey FROM lineitem WHERE l_suppkey=7")
def _(spark, sf):
    p = _parts(spark, sf)
    hit = X.word_matches(F.lower("name"), "red") | X.word_matches(F.lower("path"), "red")
    return p.where(hit).select("id").unionByName(read(spark, sf, "lineitem").where("l_suppkey = 7").select(F.col("l_partkey").alias("id"))).distinct()


@query("rk6_page", with_cte(["ents"], "SELECT id, path, (SELECT count(*) FROM ents WHERE tier='file' AND starts_with(path,'EUROPE/')) AS total, CASE WHEN (SELECT count(*) FROM ents WHERE tier='file' AND starts_with(path,'EUROPE/'))>60 THEN CAST(60 AS BIGINT) END AS next_offset FROM ents WHERE tier='file' AND starts_with(path,'EUROPE/') ORDER BY path, id LIMIT 20 OFFSET 40"))
def _(spark, sf):
    rows = A.files(spark, sf).where(X.under(F.col("path"), "EUROPE")).select("id", "path")
    return R.page(rows, ["path", "id"], 40, 20)


@query("rk7_response_cap", "SELECT doc_id, used FROM (SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id) AS BIGINT) AS used FROM documents WHERE source='src3') WHERE used<=24000 ORDER BY used")
def _(spark, sf):
    return R.cap_prefix(read(spark, sf, "documents").where("source = 'src3'").withColumn("neg", -F.col("n_chars")), "n_chars", ["neg", "doc_id"]).select("doc_id", "used")


@query("rk9_doc_budget", """SELECT doc_id, taken, CASE WHEN taken=n_chars THEN 'full' WHEN taken>0 THEN 'truncated' ELSE 'skipped' END AS state FROM (SELECT doc_id, n_chars, least(n_chars, greatest(0, 20000-b)) AS taken FROM
 (SELECT doc_id, n_chars, CAST(COALESCE(sum(n_chars) OVER (PARTITION BY source ORDER BY length(lang) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS b FROM documents))""")
def _(spark, sf):
    return R.budget_groups(read(spark, sf, "documents"), "source", "n_chars", [F.desc(F.length("lang")), "doc_id"], 20_000).select("doc_id", "taken", "state")


@query("rk10_pack_batches", """, o AS (SELECT conv_id, turn, length(text)+25 AS need, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY 1,2)),
 w AS (SELECT conv_id, turn, k, need AS used, CAST(0 AS BIGINT) AS batch FROM o WHERE k=1 UNION ALL SELECT o.conv_id, o.turn, o.k, CASE WHEN used+need>1500 THEN need ELSE used+need END, batch+CASE WHEN used+need>1500 THEN 1 ELSE 0 END FROM w JOIN o ON o.conv_id=w.conv_id AND o.k=w.k+1)
 SELECT conv_id, turn, batch FROM w""".replace(", o AS", "WITH RECURSIVE o AS", 1))
def _(spark, sf):
    rows = read(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text")).withColumn("size", F.char_length("text"))
    return R.pack_batches(rows, "conv_id", "turn", "size", 1500).select("conv_id", "turn", "batch")


# ---- vectors and evaluation

COS = "list_sum(list_transform(range(1,65), lambda i: CAST(a.embedding[i] AS DOUBLE)*b.embedding[i]))/sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)*x)))/sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)*x)))"
NEAR = f"SELECT a.vec_id AS vec_id, a.label AS label, round((1+{COS})/2,6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=0) b"


def _near(spark, sf, k: int) -> DataFrame:
    v = S.with_norm(read(spark, sf, "embeddings"))
    return S.nearest(v, v.where("vec_id = 0").select(F.col("embedding").alias("query_embedding")), k)


@query("se2_se3_vector_search", f"SELECT * FROM ({NEAR}) ORDER BY score DESC, vec_id LIMIT 20")
def _(spark, sf):
    return _near(spark, sf, 20).select("vec_id", "label", "score")


@query("se3_overfetch_resolved", f"SELECT vec_id, path, score FROM (SELECT * FROM ({NEAR}) ORDER BY score DESC, vec_id LIMIT 20) JOIN (SELECT doc_id AS vec_id, source||'/'||doc_id AS path FROM documents WHERE doc_id%2=0) USING (vec_id) ORDER BY score DESC, vec_id LIMIT 10")
def _(spark, sf):
    v = S.with_norm(read(spark, sf, "embeddings"))
    docs = read(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("vec_id"), F.concat_ws("/", "source", "doc_id").alias("path"))
    return S.nearest_resolved(v, v.where("vec_id = 0").select(F.col("embedding").alias("query_embedding")), docs, 10).select("vec_id", "path", "score")


@query("se1_embedding")
def _(spark, sf):
    return S.embed(read(spark, sf, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", F.size("embedding").alias("size"), F.round(S.norm(F.col("embedding")), 5).alias("norm"))


@query("se5_recall_at_k", f"WITH n AS (SELECT vec_id, label FROM ({NEAR}) ORDER BY score DESC, vec_id LIMIT 50) SELECT CAST(0 AS BIGINT) AS probe, round((SELECT count(*) FROM n WHERE label=(SELECT label FROM embeddings WHERE vec_id=0))/(SELECT count(*) FROM embeddings WHERE label=(SELECT label FROM embeddings WHERE vec_id=0)),6) AS recall")
def _(spark, sf):
    ranked, truth = _eval(spark, sf)
    return S.recall_at_k(ranked, truth, 50)


def _eval(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "embeddings")
    ranked = _near(spark, sf, 50).select(F.lit(0).cast("bigint").alias("probe"), F.col("vec_id").alias("item"), F.row_number().over(W.orderBy(F.desc("score"), "vec_id")).alias("rank"))  # 50 rows
    truth = e.join(e.where("vec_id = 0").select("label"), "label").select(F.lit(0).cast("bigint").alias("probe"), F.col("vec_id").alias("item"))
    return ranked, truth


@query("se6_mrr", f"WITH n AS (SELECT vec_id, label, row_number() OVER (ORDER BY score DESC, vec_id) AS rk FROM ({NEAR}) QUALIFY rk<=50) SELECT CAST(0 AS BIGINT) AS probe, round(COALESCE(1/min(rk),0),6) AS rr FROM n WHERE label=(SELECT label FROM embeddings WHERE vec_id=0) AND vec_id<>0")
def _(spark, sf):
    ranked, truth = _eval(spark, sf)
    return S.mrr(ranked, truth.where("item <> 0"))


@query("se7_validate_probes", f"SELECT p_partkey AS probe, p_partkey%2=0 AS in_corpus, CAST(len(list_intersect({TOK.format(c='p_name')},{TOK.format(c='path')})) AS BIGINT) AS overlap FROM (SELECT p_partkey, p_name, p_type||'/'||p_partkey||'/'||CASE WHEN p_partkey%3=0 THEN p_name ELSE p_brand END AS path FROM part)")
def _(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("probe"), F.col("p_name").alias("query"), F.concat_ws("/", "p_type", "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_brand"))).alias("path"))
    return S.validate_probes(p, p.where("probe % 2 = 0").select("path"))


@query("se8_probe_gate", "SELECT min(c_acctbal) AS worst_recall, round(avg(c_acctbal),6) AS mean_recall, min(c_custkey) AS least_payload, min(c_acctbal)>=-1000 AND min(c_custkey)>=0 AS passed FROM customer")
def _(spark, sf):
    return S.probe_gate(read(spark, sf, "customer").select(F.col("c_acctbal").alias("recall"), F.col("c_custkey").alias("payload")), -1000, 0)


@query("jn20_semantic_hits", r"""WITH h AS (SELECT page_id AS hit, CASE WHEN page_id%2=0 THEN path ELSE regexp_extract(path,'/(.*)$',1) END AS path FROM (SELECT page_id, regexp_extract(url,'^https?://([^?#]+)',1) AS path FROM pages)), e AS (SELECT page_id AS id, regexp_extract(url,'^https?://([^?#]+)',1) AS epath FROM pages)
 SELECT hit, id FROM (SELECT hit, id, row_number() OVER (PARTITION BY hit ORDER BY CASE WHEN h.path=epath THEN 0 ELSE 1 END, id) AS rn FROM h JOIN e ON h.path=epath OR ends_with(epath,'/'||h.path) OR ends_with(h.path,'/'||epath)) WHERE rn=1""")
def _(spark, sf):
    u = read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]+)", 1).alias("path"))
    hits = u.select(F.col("page_id").alias("hit"), F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(F.regexp_extract("path", "/(.*)$", 1)).alias("path"))
    return S.suffix_hits(hits, u.select(F.col("page_id").alias("id"), "path"))


# ---- resolution


@query("jn4_unit_files", with_cte(["units", "ents"], "SELECT u.name AS name, e.path AS file, e.id AS file_id FROM units u JOIN ents e ON u.file=e.id"))
def _(spark, sf):
    files = A.files(spark, sf).select("id", "path")
    units = A.code_units(spark, sf).select("name", F.col("file").alias("id")).join(files, "id").select("name", F.col("path").alias("file"))
    return V.units_to_files(units, files)


@query("jn15_longest_prefix", r"""WITH u AS (SELECT page_id AS row_id, regexp_extract(url,'^https?://([^?#]+)',1) AS spec FROM pages), k AS (SELECT DISTINCT regexp_extract(url,'^https?://([^/?#]+)',1) AS key FROM pages UNION SELECT DISTINCT regexp_extract(url,'^https?://([^/?#]+/[^/?#]+)',1) FROM pages WHERE page_id%2=0)
 SELECT row_id, spec, matched, upper(matched) AS target FROM (SELECT row_id, spec, key AS matched, row_number() OVER (PARTITION BY row_id ORDER BY length(key) DESC NULLS LAST) AS rn FROM u LEFT JOIN k ON spec=key OR starts_with(spec,key||'/')) WHERE rn=1""")
def _(spark, sf):
    p = read(spark, sf, "pages")
    rows = p.select(F.col("page_id").alias("row_id"), F.regexp_extract("url", "^https?://([^?#]+)", 1).alias("spec"))
    host = p.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("key"))
    two = p.where("page_id % 2 = 0").select(F.regexp_extract("url", "^https?://([^/?#]+/[^/?#]+)", 1).alias("key"))
    keys = host.unionByName(two).distinct().withColumn("target", F.upper("key"))
    return V.longest_prefix(rows, keys, "spec", "/")


@query("jn6_trailing_segments", """WITH r AS (SELECT o_orderkey AS row_id, 'crate::m'||(o_custkey%40)::VARCHAR||'::f'||(o_orderkey%9)::VARCHAR||'::Item' AS spec FROM orders), k AS (SELECT 'crate::m'||i AS key FROM range(30) t(i) UNION ALL SELECT 'crate::m'||i||'::f'||j FROM range(20) t(i), range(5) s(j))
 SELECT row_id, spec, matched, upper(matched) AS target FROM (SELECT row_id, spec, key AS matched, row_number() OVER (PARTITION BY row_id ORDER BY length(key) DESC NULLS LAST) AS rn FROM r LEFT JOIN k ON spec=key OR starts_with(spec,key||'::')) WHERE rn=1""")
def _(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("crate::m"), F.col("o_custkey") % 40, F.lit("::f"), F.col("o_orderkey") % 9, F.lit("::Item")).alias("spec"))
    m = spark.range(30).select(F.concat(F.lit("crate::m"), "id").alias("key"))
    f = spark.range(100).select(F.concat(F.lit("crate::m"), F.expr("id div 5"), F.lit("::f"), F.col("id") % 5).alias("key"))
    return V.longest_prefix(rows, m.unionByName(f).withColumn("target", F.upper("key")), "spec", "::")


@query("jn11_unique_stem", "SELECT n_regionkey AS key, min(n_nationkey) AS target FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey)=1 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey)=1")
def _(spark, sf):
    a = V.unique_key(read(spark, sf, "nation").select(F.col("n_regionkey").cast("bigint").alias("key"), F.col("n_nationkey").cast("bigint").alias("target")), "key", "target")
    return a.unionByName(V.unique_key(read(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("target")), "key", "target"))


@query("jn12_unique_function_file", "SELECT l_partkey AS name, min(l_orderkey) AS file FROM lineitem WHERE l_quantity>45 GROUP BY 1 HAVING count(DISTINCT l_orderkey)=1")
def _(spark, sf):
    return V.unique_key(read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("file")), "name", "file")


@query("jn13_unit_functions", with_cte(["units", "ents"], "SELECT u.name AS name, u.file AS file, e.id AS function_id FROM units u JOIN ents e ON e.tier='function' AND e.name=u.name AND e.parent_id=u.file"))
def _(spark, sf):
    return V.unit_functions(A.code_units(spark, sf).select("name", "file"), A.entities(spark, sf).where("tier = 'function'"))


@query("jn14_call_targets", "SELECT DISTINCT 'c:'||c_custkey AS source_id, 'c:'||d AS target_id FROM customer JOIN (SELECT c_custkey AS d, round(c_acctbal) AS b FROM customer) ON round(c_acctbal)=b WHERE c_custkey<>d")
def _(spark, sf):
    c = read(spark, sf, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.round("c_acctbal").alias("name"))
    return V.call_targets(c.withColumnRenamed("id", "source_id"), c)


@query("jn16_module_path", with_cte(["ents"], "SELECT id, CASE tier WHEN 'function' THEN string_split(path,'/')[1]||'/'||string_split(path,'/')[2] WHEN 'file' THEN string_split(path,'/')[1]||'/'||string_split(path,'/')[2] WHEN 'module' THEN string_split(path,'/')[1] ELSE '' END AS m FROM ents"))
def _(spark, sf):
    return A.entities(spark, sf).select("id", V.module_path(F.col("path"), 2).alias("m"))


@query("jn17_cross_repo", """WITH i AS (SELECT 'subsystem:'||(o_custkey%5) AS source_id, replace(lower(r_name),'-','_') AS name FROM orders JOIN region ON r_regionkey=o_orderkey%5), s AS (SELECT 'subsystem:'||r_regionkey AS target_id, replace(lower(r_name),'-','_') AS name FROM region)
 SELECT source_id, target_id, CAST(count(*) AS DOUBLE) AS weight FROM i JOIN s USING (name) WHERE source_id<>target_id GROUP BY 1,2""")
def _(spark, sf):
    r = read(spark, sf, "region")
    i = read(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 5).join(F.broadcast(r), F.col("k") == F.col("r_regionkey"))
    imports = i.select(F.concat(F.lit("subsystem:"), F.col("o_custkey") % 5).alias("subsystem_id"), F.concat(F.col("r_name"), F.lit("::mod::Item")).alias("spec"))
    return V.cross_repo(imports, r.select(F.concat(F.lit("subsystem:"), "r_regionkey").alias("id"), F.col("r_name").alias("name")))


@query("jn19_paths_to_ids", with_cte(["ents"], "SELECT path, id FROM ents WHERE tier='file' AND path IN (SELECT path FROM ents WHERE tier='file' AND name LIKE '%7')"))
def _(spark, sf):
    e = A.entities(spark, sf).where("tier = 'file'")
    return V.paths_to_ids(e.where(F.col("name").endswith("7")).select("path"), e)


@query("jn23_find_indexed", with_cte(["ents"], """, f AS (SELECT id, path, string_split(path,'/')[-1] AS base FROM ents WHERE tier='file'), q AS (SELECT CASE WHEN c_custkey%2=0 THEN (SELECT path FROM f WHERE id='file:'||c_custkey) ELSE 'x/'||c_custkey END AS request FROM customer)
 SELECT request, COALESCE((SELECT id FROM f WHERE path=request), (SELECT min(id) FROM f WHERE base=string_split(request,'/')[-1] HAVING count(*)=1)) AS id FROM q""").replace("\n, f AS", ", f AS"))
def _(spark, sf):
    f = A.files(spark, sf).select("id", "path")
    k = F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint")
    want = f.withColumn("k", k).select(F.when(F.col("k") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("x/"), "k")).alias("request"))
    return V.find_indexed(want, f)


# ---- scalar functions


@query("sf1_tokens", f"SELECT p_partkey, array_to_string({TOK.format(c='n')},' ') AS t FROM (SELECT p_partkey, 'get'||p_brand||'HTTPx9Y_'||p_name AS n FROM part)")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(X.tokens(F.concat(F.lit("get"), "p_brand", F.lit("HTTPx9Y_"), "p_name")), " ").alias("t"))


@query("sf2_word_match", f"SELECT p_partkey, {_any('p_name', 'bl')} AS m, {_any('p_name', 'qu_gre')} AS parts FROM part")
def _(spark, sf):
    n = F.lower("p_name")
    return read(spark, sf, "part").select("p_partkey", X.word_matches(n, "bl").alias("m"), X.word_matches(n, "qu_gre").alias("parts"))


SF3_STOP = ",".join(f"'{w}'" for w in X.STOP_WORDS)


@query("sf3_query_words", rf"""SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w,x)=i)[1:10],' ') AS words FROM
 (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower('Find the Files using '||text||' imports'),'\s+'), lambda x: strlen(x)>=2 AND x NOT IN ({SF3_STOP})) AS w FROM conversations)""")
def _(spark, sf):
    asked = F.concat(F.lit("Find the Files using "), "text", F.lit(" imports"))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.query_words_of(asked), " ").alias("words"))


@query("sf4_normalize_path", r"SELECT page_id, CASE WHEN s='' THEN '.' ELSE s END AS p FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(u,'\','/'),'/+','/','g'),'^(\./)+',''),'/$','') AS s FROM (SELECT page_id, CASE page_id%3 WHEN 0 THEN './a\\b//c/' WHEN 1 THEN './' ELSE url END AS u FROM pages))")
def _(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, "./a\\\\b//c/").when(F.col("page_id") % 3 == 1, "./").otherwise(F.col("url"))
    return read(spark, sf, "pages").select("page_id", X.normalize_path(u).alias("p"))


@query("sf5_stem", r"SELECT page_id, basename, extension, CASE WHEN s<>'' THEN lower(s) END AS stem FROM (SELECT page_id, b AS basename, regexp_extract(b,'\.([^.]+)$',1) AS extension, CASE WHEN contains(b,'.') THEN regexp_replace(b,'\.[^.]*$','') ELSE b END AS s FROM (SELECT page_id, regexp_extract(url||CASE WHEN page_id%2=0 THEN '.Test.TS' ELSE '' END,'([^/]*)$',1) AS b FROM pages))")
def _(spark, sf):
    p = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".Test.TS").otherwise(""))
    return read(spark, sf, "pages").select("page_id", X.basename(p).alias("basename"), X.extension(p).alias("extension"), X.stem(p).alias("stem"))


@query("sf6_whole_word", "SELECT p_partkey, regexp_matches(replace(p_name,' ','_'),'(^|[_-])red([_-]|$)') AS word, regexp_matches(p_name,'(^|[^A-Za-z0-9_])red([^A-Za-z0-9_]|$)') AS in_source FROM part")
def _(spark, sf):
    n = F.col("p_name")
    return read(spark, sf, "part").select("p_partkey", X.contains_word(F.replace(n, F.lit(" "), F.lit("_")), F.lit("red")).alias("word"), X.contains_word(n, F.lit("red"), source_text=True).alias("in_source"))


@query("sf7_truncate", "SELECT doc_id, CASE WHEN length(text)>80 THEN left(text,77)||'...' ELSE text END AS t, CASE WHEN length(text)>2 THEN '...' ELSE text END AS dots FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.truncate(F.col("text"), 80).alias("t"), X.truncate(F.col("text"), 2).alias("dots"))


@query("sf8_numbered_source", """SELECT doc_id, CASE WHEN t='' THEN '' ELSE array_to_string(list_transform(string_split(CASE WHEN ends_with(t,chr(10)) THEN left(t,length(t)-1) ELSE t END,chr(10)), lambda x, i: i||chr(9)||x),chr(10))||CASE WHEN ends_with(t,chr(10)) THEN chr(10) ELSE '' END END AS t, length(t)<500 AS small
 FROM (SELECT doc_id, CASE WHEN doc_id%2=0 THEN text||chr(10) WHEN doc_id%9=1 THEN '' ELSE text END AS t FROM documents)""")
def _(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n"))).when(F.col("doc_id") % 9 == 1, "").otherwise(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", X.numbered(t).alias("t"), X.is_small_body(t).alias("small"))


STRIP = r"regexp_replace({x},'^[\s\x0b]+|[\s\x0b]+$','','g')"
LINES = r"CASE WHEN t='' THEN [] ELSE list_transform(string_split(CASE WHEN ends_with(t,chr(10)) THEN left(t,length(t)-1) ELSE t END,chr(10)), lambda x: regexp_replace(x,'\r$','')) END"


@query("sf9_doc_summary", rf"""SELECT doc_id, array_to_string(list_transform(list_filter(l, lambda x: starts_with(x,'#'))[1:20], lambda x: {STRIP.format(x="regexp_replace(x,'^#+','')")}),'|') AS headings,
 array_to_string(list_transform(list_filter(l, lambda x: strlen(x)>20 AND (contains(lower(x),'decision') OR contains(lower(x),'designed') OR contains(lower(x),'architecture')))[1:10], lambda x: {STRIP.format(x='x')}),'|') AS decisions,
 array_to_string(list_transform(list_filter(l[1:100], lambda x: strlen(x)>10 AND (contains(x,': ') OR contains(x,' - ')) AND NOT starts_with(x,'#'))[1:15], lambda x: {STRIP.format(x='x')}),'|') AS terminology,
 array_to_string(list_filter(list_transform(l, lambda x: {STRIP.format(x='x')}), lambda x: regexp_matches(x,'^[\p{{Lu}}_]+='))[1:10],'|') AS config_values
 FROM (SELECT doc_id, {LINES} AS l FROM (SELECT doc_id, CASE WHEN doc_id%4=0 THEN '# Head '||doc_id||chr(13)||chr(10)||' # no'||chr(10)||'term: of this'||chr(10)||'a: b'||chr(10)||'KEY_A=1'||chr(10)||'Key=2'||chr(10)||'We took a Decision'||chr(10)||' It is so designed: well.'||chr(10) ELSE '' END||text AS t FROM documents))""")
def _(spark, sf):
    head = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("# Head "), "doc_id", F.lit("\r\n # no\nterm: of this\na: b\nKEY_A=1\nKey=2\nWe took a Decision\n It is so designed: well.\n"))).otherwise("")
    parts = X.doc_summary(F.col("t"))
    return read(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("t")).select("doc_id", *[F.array_join(c, "|").alias(k) for k, c in parts.items()])


def _answer(k: int) -> str:
    hit = rf"list_filter(l, lambda x: TRY_CAST(regexp_extract(x,'^[^#]*#\s*\+?(\d+)\s*:',1) AS BIGINT)={k})"
    return f"CASE WHEN len({hit})>0 THEN {STRIP.format(x=f"regexp_extract({hit}[-1],'^[^#]*#[^:]*:(.*)$',1)")} END AS t{k}"


@query("sf10_batch_responses", f"""SELECT conv_id, turn, {_answer(0)}, {_answer(1)}, {_answer(2)} FROM (SELECT conv_id, turn, {LINES} AS l FROM
 (SELECT conv_id, turn, 'noise'||chr(10)||'#0: '||text||chr(10)||'- # '||(turn%4)||' : again '||role||chr(10)||'#2:'||chr(10)||'#x: no'||chr(10)||'#7: z' AS t FROM conversations))""")
def _(spark, sf):
    content = F.concat(F.lit("noise\n#0: "), "text", F.lit("\n- # "), (F.col("turn") % 4).cast("string"), F.lit(" : again "), "role", F.lit("\n#2:\n#x: no\n#7: z"))
    got = X.batch_responses(content, 3)
    return read(spark, sf, "conversations").select("conv_id", "turn", *[got[k].alias(f"t{k}") for k in range(3)])


@query("sf11_hashes", "SELECT doc_id, sha256(text) AS h, left(sha256(text),16) AS short FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), X.short_hash(F.col("text")).alias("short"))


#: Origins by form, % standing for a number, and the keys that they have.
ORIGINS = [
    ("git@Git.Example.org:Team/R%.git", "git.example.org/team/r%"),
    ("https://user:pw@git.example.org:8443/team/r%/", "git.example.org:8443/team/r%"),
    ("  ssh://git@git.example.org:22/team/r%.git ", "git.example.org/team/r%"),
    ("HTTPS://git.example.org:443/Team/Sub/r%.git/", "git.example.org/team/sub/r%"),
    ("http://git.example.org/team/r%", None),
    ("https://git.example.org/r%", None),
    ("https://git.example.org/team/../r%", None),
    ("ssh://git.example.org:99999/team/r%", None),
    ("git://git.example.org:9418/a/b%", "git.example.org/a/b%"),
    ("git.example.org:/team/r%", None),
    ("https://git.example.org/team//r%", None),
    ("host:a/b%", "host/a/b%"),
    ("not an origin %", None),
    ("https://git.example.org/team/\x07r%", None),
    ("https://git.example.org/team/r%" + "x" * 600, None),
]


def _case(values: list[str | None]) -> str:
    rows = "".join(f" WHEN {k} THEN {'NULL' if v is None else "replace('" + v + "','%',CAST(page_id AS VARCHAR))"}" for k, v in enumerate(values))
    return f"CASE page_id%{len(values)}{rows} END"


@query("sf12_origin_key", f"SELECT page_id, {_case([k for _, k in ORIGINS])} AS k FROM pages")
def _(spark, sf):
    u = F.lit(None).cast("string")
    for k, (form, _) in enumerate(ORIGINS):
        u = F.when(F.col("page_id") % len(ORIGINS) == k, F.replace(F.lit(form), F.lit("%"), F.col("page_id").cast("string"))).otherwise(u)
    return read(spark, sf, "pages").select("page_id", X.origin_key(u).alias("k"))


@query("sf13_license_class", """SELECT page_id, CASE WHEN page_id%6 IN (0,1) THEN 'admissible' ELSE 'excluded' END AS status, CASE page_id%6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'AGPL-3.0 — copyleft, incompatible with proprietary redistribution'
 WHEN 3 THEN 'Qwen RESEARCH LICENSE AGREEMENT — non-commercial only' ELSE 'unrecognised licence — cannot verify redistribution rights' END AS reason FROM pages""")
def _(spark, sf):
    n = F.expr("CASE page_id % 6 WHEN 0 THEN ' MIT ' WHEN 1 THEN 'bsd-2-CLAUSE' WHEN 2 THEN 'AGPL-3.0' WHEN 3 THEN 'Qwen-Research' WHEN 4 THEN 'zlib' ELSE url END")
    return read(spark, sf, "pages").select("page_id", *[c.alias(k) for k, c in X.license_class(n).items()])


@query("sf16_crate_name", "SELECT p_partkey, replace(lower(p_brand||'-X-'||p_name),'-','_') AS n FROM part")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.crate_name(F.concat("p_brand", F.lit("-X-"), "p_name")).alias("n"))


# ---- maintenance


@query("snk1_entity_upsert", "SELECT COALESCE(n.doc_id,o.doc_id) AS id, COALESCE(CASE WHEN n.q=1 THEN 's'||n.q END, o.lang) AS summary, CASE WHEN n.doc_id IS NOT NULL THEN n.q ELSE o.k END AS v FROM (SELECT doc_id, lang, CAST(n_chars AS BIGINT) AS k FROM documents WHERE doc_id<800) o FULL JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS q FROM labels) n ON o.doc_id=n.doc_id")
def _(spark, sf):
    old = read(spark, sf, "documents").where("doc_id < 800").select(F.col("doc_id").alias("id"), F.col("lang").alias("summary"), F.col("n_chars").alias("v"))
    new = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.concat(F.lit("s"), "quality")).alias("summary"), F.col("quality").cast("bigint").alias("v"))
    return K.upsert(old, new, ["id"], keep_if_null=["summary"])


@query("snk2_edge_upsert", "SELECT o_custkey AS source_id, l_suppkey AS target_id, arg_max(l_quantity, (l_orderkey*10+l_linenumber, l_quantity)) AS weight FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2")
def _(spark, sf):
    i = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = i.select(F.col("o_custkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return K.last_wins(rows, ["source_id", "target_id"], ["at", "weight"]).drop("at")


@query("snk3_snk4_keep_detected_at", "SELECT COALESCE(n.doc_id,o.doc_id) AS id, COALESCE(o.t,n.t) AS detected_at, COALESCE(n.s,o.s) AS severity FROM (SELECT doc_id, 1 AS t, 'old' AS s FROM documents WHERE doc_id%2=0) o FULL JOIN (SELECT doc_id, 2 AS t, lang AS s FROM documents WHERE doc_id%3=0) n ON o.doc_id=n.doc_id")
def _(spark, sf):
    d = read(spark, sf, "documents")
    old = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit(1).alias("detected_at"), F.lit("old").alias("severity"))
    new = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit(2).alias("detected_at"), F.col("lang").alias("severity"))
    return K.upsert(old, new, ["id"], keep_old=["detected_at"])


@query("snk6_batch_edges", with_cte(["fimports", "ents"], "SELECT source_id, target_id FROM fimports WHERE source_id IN (SELECT id FROM ents WHERE tier='file' AND starts_with(path,'ASIA/')) AND target_id IN (SELECT id FROM ents WHERE tier='file' AND starts_with(path,'ASIA/')) UNION ALL SELECT source_id, target_id FROM fimports WHERE source_id NOT IN (SELECT id FROM ents WHERE starts_with(path,'ASIA/'))"))
def _(spark, sf):
    e = A.entities(spark, sf).where("tier = 'file'").withColumn("repo_id", F.split_part("path", F.lit("/"), F.lit(1)))
    edges = file_imports(spark, sf)
    _, out = K.replace_repo(e, edges, e.where("repo_id = 'ASIA'"), edges, "ASIA")
    return out.select("source_id", "target_id")


@query("snk7_reconcile", with_cte(["ents"], """, f AS (SELECT * FROM ents WHERE tier='file' AND CAST(split_part(id,':',2) AS BIGINT)%4<>0 AND parent_id NOT IN ('module:0','module:5')), m AS (SELECT * FROM ents WHERE tier='module' AND id IN (SELECT parent_id FROM f))
 SELECT id, tier FROM f UNION ALL SELECT id, tier FROM m UNION ALL SELECT id, tier FROM ents WHERE tier='subsystem' AND id IN (SELECT parent_id FROM m) UNION ALL SELECT id, tier FROM ents WHERE tier='function' AND parent_id IN (SELECT id FROM f)""").replace("\n, f AS", ", f AS"))
def _(spark, sf):
    e = held_entities(spark, sf)
    disk = e.where("tier = 'file' and cast(split_part(id, ':', 2) as bigint) % 4 <> 0 and parent_id not in ('module:0', 'module:5')").select("path")
    return K.reconcile(e, file_imports(spark, sf), disk)[0].select("id", "tier")


@query("snk7_reconcile_edges", with_cte(["fimports"], "SELECT source_id, target_id FROM fimports WHERE CAST(split_part(source_id,':',2) AS BIGINT)%4<>0 AND CAST(split_part(target_id,':',2) AS BIGINT)%4<>0"))
def _(spark, sf):
    e = held_entities(spark, sf)
    disk = e.where("tier = 'file' and cast(split_part(id, ':', 2) as bigint) % 4 <> 0").select("path")
    return K.reconcile(e, file_imports(spark, sf), disk)[1].select("source_id", "target_id")


@query("snk8_cascade_delete", with_cte(["ents"], ", s AS (SELECT id FROM ents WHERE id IN ('module:3','subsystem:1') UNION SELECT e.id FROM ents e JOIN s ON e.parent_id=s.id) SELECT id FROM ents WHERE id NOT IN (SELECT id FROM s)").replace("\n, s AS", ", s AS"))
def _(spark, sf):
    return K.cascade_delete(A.entities(spark, sf), spark.createDataFrame([("module:3",), ("subsystem:1",)], "id string")).select("id")


@query("snk10_delete_counts", with_cte(["ents", "fimports"], ", s AS (SELECT id FROM ents WHERE id='module:3' UNION SELECT e.id FROM ents e JOIN s ON e.parent_id=s.id) SELECT (SELECT count(*) FROM s) AS entities, (SELECT count(*) FROM fimports WHERE source_id IN (SELECT id FROM s) OR target_id IN (SELECT id FROM s)) AS relationships").replace("\n, s AS", ", s AS"))
def _(spark, sf):
    e = A.entities(spark, sf)
    return K.delete_counts(e, file_imports(spark, sf), K.subtree(e, spark.createDataFrame([("module:3",)], "id string")))


@query("snk11_move_repo", with_cte(["ents"], "SELECT id, CASE WHEN starts_with(path,'ASIA/') THEN 'q' ELSE 'p' END AS project_id FROM ents WHERE tier='file'"))
def _(spark, sf):
    e = A.entities(spark, sf).where("tier = 'file'").withColumn("repo_id", F.split_part("path", F.lit("/"), F.lit(1)))
    return K.move_repo(e, "ASIA", "q").select("id", "project_id")


@query("snk12_clear_summaries", with_cte(["ents"], "SELECT id, CASE WHEN NOT starts_with(path,'ASIA/') THEN summary END AS summary FROM ents WHERE tier='file'"))
def _(spark, sf):
    return K.clear_summaries(A.entities(spark, sf).where("tier = 'file'"), F.col("path").startswith("ASIA/")).select("id", "summary")


@query("snk13_invalidate_insights", "SELECT COALESCE(n.doc_id,o.doc_id) AS id, COALESCE(o.t,2) AS detected_at, n.doc_id IS NOT NULL AS still_valid FROM (SELECT doc_id, 1 AS t FROM documents WHERE doc_id%2=0) o FULL JOIN (SELECT doc_id FROM documents WHERE doc_id%3=0) n ON o.doc_id=n.doc_id")
def _(spark, sf):
    d = read(spark, sf, "documents")
    row = lambda cond, t: d.where(cond).select(F.col("doc_id").alias("id"), F.lit(t).alias("detected_at"), F.lit(True).alias("still_valid"))
    return K.invalidate(row("doc_id % 2 = 0", 1), row("doc_id % 3 = 0", 2))


@query("snk14_latest_run", "SELECT user_id, event_type AS status FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn=1")
def _(spark, sf):
    return K.latest(read(spark, sf, "events"), "user_id", "event_id").select("user_id", F.col("event_type").alias("status"))


@query("snk17_ndjson", """SELECT '{"p_partkey":'||p_partkey||',"p_name":"'||p_name||'","note":null}' AS value FROM part""")
def _(spark, sf):
    return K.ndjson(read(spark, sf, "part").withColumn("note", F.lit(None).cast("string")), ["p_partkey", "p_name", "note"])


@query("set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'without', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)")
def _(spark, sf):
    o, c = read(spark, sf, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(o.intersect(c), "both").unionByName(n(c.join(o, "k", "left_anti").distinct(), "without")).unionByName(n(c.union(o).distinct(), "either"))


@query("gr9_module_flow_edges", with_cte(["modedges"], "SELECT source_id, target_id FROM modedges"))
def _(spark, sf):
    return G.flow_edges(A.entities(spark, sf), module_edges(spark, sf).withColumn("rel_type", F.lit("depends_on")))


@query("gr9_call_flow_edges", with_cte(["calls"], "SELECT source_id, target_id FROM calls"))
def _(spark, sf):
    return G.flow_edges(A.entities(spark, sf), order_calls(spark, sf))


@query("ag6_types_only", with_cte(["g"], "SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT target_id AS id, 1 AS i, 0 AS o FROM g WHERE rel_type IN ('imports','calls','depends_on') UNION ALL SELECT source_id, 0, 1 FROM g WHERE rel_type IN ('imports','calls','depends_on')) GROUP BY 1"))
def _(spark, sf):
    return E.coupling(graph_edges(spark, sf), ["imports", "calls", "depends_on"])


# ---- import resolution on files made from pages

#: Files src/m0.tsx, src/m0.js or src/m0/index.js, src/m0/index.ts, src/m1.tsx, ...
JS_FILES = "SELECT 'src/m'||(page_id//3)||CASE page_id%3 WHEN 0 THEN '.tsx' WHEN 1 THEN CASE WHEN page_id%2=0 THEN '.js' ELSE '/index.js' END ELSE '/index.ts' END AS path FROM pages"
JS_TRIED = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", "/index.mjs"]


def _js_files(spark, sf) -> DataFrame:
    page = F.expr("concat('src/m', page_id div 3, CASE page_id % 3 WHEN 0 THEN '.tsx' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN '.js' ELSE '/index.js' END ELSE '/index.ts' END)")
    return read(spark, sf, "pages").select(page.alias("path")).withColumn("id", F.col("path"))


@query("jn8_jn10_js_imports", f"""WITH f AS ({JS_FILES}), i AS (SELECT page_id AS row_id, 'src/m'||(page_id//2)||CASE WHEN page_id%8=2 THEN '.tsx' ELSE '' END AS base FROM pages WHERE page_id%8<>6),
 c AS (SELECT row_id, unnest([{",".join(f"base||'{e}'" for e in JS_TRIED)}]) AS path, unnest(range({len(JS_TRIED)})) AS priority FROM i)
 SELECT row_id, arg_min(f.path, priority) AS target FROM c JOIN f ON c.path=f.path GROUP BY row_id""")
def _(spark, sf):
    spec = F.expr("""CASE page_id % 8 WHEN 0 THEN concat('../m', page_id div 2) WHEN 1 THEN concat('@/m', page_id div 2) WHEN 2 THEN concat('/src//m', page_id div 2, '.tsx') WHEN 3 THEN concat('m', page_id div 2)
     WHEN 4 THEN concat('pkg/m', page_id div 2) WHEN 5 THEN concat('./../../src/./m', page_id div 2) WHEN 6 THEN concat('react/m', page_id div 2) ELSE concat('~m', page_id div 2, '!') END""")
    imports = read(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.lit("src/app/x.js").alias("importing"), spec.alias("spec"))
    js = {"aliases": [("@/*", ["lib/*", "./src/*"]), ("@/none", ["src/none"]), ("~*!", ["src/*"])], "packages": {"pkg": "src"}, "declared": ["react"], "roots": ["src"]}
    return V.js_imports(imports, _js_files(spark, sf), js)


@query("jn7_rust_relative", """SELECT page_id AS row_id, CASE page_id%6 WHEN 0 THEN 'src/a'||page_id||'.rs' WHEN 1 THEN 'src/lib.rs' WHEN 2 THEN 'src/b'||page_id||'/mod.rs' WHEN 3 THEN 'src/a'||page_id||'.rs' ELSE NULL END AS target FROM pages WHERE page_id%6<4""")
def _(spark, sf):
    p = read(spark, sf, "pages")
    files = p.select(F.concat(F.lit("src/a"), "page_id", F.lit(".rs")).alias("path")).unionByName(p.select(F.concat(F.lit("src/b"), "page_id", F.lit("/mod.rs")).alias("path"))).unionByName(spark.createDataFrame([("src/lib.rs",)], "path string"))
    importing = F.expr("CASE page_id % 6 WHEN 0 THEN concat('src/a', page_id, '/x.rs') WHEN 1 THEN concat('src/b', page_id, '/x.rs') WHEN 2 THEN concat('src/b', page_id, '/y/mod.rs') WHEN 3 THEN concat('src/a', page_id, '.rs') WHEN 4 THEN 'src/lib.rs' ELSE 'src/c/d.rs' END")
    spec = F.expr("CASE page_id % 6 WHEN 0 THEN 'super::Item' WHEN 1 THEN 'super::super::z::*' WHEN 2 THEN 'super::q::r' WHEN 3 THEN 'self::sub::Item' WHEN 4 THEN 'super::Item' ELSE 'super::Item' END")
    rows = p.select(F.col("page_id").alias("row_id"), importing.alias("importing"), spec.alias("spec"))
    return V.rust_relative(rows, files.withColumn("id", F.col("path")))


@query("jn5_import_keys", """WITH f AS (SELECT page_id AS id, CASE page_id%5 WHEN 0 THEN 'src/a/m'||page_id||'.rs' WHEN 1 THEN 'src/a/m'||page_id||'/mod.rs' WHEN 2 THEN 'core/src/m'||page_id||'.py' WHEN 3 THEN 'src/same.ts' ELSE 'src/m'||page_id||'.go' END AS path FROM pages),
 k AS (SELECT id, path AS key, 0 AS how FROM f UNION ALL SELECT id, unnest(['crate::','Repo::'])||replace(regexp_replace(regexp_replace(regexp_replace(path,'^src/',''),'[.](rs|py|ts|js)$',''),'/mod$',''),'/','::'), 1 FROM f)
 SELECT key, arg_min(id, (how, id)) AS file_id FROM k GROUP BY key""")
def _(spark, sf):
    path = F.expr("CASE page_id % 5 WHEN 0 THEN concat('src/a/m', page_id, '.rs') WHEN 1 THEN concat('src/a/m', page_id, '/mod.rs') WHEN 2 THEN concat('core/src/m', page_id, '.py') WHEN 3 THEN 'src/same.ts' ELSE concat('src/m', page_id, '.go') END")
    return V.import_keys(read(spark, sf, "pages").select(F.col("page_id").alias("id"), path.alias("path")), "Repo")
