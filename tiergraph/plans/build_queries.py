"""Queries over building the graph: scans, edges, metrics, detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.functions import text as X
from tiergraph.operators import detect as D
from tiergraph.operators import edges as E
from tiergraph.operators import metrics as M
from tiergraph.plans.registry import query
from tiergraph.sources import adapters as A
from tiergraph.sources.adapters import read, with_cte


def edges_of(spark: SparkSession, sf: str) -> DataFrame:
    return E.aggregate(A.edge_hits(spark, sf))


def module_edges(spark: SparkSession, sf: str) -> DataFrame:
    return E.lift(edges_of(spark, sf), A.owners(spark, sf))


def coupled_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Module edges above 1.3 times their mean weight, the sparse graph of the fixtures."""
    rows = module_edges(spark, sf)
    return rows.crossJoin(F.broadcast(rows.agg(F.avg("weight").alias("mean")))).where("weight > 1.3 * mean").drop("mean")  # one row


def top_edges(spark: SparkSession, sf: str, n: int) -> DataFrame:
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("weight"), "target_id"))
    return module_edges(spark, sf).withColumn("rn", rn).where(F.col("rn") <= n).drop("rn")


# ---- scans


@query("src18_scan_by_project_tier", with_cte(["ents"], "SELECT id, name, path FROM ents WHERE project_id='p' AND tier='file'"))
def _(spark, sf):
    return A.entities(spark, sf).where("project_id = 'p' and tier = 'file'").select("id", "name", "path")


@query("src18_scan_by_parent", with_cte(["ents"], "SELECT id, tier, name FROM ents WHERE parent_id='module:7'"))
def _(spark, sf):
    return A.entities(spark, sf).where("parent_id = 'module:7'").select("id", "tier", "name")


@query("src18_scan_by_path", with_cte(["ents"], "SELECT id, tier FROM ents WHERE path IN (SELECT path FROM ents WHERE id IN ('file:10','module:3'))"))
def _(spark, sf):
    e = A.entities(spark, sf)
    return e.join(e.where("id in ('file:10', 'module:3')").select("path"), "path", "left_semi").select("id", "tier")


@query("src18_count_entities", with_cte(["ents"], "SELECT tier, count(*) AS n, count_if(summary IS NULL) AS missing FROM ents GROUP BY tier"))
def _(spark, sf):
    return A.entities(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("summary").isNull()).alias("missing"))


@query("src12_snapshot_diff", """SELECT COALESCE(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM (SELECT doc_id, CASE WHEN doc_id%10=0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id%13<>0) o
 FULL JOIN (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id%17<>0) n ON o.doc_id=n.doc_id WHERE o.h IS DISTINCT FROM n.h""")
def _(spark, sf):
    from tiergraph.operators.sinks import snapshot_diff

    d = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    old = d.where("path % 13 <> 0").withColumn("content_hash", F.when(F.col("path") % 10 == 0, "old").otherwise(F.col("content_hash")))
    return snapshot_diff(old, d.where("path % 17 <> 0"))


@query("src7_imports_by_pattern", r"""SELECT page_id, u.href AS href FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html,'href="([^"]+)"',1))) AS href FROM pages) u""")
def _(spark, sf):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1)))
    return read(spark, sf, "pages").select("page_id", F.explode(found).alias("href"))


@query("src9_complexity_by_pattern", r"""SELECT doc_id, 1+len(regexp_extract_all(lower(text),'(^|[^a-z])(in|the|of)([^a-z]|$)')) AS complexity, len(regexp_extract_all(lower(text),'(^|[^a-z])(in|the|of)([^a-z]|$)'))>0 AS has_branches FROM documents""")
def _(spark, sf):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"(^|[^a-z])(in|the|of)([^a-z]|$)"), F.lit(0)))
    return read(spark, sf, "documents").select("doc_id", (n + 1).cast("bigint").alias("complexity"), (n > 0).alias("has_branches"))


#: A Rust file of each document: an import, and a function with some branches, loops and calls; or the import alone.
RUST = "'use crate::m'||doc_id||';'||chr(10)||CASE WHEN doc_id%10=0 THEN '' ELSE chr(10)||'pub fn f'||doc_id||'(a: u8) {'||chr(10)||repeat('    if a > 1 { g(a); }'||chr(10),CAST(doc_id%4 AS INT))||repeat('    for x in y { h::k(x); }'||chr(10),CAST(doc_id%3 AS INT))||CASE WHEN doc_id%5=1 THEN '    match a { 1 if a > 0 => w.n(a), _ => { } }'||chr(10) ELSE '' END||'}'||chr(10) END"


def _rust_files(spark, sf) -> DataFrame:
    code = F.expr(
        "concat('use crate::m', doc_id, ';\\n', CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('\\npub fn f', doc_id, '(a: u8) {\\n', repeat('    if a > 1 { g(a); }\\n', CAST(doc_id % 4 AS INT)), "
        "repeat('    for x in y { h::k(x); }\\n', CAST(doc_id % 3 AS INT)), CASE WHEN doc_id % 5 = 1 THEN '    match a { 1 if a > 0 => w.n(a), _ => { } }\\n' ELSE '' END, '}\\n') END)"
    )
    return read(spark, sf, "documents").select(F.concat(F.lit("src/m"), "doc_id", F.lit(".rs")).alias("path"), F.lit("Rust").alias("language"), code.cast("binary").alias("content"))


@query("src2_src10_rust_units", f"""SELECT 'src/m'||doc_id||'.rs' AS file, CASE WHEN doc_id%10=0 THEN '' ELSE 'f'||doc_id END AS name, CASE WHEN doc_id%10=0 THEN 'file_imports_marker' ELSE 'function' END AS unit_type,
 CAST(CASE WHEN doc_id%10=0 THEN 1 ELSE 3 END AS BIGINT) AS line, CAST(CASE WHEN doc_id%10=0 THEN 1 ELSE 4+b+l+m END AS BIGINT) AS end_line, CAST(CASE WHEN doc_id%10=0 THEN 0 ELSE 1+b+l+m END AS BIGINT) AS complexity, doc_id%10<>0 AND b+m>0 AS has_branches, doc_id%10<>0 AND l>0 AS has_loops, doc_id%10<>0 AND m>0 AS has_error_handling,
 CASE WHEN doc_id%10=0 THEN '' ELSE repeat('g,',CAST(b AS INT))||repeat('n,',CAST(m AS INT)) END AS calls, 'crate::m'||doc_id AS imports, CASE WHEN doc_id%10=0 THEN NULL ELSE regexp_extract({RUST},'(?s)pub fn.*}}') END AS code
 FROM (SELECT doc_id, doc_id%4 AS b, doc_id%3 AS l, CASE WHEN doc_id%5=1 THEN 1 ELSE 0 END AS m FROM documents)""")
def _(spark, sf):
    from tiergraph.sources.extract import code_units

    rows = code_units(_rust_files(spark, sf))
    calls = F.concat(F.array_join("calls", ","), F.when(F.size("calls") > 0, ",").otherwise(""))
    return rows.select("file", "name", "unit_type", "line", "end_line", "complexity", "has_branches", "has_loops", "has_error_handling", calls.alias("calls"), F.array_join("imports", "|").alias("imports"), "code")


@query("src13_test_functions", "SELECT 'src/m'||doc_id||'.rs' AS file, 'checks'||doc_id AS name FROM documents WHERE doc_id%3=1")
def _(spark, sf):
    from tiergraph.plans.refresh import cfg_tests

    d = F.col("doc_id")
    code = F.concat(F.lit("fn real() { }\n"), F.when(d % 3 == 1, "#[cfg(test)]\nmod tests {\n").when(d % 3 == 2, "#[cfg(unix)]\nmod inner {\n").otherwise("mod plain {\n"), F.lit("    fn checks"), d, F.lit("() { let s = \"}\"; }\n}\n"))
    return cfg_tests(read(spark, sf, "documents").select(F.concat(F.lit("src/m"), d, F.lit(".rs")).alias("path"), F.lit("Rust").alias("language"), code.cast("binary").alias("content")))


# ---- edges


@query("ag1_edge_aggregation", with_cte(["edges"], "SELECT source_id, target_id, rel_type, weight, provenance FROM edges"))
def _(spark, sf):
    return edges_of(spark, sf)


@query("ag1_edge_evidence", with_cte(["hits"], "SELECT source_id, target_id, rel_type, CAST(count(*) AS DOUBLE) AS weight, CASE WHEN bool_or(provenance='resolved') THEN 'resolved' ELSE 'heuristic' END AS provenance, string_agg(source_line, ',' ORDER BY source_line) AS evidence FROM hits GROUP BY 1,2,3"))
def _(spark, sf):
    rows = E.aggregate(A.edge_hits(spark, sf), ["source_line"])
    return rows.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: e["source_line"].cast("string")), ","))


@query("ag2_module_depends_on", with_cte(["modedges"], "SELECT * FROM modedges"))
def _(spark, sf):
    return module_edges(spark, sf)


@query("ag3_subsystem_depends_on", with_cte(["subedges"], "SELECT * FROM subedges"))
def _(spark, sf):
    return E.lift(module_edges(spark, sf), A.module_owners(spark, sf))


@query("ag6_coupling", with_cte(["edges"], "SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT target_id AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT source_id, 0, 1 FROM edges) GROUP BY id"))
def _(spark, sf):
    return E.coupling(edges_of(spark, sf), ["imports", "calls", "depends_on"])


@query("ag9_unresolved_imports", """SELECT count_if(h LIKE '%example.com%') AS unresolved_internal, count_if(h NOT LIKE '%example.com%') AS unresolved_external FROM
 (SELECT regexp_extract(url,'^https?://(.*)$',1) AS h FROM pages) a WHERE h NOT IN (SELECT regexp_extract(url,'^https?://(.*)$',1) FROM pages WHERE page_id%3<>0)""")
def _(spark, sf):
    spec = read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://(.*)$", 1).alias("spec"))
    left = spec.join(spec.where("page_id % 3 <> 0").select("spec").distinct(), "spec", "left_anti")
    inside = F.col("spec").contains("example.com")
    return left.agg(F.count_if(inside).alias("unresolved_internal"), F.count_if(~inside).alias("unresolved_external"))


@query("sf15_unresolved_class", """SELECT page_id, CASE WHEN starts_with(url,'https://') THEN 'internal' ELSE 'external' END AS kind FROM pages""")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", E.unresolved_class(F.col("url"), ["https://"]).alias("kind"))


@query("ag12_edge_census", with_cte(["edges"], "SELECT count_if(provenance='resolved') AS resolved, count_if(provenance='heuristic') AS heuristic_only, count(*) AS all_pairs FROM edges"))
def _(spark, sf):
    return E.census(A.edge_hits(spark, sf))


@query("ag13_wrong_edge_rate", """SELECT count_if(l_returnflag<>'N') AS evidenced, count_if(l_returnflag<>'N' AND l_linestatus<>'F') AS wrong, round(count_if(l_returnflag<>'N' AND l_linestatus<>'F')/count_if(l_returnflag<>'N'),6) AS wrong_edge_rate FROM lineitem""")
def _(spark, sf):
    return E.wrong_edge_rate(read(spark, sf, "lineitem").select((F.col("l_returnflag") != "N").alias("has_evidence"), (F.col("l_linestatus") == "F").alias("verified")))


@query("rk11_edge_sample", with_cte(["edges"], "SELECT DISTINCT source_id, target_id FROM edges ORDER BY 1,2 LIMIT 100"))
def _(spark, sf):
    return E.sample_edges(edges_of(spark, sf), 100)


@query("jn22_drop_dangling", with_cte(["edges"], "SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT 'file:'||c_custkey FROM customer WHERE c_custkey%2=0) AND target_id IN (SELECT 'supplier:'||s_suppkey FROM supplier WHERE s_suppkey%3=0)"))
def _(spark, sf):
    ids = A.owners(spark, sf).select(F.col("child").alias("id"), F.split_part("child", F.lit(":"), F.lit(2)).cast("bigint").alias("k"))
    keep = ids.where("(startswith(id, 'file') and k % 2 = 0) or (startswith(id, 'supplier') and k % 3 = 0)")
    return E.drop_dangling(edges_of(spark, sf), keep).select("source_id", "target_id")


# ---- metrics

FM = "lines, code_units, complexity_sum, complexity_max, round(complexity_avg,6) AS complexity_avg, has_branches_count, has_loops_count, has_error_handling_count"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("complexity_avg", F.round("complexity_avg", 6))


def zero_filled(spark, sf) -> DataFrame:
    return M.fill_zero(A.files(spark, sf).select("id", "parent_id"), M.file_metrics(A.code_units(spark, sf)))


ZERO = """SELECT f.id, f.parent_id, COALESCE(lines,0) AS lines, COALESCE(code_units,0) AS code_units, COALESCE(complexity_sum,0) AS complexity_sum, COALESCE(complexity_max,0) AS complexity_max,
 COALESCE(complexity_avg,0) AS complexity_avg, COALESCE(has_branches_count,0) AS has_branches_count, COALESCE(has_loops_count,0) AS has_loops_count, COALESCE(has_error_handling_count,0) AS has_error_handling_count
 FROM (SELECT 'file:'||c_custkey AS id, 'module:'||c_nationkey AS parent_id FROM customer) f LEFT JOIN filemetrics m ON f.id=m.file"""
ROLL = """parent_id, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(code_units) AS BIGINT) AS code_units, CAST(sum(complexity_sum) AS BIGINT) AS complexity_sum, CAST(sum(has_branches_count) AS BIGINT) AS has_branches_count,
 CAST(sum(has_loops_count) AS BIGINT) AS has_loops_count, CAST(sum(has_error_handling_count) AS BIGINT) AS has_error_handling_count, max(complexity_max) AS complexity_max, round(CASE WHEN sum(code_units)>0 THEN sum(complexity_sum)/sum(code_units) ELSE 0 END,6) AS complexity_avg"""


@query("ag4_file_metrics", with_cte(["filemetrics"], f"SELECT file, {FM} FROM filemetrics"))
def _(spark, sf):
    return _rounded(M.file_metrics(A.code_units(spark, sf)))


@query("ag5_zero_filled_metrics", with_cte(["filemetrics"], f"SELECT id, parent_id, {FM} FROM ({ZERO})"))
def _(spark, sf):
    return _rounded(zero_filled(spark, sf))


@query("ag7_module_metrics", with_cte(["filemetrics"], f"SELECT {ROLL}, count(*) AS file_count FROM ({ZERO}) GROUP BY parent_id"))
def _(spark, sf):
    return _rounded(M.roll_up(zero_filled(spark, sf), "file_count"))


@query(
    "ag8_subsystem_metrics",
    with_cte(["filemetrics"], f"SELECT {ROLL}, CAST(sum(file_count) AS BIGINT) AS file_count, count(*) AS module_count FROM (SELECT m.* EXCLUDE (parent_id), 'subsystem:'||n_regionkey AS parent_id FROM (SELECT {ROLL}, count(*) AS file_count FROM ({ZERO}) GROUP BY parent_id) m JOIN nation ON m.parent_id='module:'||n_nationkey) GROUP BY parent_id"),
)
def _(spark, sf):
    mods = M.roll_up(zero_filled(spark, sf), "file_count").withColumnRenamed("parent_id", "child")
    up = mods.join(F.broadcast(A.module_owners(spark, sf)), "child").withColumnRenamed("parent", "parent_id")  # 25 rows
    return _rounded(M.roll_up(up, "module_count", ["file_count"]))


@query("ag18_most_common_language", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY 1,2) WHERE rn=1")
def _(spark, sf):
    return M.most_common(read(spark, sf, "documents"), "source", "lang")


@query("rk4_hotspots", with_cte(["units"], "SELECT file AS id, max(complexity) AS complexity FROM units GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def _(spark, sf):
    rows = M.file_metrics(A.code_units(spark, sf)).select(F.col("file").alias("id"), F.col("complexity_max").alias("complexity"))
    return M.hotspots(rows, 20)


@query("rk5_hotspots_of_tier", with_cte(["units"], "SELECT id, name, complexity FROM units ORDER BY complexity DESC, name LIMIT 50"))
def _(spark, sf):
    return M.hotspots(A.code_units(spark, sf).select("id", "name", "complexity", F.lit("function").alias("tier")), 50, "name", "function").drop("tier")


@query("sf14_json_number", "SELECT event_id, CASE WHEN json_type(props,'$.k') IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(props->>'$.k' AS DOUBLE) ELSE 0.0 END AS k FROM events")
def _(spark, sf):
    return read(spark, sf, "events").select("event_id", M.complexity_of(F.col("props"), "k").alias("k"))


@query("ag14_summary_coverage", with_cte(["ents"], "SELECT tier, count(*) AS total, count(summary) AS summarized, round(100.0*count(summary)/count(*),1) AS pct FROM ents GROUP BY tier"))
def _(spark, sf):
    n, k = F.count(F.lit(1)), F.count("summary")
    return A.entities(spark, sf).groupBy("tier").agg(n.alias("total"), k.alias("summarized"), F.round(100.0 * k / n, 1).alias("pct"))


@query("ag15_status_counts", with_cte(["ents", "edges"], "SELECT 'entity' AS kind, tier AS name, count(*) AS n FROM ents GROUP BY tier UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type"))
def _(spark, sf):
    n = F.count(F.lit(1)).alias("n")
    e = A.entities(spark, sf).groupBy(F.lit("entity").alias("kind"), F.col("tier").alias("name")).agg(n)
    return e.unionByName(edges_of(spark, sf).groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("name")).agg(n))


@query("ag16_missing_summaries", with_cte(["ents"], "SELECT tier, count(*) AS n FROM ents WHERE summary IS NULL AND NOT starts_with(lower(name),'test_') GROUP BY tier"))
def _(spark, sf):
    return A.entities(spark, sf).where(X.missing_summary(F.col("summary"), F.col("name"))).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("ag17_parse_success", "SELECT turn AS batch_size, count(*) AS total, count_if(role='assistant') AS parsed, round(100.0*count_if(role='assistant')/count(*),4) AS pct FROM conversations GROUP BY ROLLUP(turn)")
def _(spark, sf):
    n, k = F.count(F.lit(1)), F.count_if(F.col("role") == "assistant")
    return read(spark, sf, "conversations").rollup(F.col("turn").alias("batch_size")).agg(n.alias("total"), k.alias("parsed"), F.round(100.0 * k / n, 4).alias("pct"))


#: Units made of documents, and import edges of those that are labelled.
COVERED = """u AS (SELECT doc_id, lang, source||'/f'||(doc_id%7)||CASE WHEN doc_id%11=0 THEN '_test.py' ELSE '.py' END AS file, 'f'||(doc_id%5) AS name, doc_id%4<>0 AS fn, doc_id%3=0 AS method, CASE WHEN doc_id%2=0 THEN ['x','g'] ELSE ['name'||(doc_id%50)] END AS calls, doc_id%11=0 AS test FROM documents),
 r AS (SELECT file AS source, CASE WHEN doc_id%13=0 THEN file ELSE 'other' END AS target FROM u WHERE doc_id IN (SELECT doc_id FROM labels)),
 n AS (SELECT lang, name, count(*) AS k FROM u WHERE fn AND NOT test AND NOT method GROUP BY 1,2), m AS (SELECT lang, arg_min(name,(-k,name)) AS max_fan_out_name, max(k) AS max_fan_out FROM n GROUP BY 1),
 c AS (SELECT lang, name, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, name) AS rk FROM (SELECT lang, unnest(calls) AS name FROM u) GROUP BY 1,2), s AS (SELECT lang, string_agg(name, ',' ORDER BY rk) AS single FROM c WHERE rk<=20 AND length(name)=1 GROUP BY 1),
 cov AS (SELECT u.lang AS lang, count(*) AS entities, count(DISTINCT CASE WHEN NOT test THEN file END) AS symbol_files, count(DISTINCT CASE WHEN NOT test AND file IN (SELECT source FROM r WHERE source<>target) THEN file END) AS resolved_files FROM u GROUP BY 1)"""


def _coverage(spark, sf) -> DataFrame:
    from tiergraph.quality import language_coverage

    k = F.col("doc_id")
    units = read(spark, sf, "documents").select(
        k, F.col("lang").alias("language"), F.concat("source", F.lit("/f"), k % 7, F.when(k % 11 == 0, "_test.py").otherwise(".py")).alias("file"), F.concat(F.lit("f"), k % 5).alias("name"),
        F.when(k % 4 != 0, "Function").otherwise("struct").alias("unit_type"), F.when(k % 3 == 0, "fn f(&self) { }").otherwise("fn f(selfish: u8) { self }").alias("code"),
        F.when(k % 2 == 0, F.array(F.lit("x"), F.lit("g"))).otherwise(F.array(F.concat(F.lit("name"), k % 50))).alias("calls"),
    )
    edges = units.join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(F.col("file").alias("source"), F.when(k % 13 == 0, F.col("file")).otherwise("other").alias("target"))
    return language_coverage(units, edges)


@query("ag10_language_coverage", f"WITH {COVERED} SELECT cov.lang AS language, entities, symbol_files, resolved_files, max_fan_out_name, COALESCE(max_fan_out,0) AS max_fan_out, COALESCE(single,'') AS single_char_callees FROM cov LEFT JOIN m ON cov.lang=m.lang LEFT JOIN s ON cov.lang=s.lang")
def _(spark, sf):
    return _coverage(spark, sf).withColumn("single_char_callees", F.array_join("single_char_callees", ","))


@query("ag11_coverage_gate", f"""WITH {COVERED} SELECT lang AS language, 'fan-out '||max_fan_out||' for bare name '''||max_fan_out_name||''' exceeds threshold 10 (language '''||lang||''')' AS reason FROM m WHERE max_fan_out>10
 UNION ALL SELECT lang, 'single-character callee names in top-N callees: '''||replace(single,',',''', ''')||''' (language '''||lang||''')' FROM s""")
def _(spark, sf):
    from tiergraph.quality import coverage_gate

    return coverage_gate(_coverage(spark, sf))


# ---- detection

LADDER = "CASE WHEN ratio>4 THEN 'critical' WHEN ratio>3 THEN 'high' WHEN ratio>2 THEN 'medium' WHEN ratio>=1.5 THEN 'low' END"


@query("in1_file_hotspots", f"SELECT id, value, round(ratio,6) AS ratio, severity FROM (SELECT *, {LADDER} AS severity FROM (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS value, n_chars/(SELECT avg(n_chars) FROM documents) AS ratio FROM documents)) WHERE severity IS NOT NULL")
def _(spark, sf):
    return D.hotspots(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("value"))).withColumn("ratio", F.round("ratio", 6))


@query("in2_function_hotspots", f"SELECT id, round(value,6) AS value, round(ratio,4) AS ratio, severity FROM (SELECT *, {LADDER} AS severity FROM (SELECT event_id AS id, value, value/(SELECT avg(value) FROM events) AS ratio FROM events)) WHERE severity IS NOT NULL")
def _(spark, sf):
    rows = D.hotspots(read(spark, sf, "events").select(F.col("event_id").alias("id"), "value"))
    return rows.withColumn("ratio", F.round("ratio", 4)).withColumn("value", F.round("value", 6))


IN3 = """, fans AS (SELECT n.id, COALESCE(i,0) AS fan_in, COALESCE(o,0) AS fan_out FROM (SELECT 'module:'||n_nationkey AS id FROM nation {where}) n LEFT JOIN (SELECT target_id, count(*) AS i FROM coupled GROUP BY 1) a ON n.id=a.target_id LEFT JOIN (SELECT source_id, count(*) AS o FROM coupled GROUP BY 1) b ON n.id=b.source_id),
 t AS (SELECT count(*) AS total FROM fans), ri AS (SELECT fan_in AS v, row_number() OVER (ORDER BY fan_in)-1 AS k FROM fans), ro AS (SELECT fan_out AS v, row_number() OVER (ORDER BY fan_out)-1 AS k FROM fans),
 c AS (SELECT p, least(greatest((SELECT v FROM ri WHERE k=least(total*p//100,total-1)),3),greatest((SELECT v FROM ro WHERE k=least(total*p//100,total-1)),3)) AS cut, total FROM (VALUES (95),(90),(80)) x(p), t),
 cc AS (SELECT total, CASE WHEN total<10 THEN 5 ELSE max(CASE WHEN p=95 THEN cut END) END AS hi, CASE WHEN total<10 THEN 5 ELSE max(CASE WHEN p=90 THEN cut END) END AS me, CASE WHEN total<10 THEN 5 ELSE max(CASE WHEN p=80 THEN cut END) END AS lo FROM c GROUP BY total)
 SELECT id, fan_in, fan_out, CASE WHEN greatest(fan_in,fan_out)>=hi THEN 'high' WHEN greatest(fan_in,fan_out)>=me THEN 'medium' ELSE 'low' END AS severity, CASE WHEN fan_in>=fan_out THEN 'fan-in' ELSE 'fan-out' END AS axis,
  total-b AS rank, CAST(round((total-b)/total*100) AS BIGINT) AS pct, total FROM (SELECT *, CASE WHEN fan_in>=fan_out THEN (SELECT count(*) FROM fans y WHERE y.fan_in<x.fan_in) ELSE (SELECT count(*) FROM fans y WHERE y.fan_out<x.fan_out) END AS b FROM fans x), cc WHERE greatest(fan_in,fan_out)>=lo"""


def _fans(spark, sf, where: str) -> DataFrame:
    ids = read(spark, sf, "nation").where(where).select(F.concat(F.lit("module:"), F.col("n_nationkey")).alias("id"))
    fans = E.coupling(coupled_edges(spark, sf).withColumn("rel_type", F.lit("depends_on")))
    return ids.join(fans, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


@query("in3_high_coupling", with_cte(["coupled"], "").rstrip() + IN3.format(where=""))
def _(spark, sf):
    return D.coupling_insights(_fans(spark, sf, "true"))


@query("in3_high_coupling_few_modules", with_cte(["coupled"], "").rstrip() + IN3.format(where="WHERE n_nationkey<9"))
def _(spark, sf):
    return D.coupling_insights(_fans(spark, sf, "n_nationkey < 9"))


def urls(spark, sf) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^https?://([^?#]+)", 1).alias("path"))


@query("in4_coverage_gaps", with_cte(["urls"], r""", f AS (SELECT page_id AS id, host AS module, regexp_extract(url,'^https?://(?:[^./]+\.)?([^./]+)\.',1) AS word, page_id%9=0 AS test, CASE WHEN page_id%3=0 THEN 'YAML' ELSE 'Rust' END AS language, page_id%40=1 AND page_id%9<>0 AS inline,
  CASE WHEN page_id%9=0 THEN translate(host,'.-','__')||'_test' ELSE 'file'||(page_id%30) END AS stem FROM urls),
 w AS (SELECT module, word FROM f UNION SELECT module, stem FROM f WHERE NOT test AND NOT inline), x AS (SELECT w.module AS module, count(DISTINCT t.id) AS across FROM f t JOIN w ON t.test AND t.module<>w.module AND strlen(w.word)>=4 AND contains('_'||replace(t.stem,'-','_')||'_','_'||w.word||'_') GROUP BY 1),
 p AS (SELECT f.module AS module, count(*) AS files, count_if(language='Rust') AS testable, count_if(test OR inline) AS direct FROM f GROUP BY 1)
 SELECT * FROM (SELECT p.module AS module, files, direct+COALESCE(across,0) AS tests, direct, COALESCE(across,0) AS across, CASE WHEN direct+COALESCE(across,0)=0 THEN 'high' WHEN (direct+COALESCE(across,0))/files<0.1 THEN 'medium' END AS severity FROM p LEFT JOIN x ON p.module=x.module WHERE testable>0) WHERE severity IS NOT NULL""").replace("\n, f AS", ", f AS"))
def _(spark, sf):
    k = F.col("page_id")
    path = F.when(k % 9 == 0, F.concat(F.lit("tests/"), F.translate("host", ".-", "__"), F.lit("_test.rs"))).otherwise(F.concat(F.lit("src/file"), k % 30, F.lit(".rs")))
    word = F.regexp_extract("url", r"^https?://(?:[^./]+\.)?([^./]+)\.", 1)
    return D.coverage_gaps(urls(spark, sf).select(k.alias("id"), F.col("host").alias("module"), word.alias("module_name"), path.alias("path"), F.when(k % 3 == 0, "YAML").otherwise("Rust").alias("language"), ((k % 40 == 1) & (k % 9 != 0)).alias("inline")))


@query("jn21_cross_directory_tests", """WITH t AS (SELECT page_id AS id, regexp_extract(url,'^https?://([^/?#]+)',1) AS module, replace(replace(regexp_extract(url,'^https?://([^/?#]+)',1),'.','_'),'-','_')||'_test' AS stem FROM pages),
 m AS (SELECT DISTINCT regexp_extract(url,'^https?://([^/?#]+)',1) AS module, regexp_extract(url,'^https?://(?:[^./]+\\.)?([^./]+)\\.',1) AS word FROM pages)
 SELECT DISTINCT m.module AS module, t.id AS test FROM t JOIN m ON contains('_'||t.stem||'_','_'||m.word||'_') AND length(m.word)>=4 WHERE t.module<>m.module""".replace("\\\\", "\\"))
def _(spark, sf):
    u = urls(spark, sf)
    tests = u.select(F.col("page_id").alias("id"), F.col("host").alias("module"), F.concat(F.translate("host", ".-", "__"), F.lit("_test")).alias("stem"))
    mods = u.select(F.col("host").alias("module"), F.regexp_extract("url", r"^https?://(?:[^./]+\.)?([^./]+)\.", 1).alias("word")).distinct()
    return D.cross_directory_tests(tests, mods)


@query("in5_god_modules", with_cte(["urls"], "SELECT id, files, round(ratio,6) AS ratio, CASE WHEN ratio>=3 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT host AS id, count(*) AS files, count(*)/(SELECT avg(n) FROM (SELECT count(*) AS n FROM urls GROUP BY host)) AS ratio FROM urls GROUP BY host) WHERE files>=10 AND ratio>=2"))
def _(spark, sf):
    mods = urls(spark, sf).groupBy(F.col("host").alias("id")).agg(F.count(F.lit(1)).alias("files"))
    return D.god_modules(mods).withColumn("ratio", F.round("ratio", 6))


CYCLES = """, walk AS (SELECT source_id AS start, target_id AS cur, [source_id, target_id] AS path FROM {t} WHERE target_id>source_id
 UNION ALL SELECT start, e.target_id, list_append(path, e.target_id) FROM walk JOIN {t} e ON e.source_id=cur WHERE e.target_id>start AND NOT list_contains(path, e.target_id))
 SELECT DISTINCT array_to_string(list_sort(path),',') AS nodes, CAST(len(path) AS BIGINT) AS length FROM walk JOIN {t} e ON e.source_id=cur AND e.target_id=start"""


@query("in6_cycles_top1", with_cte(["top1"], "").rstrip() + CYCLES.format(t="top1"))
def _(spark, sf):
    return D.cycles(top_edges(spark, sf, 1))


@query("in6_cycles_top2")
def _(spark, sf):
    return D.cycles(top_edges(spark, sf, 2))


INSIGHT_ROWS = f"SELECT id, severity, id%7 AS detected_at, id%5<>0 AS still_valid, CASE WHEN id%2=0 THEN 'complexity' ELSE 'size' END AS category FROM (SELECT *, {LADDER} AS severity FROM (SELECT event_id AS id, value/(SELECT avg(value) FROM events) AS ratio FROM events)) WHERE severity IS NOT NULL"


def _insights(spark, sf) -> DataFrame:
    rows = D.hotspots(read(spark, sf, "events").select(F.col("event_id").alias("id"), "value"))
    return rows.select("id", "severity", (F.col("id") % 7).alias("detected_at"), (F.col("id") % 5 != 0).alias("still_valid"), F.when(F.col("id") % 2 == 0, "complexity").otherwise("size").alias("category"))


@query("in7_severity_order", f"SELECT id, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank FROM ({INSIGHT_ROWS})")
def _(spark, sf):
    return _insights(spark, sf).select("id", "severity", D.severity_order(F.col("severity")).alias("severity_rank")).orderBy("severity_rank", "id")


@query("in8_list_insights", f"SELECT id, detected_at FROM ({INSIGHT_ROWS}) WHERE still_valid AND category='size' AND severity='high' ORDER BY detected_at DESC, id LIMIT 50")
def _(spark, sf):
    return D.list_insights(_insights(spark, sf), "size", "high").select("id", "detected_at")


CV1 = "SELECT CASE WHEN s>=0.7 THEN 'snake_case' WHEN c>=0.7 THEN 'camelCase' ELSE 'none' END AS title, round(CASE WHEN s>=0.7 THEN s WHEN c>=0.7 THEN c ELSE 0 END,6) AS confidence, n FROM (SELECT count(*) AS n, count_if(regexp_full_match(name,'[a-z0-9_]*') AND contains(name,'_'))/count(*) AS s, count_if(regexp_full_match(name,'[a-z][A-Za-z0-9]*') AND regexp_matches(name,'[A-Z]'))/count(*) AS c FROM (SELECT {e} AS name FROM part))"


@query("cv1_naming_snake", CV1.format(e="replace(p_name,' ','_')"))
def _(spark, sf):
    return D.naming_convention(read(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")))


@query("cv1_naming_none", CV1.format(e="p_name"))
def _(spark, sf):
    return D.naming_convention(read(spark, sf, "part").select(F.col("p_name").alias("name")))


CV2_PATH = "CASE page_id%7 WHEN 0 THEN 'tests/a.rs' WHEN 1 THEN 'src/test/b.rs' WHEN 2 THEN 'src/c_test.rs' WHEN 3 THEN 'src/d_tests.rs' WHEN 4 THEN 'src/test_e.rs' ELSE 'src/x.rs' END"


@query("cv2_test_layout", f"""SELECT layout, n, total, round(n/total,6) AS confidence FROM (SELECT layout, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total, row_number() OVER (ORDER BY count(*) DESC, layout) AS rn FROM (SELECT CASE
 WHEN regexp_matches(p,'(^|/)tests/') THEN 'tests/ directory' WHEN regexp_matches(p,'(^|/)test/') THEN 'test/ directory' WHEN ends_with(p,'_test.rs') THEN '_test.rs suffix' WHEN ends_with(p,'_tests.rs') THEN '_tests.rs suffix' WHEN regexp_matches(p,'(^|/)test_.*\\.rs$') THEN 'test_ prefix' END AS layout
 FROM (SELECT {CV2_PATH} AS p FROM pages)) WHERE layout IS NOT NULL GROUP BY layout) WHERE rn=1 AND total>=2""")
def _(spark, sf):
    return D.test_layout(read(spark, sf, "pages").select(F.expr("CASE page_id % 7 WHEN 0 THEN 'tests/a.rs' WHEN 1 THEN 'src/test/b.rs' WHEN 2 THEN 'src/c_test.rs' WHEN 3 THEN 'src/d_tests.rs' WHEN 4 THEN 'src/test_e.rs' ELSE 'src/x.rs' END").alias("path")))


@query("cv3_directory_depth", with_cte(["ents"], "SELECT CASE WHEN m<=2 THEN 'flat structure' ELSE 'nested/feature-based structure' END AS title, round(m,6) AS mean, deepest, CASE WHEN m<=1.5 THEN 0.95 WHEN m<=2 THEN 0.8 WHEN m>=4 THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM (SELECT avg(length(path)-length(replace(path,'/',''))) AS m, max(length(path)-length(replace(path,'/',''))) AS deepest FROM ents WHERE tier='file') WHERE m<=2 OR m>=3"))
def _(spark, sf):
    return D.directory_depth(A.files(spark, sf))


@query("cv4_list_conventions", "SELECT p_partkey AS id, p_retailprice AS confidence FROM part WHERE p_type='ECONOMY' ORDER BY 2 DESC, 1")
def _(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("confidence"), F.col("p_type").alias("category"))
    return D.list_conventions(rows, "ECONOMY").select("id", "confidence")
