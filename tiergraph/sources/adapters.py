"""The star-schema tables as graph tables: regions hold nations hold customers hold orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "p"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(tier: str, key: str):
    return F.concat_ws(":", F.lit(tier), F.col(key))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project_id, parent_id, tier, name, path, summary of the four tiers."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")

    def row(df: DataFrame, id_, parent, tier: str, name, path, summary) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(PROJECT).alias("project_id"), parent.alias("parent_id"), F.lit(tier).alias("tier"), name.alias("name"), path.alias("path"), summary.alias("summary"))

    subs = row(region, _id("subsystem", "r_regionkey"), none, "subsystem", F.col("r_name"), F.col("r_name"), none)
    # region and nation are fixed at 5 and 25 rows at every scale
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("np", F.concat_ws("/", "r_name", "n_name"))
    mods = row(places, _id("module", "n_nationkey"), _id("subsystem", "n_regionkey"), "module", F.col("n_name"), F.col("np"), none)
    cust = customer.join(F.broadcast(places.select("n_nationkey", "np")), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("cp", F.concat_ws("/", "np", "c_custkey"))
    files = row(cust, _id("file", "c_custkey"), _id("module", "c_nationkey"), "file", F.col("c_name"), F.col("cp"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    made = orders.join(cust.select("c_custkey", "cp"), F.col("o_custkey") == F.col("c_custkey"))
    funs = row(
        made, _id("function", "o_orderkey"), _id("file", "o_custkey"), "function", F.concat(F.lit("order_"), F.col("o_orderkey")), F.concat_ws("/", "cp", "o_orderkey"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")),
    )
    return subs.unionByName(mods).unionByName(files).unionByName(funs)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the file tier: id, parent_id, path."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("np"))
    joined = c.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(_id("file", "c_custkey").alias("id"), _id("module", "c_nationkey").alias("parent_id"), F.concat_ws("/", "np", "c_custkey").alias("path"))


def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit an order: name, file (id), line, end_line, complexity and flags."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    per = items.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("o")
    )
    n = F.coalesce("n", F.lit(0))
    return orders.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("order_"), F.col("o_orderkey")).alias("name"),
        _id("function", "o_orderkey").alias("id"),
        _id("file", "o_custkey").alias("file"),
        F.lit(1).cast("bigint").alias("line"),
        n.cast("bigint").alias("end_line"),
        (n + 1).cast("bigint").alias("complexity"),
        (F.coalesce("r", F.lit(0)) == 1).alias("has_branches"),
        (F.coalesce("o", F.lit(0)) == 1).alias("has_loops"),
        (F.col("o_orderstatus") == "F").alias("has_error_handling"),
    )


def edge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit a lineitem, customer to supplier: source_id, target_id, rel_type, provenance, source_line."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _id("file", "o_custkey").alias("source_id"),
        _id("supplier", "l_suppkey").alias("target_id"),
        F.lit("imports").alias("rel_type"),
        F.when(F.col("l_returnflag") == "N", "resolved").otherwise("heuristic").alias("provenance"),
        F.col("l_linenumber").cast("bigint").alias("source_line"),
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: customers and suppliers to their nation's module."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    return c.select(_id("file", "c_custkey").alias("child"), _id("module", "c_nationkey").alias("parent")).unionByName(
        s.select(_id("supplier", "s_suppkey").alias("child"), _id("module", "s_nationkey").alias("parent"))
    )


def module_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: modules to their subsystem."""
    return read(spark, sf_dir, "nation").select(_id("module", "n_nationkey").alias("child"), _id("subsystem", "n_regionkey").alias("parent"))


#: The same tables as DuckDB common table expressions, by name.
CTE: dict[str, str] = {
    "ents": """ents AS (
 SELECT 'subsystem:'||r_regionkey AS id, 'p' AS project_id, CAST(NULL AS VARCHAR) AS parent_id, 'subsystem' AS tier, r_name AS name, r_name AS path, CAST(NULL AS VARCHAR) AS summary FROM region
 UNION ALL SELECT 'module:'||n_nationkey, 'p', 'subsystem:'||n_regionkey, 'module', n_name, r_name||'/'||n_name, NULL FROM nation JOIN region ON n_regionkey=r_regionkey
 UNION ALL SELECT 'file:'||c_custkey, 'p', 'module:'||c_nationkey, 'file', c_name, r_name||'/'||n_name||'/'||c_custkey, CASE WHEN c_acctbal>=0 THEN c_mktsegment END
  FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
 UNION ALL SELECT 'function:'||o_orderkey, 'p', 'file:'||o_custkey, 'function', 'order_'||o_orderkey, r_name||'/'||n_name||'/'||c_custkey||'/'||o_orderkey, CASE WHEN o_orderstatus<>'O' THEN o_orderpriority END
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)""",
    "units": """units AS (
 SELECT 'order_'||o_orderkey AS name, 'function:'||o_orderkey AS id, 'file:'||o_custkey AS file, CAST(1 AS BIGINT) AS line, CAST(COALESCE(n,0) AS BIGINT) AS end_line, CAST(COALESCE(n,0)+1 AS BIGINT) AS complexity,
  COALESCE(r,false) AS has_branches, COALESCE(o,false) AS has_loops, o_orderstatus='F' AS has_error_handling
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag='R') AS r, bool_or(l_linestatus='O') AS o FROM lineitem GROUP BY 1) ON o_orderkey=l_orderkey)""",
    "hits": """hits AS (
 SELECT 'file:'||o_custkey AS source_id, 'supplier:'||l_suppkey AS target_id, 'imports' AS rel_type, CASE WHEN l_returnflag='N' THEN 'resolved' ELSE 'heuristic' END AS provenance, CAST(l_linenumber AS BIGINT) AS source_line
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey)""",
    "edges": """edges AS (
 SELECT source_id, target_id, rel_type, CAST(count(*) AS DOUBLE) AS weight, CASE WHEN bool_or(provenance='resolved') THEN 'resolved' ELSE 'heuristic' END AS provenance
 FROM hits WHERE source_id<>target_id GROUP BY 1,2,3)""",
    "owners": """owners AS (
 SELECT 'file:'||c_custkey AS child, 'module:'||c_nationkey AS parent FROM customer UNION ALL SELECT 'supplier:'||s_suppkey, 'module:'||s_nationkey FROM supplier)""",
    "modedges": """modedges AS (
 SELECT a.parent AS source_id, b.parent AS target_id, sum(weight) AS weight FROM edges JOIN owners a ON source_id=a.child JOIN owners b ON target_id=b.child WHERE a.parent<>b.parent GROUP BY 1,2)""",
    "subedges": """subedges AS (
 SELECT 'subsystem:'||a.n_regionkey AS source_id, 'subsystem:'||b.n_regionkey AS target_id, sum(weight) AS weight FROM modedges JOIN nation a ON source_id='module:'||a.n_nationkey JOIN nation b ON target_id='module:'||b.n_nationkey
 WHERE a.n_regionkey<>b.n_regionkey GROUP BY 1,2)""",
    "coupled": "coupled AS (SELECT * FROM modedges WHERE weight > 1.3*(SELECT avg(weight) FROM modedges))",
    "top2": """top2 AS (SELECT source_id, target_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS rn FROM modedges) WHERE rn<=2)""",
    "top1": """top1 AS (SELECT source_id, target_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS rn FROM modedges) WHERE rn<=1)""",
    "filemetrics": """filemetrics AS (
 SELECT file, CAST(sum(greatest(end_line-line+1,0)) AS BIGINT) AS lines, count(*) AS code_units, CAST(sum(complexity) AS BIGINT) AS complexity_sum, max(complexity) AS complexity_max, sum(complexity)/count(*) AS complexity_avg,
  count_if(has_branches) AS has_branches_count, count_if(has_loops) AS has_loops_count, count_if(has_error_handling) AS has_error_handling_count FROM units GROUP BY file)""",
    "urls": r"""urls AS (SELECT page_id, url, regexp_extract(url,'^https?://([^/?#]+)',1) AS host, regexp_extract(url,'^https?://([^?#]+)',1) AS path FROM pages)""",
}

NEEDS = {
    "edges": ["hits"], "modedges": ["edges", "owners"], "subedges": ["modedges"], "coupled": ["modedges"], "top2": ["modedges"], "top1": ["modedges"], "filemetrics": ["units"],
}


def with_cte(names: list[str], body: str) -> str:
    """body after the named expressions and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(CTE[n] for n in order) + "\n" + body
