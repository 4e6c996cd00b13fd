"""Detection rules: hotspots, coupling, coverage gaps, god modules, cycles, conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tiergraph.functions import text as X

LEAST_COUPLING = 3
FEW_MODULES, FEW_THRESHOLD = 10, 5
TEST_RATIO = 0.10


def ladder(value: Column, steps: list[tuple[float, str, bool]]) -> Column:
    """The first label whose bound value exceeds (or, if the flag is set, reaches); else null."""
    out = F.lit(None).cast("string")
    for bound, label, inclusive in reversed(steps):
        out = F.when((value >= bound) if inclusive else (value > bound), label).otherwise(out)
    return out


def hotspots(rows: DataFrame) -> DataFrame:
    """IN1, IN2. rows (id, value) by their ratio to the mean, zeros included in the mean: severity and ratio of those of 1.5 and more."""
    mean = rows.agg(F.avg("value").alias("mean"))
    severity = ladder(F.col("ratio"), [(4, "critical", False), (3, "high", False), (2, "medium", False), (1.5, "low", True)])
    return rows.crossJoin(F.broadcast(mean)).where("value > 0 and mean > 0").withColumn("ratio", F.col("value") / F.col("mean")).withColumn("severity", severity).where("severity is not null").drop("mean")  # mean is one row


def coupling_insights(modules: DataFrame) -> DataFrame:
    """IN3. modules (id, fan_in, fan_out): thresholds at 95, 90 and 80 hundredths of either sorted axis, the lower axis counts.

    The sorted axes are needed at three positions and as ranks only. Values are counted first, so
    what is sorted is the distinct values of an axis.
    """
    total = modules.agg(F.count(F.lit(1)).alias("total"))

    def axis(c: str) -> DataFrame:
        per = modules.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return per.select("v", (F.sum("n").over(W.orderBy("v")) - F.col("n")).alias("below"), F.sum("n").over(W.orderBy("v")).alias("upto"))

    def at(values: DataFrame, name: str) -> DataFrame:
        cuts = [
            F.greatest(F.min(F.when(F.col("upto") > F.least(F.expr(f"total * {p} div 100"), F.col("total") - 1), F.col("v"))), F.lit(LEAST_COUPLING)).alias(f"{name}{p}") for p in (95, 90, 80)
        ]
        return values.crossJoin(total).agg(*cuts)  # total is one row

    ins, outs = axis("fan_in"), axis("fan_out")
    cut = at(ins, "i").crossJoin(at(outs, "o")).crossJoin(total)  # one row each
    few = F.col("total") < FEW_MODULES
    cut = cut.select("total", *[F.when(few, FEW_THRESHOLD).otherwise(F.least(f"i{p}", f"o{p}")).alias(k) for k, p in (("high", 95), ("medium", 90), ("low", 80))])
    rows = modules.crossJoin(F.broadcast(cut)).withColumn("top", F.greatest("fan_in", "fan_out")).where("top >= low")
    rows = rows.join(ins.select(F.col("v").alias("fan_in"), F.col("below").alias("in_below")), "fan_in").join(outs.select(F.col("v").alias("fan_out"), F.col("below").alias("out_below")), "fan_out")
    by_in = F.col("fan_in") >= F.col("fan_out")
    rank = F.col("total") - F.when(by_in, F.col("in_below")).otherwise(F.col("out_below"))
    severity = F.when(F.col("top") >= F.col("high"), "high").when(F.col("top") >= F.col("medium"), "medium").otherwise("low")
    return rows.select(
        "id", "fan_in", "fan_out", severity.alias("severity"), F.when(by_in, "fan-in").otherwise("fan-out").alias("axis"), rank.alias("rank"), F.round(rank / F.col("total") * 100).cast("bigint").alias("pct"), "total"
    )


# Languages whose files are expected to have tests.
TESTABLE_LANGUAGES = ["rust", "python", "javascript", "typescript", "jsx", "tsx", "go", "java", "kotlin", "ruby", "c", "cpp", "c++", "swift", "scala", "php"]
#: A word shorter than this attributes no test.
WORD_BYTES = 4


def coverage_gaps(files: DataFrame) -> DataFrame:
    """IN4. files (id, module, module_name, path, language, inline): modules with a file of a testable language and no test are high, below a tenth medium.

    Tests of a module are its own test files (by name or folder, or with inline tests), and test files of
    other modules whose stem holds, as a whole word, the module's name or the stem of a file of it that
    is no test.
    """
    rows = files.select("id", "module", "module_name", "path", "language", F.coalesce("inline", F.lit(False)).alias("inline"), X.is_test_file(F.col("path")).alias("is_test"), X.stem(F.col("path")).alias("stem"))
    per = rows.groupBy("module").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.lower("language").isin(TESTABLE_LANGUAGES)).alias("testable"), F.count_if(F.col("is_test") | F.col("inline")).alias("direct")
    )
    child = rows.where(~F.col("is_test") & ~F.col("inline")).select("module", F.col("stem").alias("word"))
    words = child.unionByName(rows.select("module", F.col("module_name").alias("word"))).where(F.octet_length("word") >= WORD_BYTES).distinct()
    across = cross_directory_tests(rows.where("is_test and stem is not null").select("id", "module", "stem"), words)
    cross = across.groupBy("module").agg(F.count(F.lit(1)).alias("across"))
    out = per.where("testable > 0").join(cross, "module", "left").withColumn("across", F.coalesce("across", F.lit(0).cast("bigint"))).withColumn("tests", F.col("direct") + F.col("across"))
    severity = F.when(F.col("tests") == 0, "high").when(F.col("tests") / F.col("files") < TEST_RATIO, "medium")
    return out.withColumn("severity", severity).where("severity is not null").select("module", "files", "tests", "direct", "across", "severity")


def cross_directory_tests(tests: DataFrame, modules: DataFrame) -> DataFrame:
    """JN21. module, test: test stems (id, module, stem) that hold a module's name or a child's stem (module, word) as a whole word.

    Stems are cut at _ and -, and all runs of their parts are joined with words, so no pair of
    unrelated rows is compared. A run keeps its own separators.
    """
    cut = tests.withColumn("cuts", F.concat(F.array(F.lit(0)), F.filter(F.transform(F.split("stem", ""), lambda c, i: F.when(c.isin("_", "-"), i + 1)), lambda x: x.isNotNull())))
    runs = F.flatten(
        F.transform("cuts", lambda a: F.transform(F.filter(F.concat(F.col("cuts"), F.array(F.char_length("stem") + 1)), lambda b: b > a), lambda b: F.substring(F.col("stem"), a + 1, b - a - 1)))
    )
    words = cut.select(F.col("id").alias("test"), F.col("module").alias("own"), F.explode(F.array_distinct(runs)).alias("word"))
    wanted = modules.where(F.octet_length("word") >= WORD_BYTES).select("module", "word").distinct()
    return words.join(wanted, "word").where(~F.col("own").eqNullSafe(F.col("module"))).select("module", "test").distinct()


def god_modules(modules: DataFrame) -> DataFrame:
    """IN5. modules (id, files): ten files or more and twice the mean is medium, three times high."""
    mean = modules.agg(F.avg("files").alias("mean"))
    rows = modules.crossJoin(F.broadcast(mean)).withColumn("ratio", F.col("files") / F.col("mean"))  # one row
    severity = ladder(F.col("ratio"), [(3, "high", True), (2, "medium", True)])
    return rows.where("files >= 10").withColumn("severity", severity).where("severity is not null").drop("mean")


def rust_share(files: DataFrame) -> Column:
    known = F.count("language")
    return F.when(known > 0, F.count_if(F.lower("language") == "rust") / known).otherwise(0.0)


def back_edge_cycles(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Node sets of the cycles that a depth-first walk closes: from nodes in order, over neighbours in order, each set once."""
    out_of: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        out_of.setdefault(a, []).append(b)
    place: dict[str, int] = {}  # of nodes on the path; -1 once left for good
    seen: set[tuple[str, ...]] = set()
    for start in sorted(out_of):
        if start in place:
            continue
        path, ways = [start], [iter(out_of[start])]
        place[start] = 0
        while path:
            for b in ways[-1]:
                if b not in place:
                    place[b] = len(path)
                    path.append(b)
                    ways.append(iter(out_of.get(b, ())))
                    break
                if place[b] >= 0:
                    seen.add(tuple(sorted(path[place[b] :])))
            else:
                ways.pop()
                place[path.pop()] = -1
    return [list(c) for c in sorted(seen)]


def cycles(edges: DataFrame) -> DataFrame:
    """IN6. nodes, length: node sets of the cycles that a depth-first walk of the graph closes, of any length.

    The walk is in order of ids and takes time linear in the edges, unlike a listing of all simple cycles.
    It passes the distinct edges between one project's modules, the roll-up of its files, through one task.
    """
    e = edges.where("source_id <> target_id").select("source_id", "target_id").distinct()

    def run(pdf):
        import pandas as pd

        found = back_edge_cycles(list(zip(pdf["source_id"], pdf["target_id"])))
        return pd.DataFrame([(",".join(c), len(c)) for c in found], columns=["nodes", "length"])

    return e.groupBy(F.lit(0).alias("project")).applyInPandas(run, "nodes string, length bigint")


def severity_order(severity: Column) -> Column:
    """IN7."""
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).when(severity == "low", 3).otherwise(4)


def list_insights(insights: DataFrame, category: str | None = None, severity: str | None = None, limit: int = 50) -> DataFrame:
    """IN8. Valid insights, newest first, by id among equals."""
    rows = insights.where("still_valid")
    rows = rows if category is None else rows.where(F.col("category") == category)
    rows = rows if severity is None else rows.where(F.col("severity") == severity)
    return rows.orderBy(F.desc("detected_at"), "id").limit(limit)


def naming_convention(names: DataFrame) -> DataFrame:
    """CV1. snake or camel if seven tenths of the names (column name) are; confidence is the share; else none."""
    n = F.count(F.lit(1))
    shares = names.agg(n.alias("n"), (F.count_if(X.is_snake(F.col("name"))) / n).alias("snake"), (F.count_if(X.is_camel(F.col("name"))) / n).alias("camel"))
    title = F.when(F.col("snake") >= 0.7, "snake_case").when(F.col("camel") >= 0.7, "camelCase").otherwise("none")
    return shares.where("n > 0").select(title.alias("title"), F.round(F.when(title == "snake_case", F.col("snake")).when(title == "camelCase", F.col("camel")).otherwise(0.0), 6).alias("confidence"), "n")


# Test layouts by priority.
TEST_LAYOUTS = ["tests/ directory", "test/ directory", "_test.rs suffix", "_tests.rs suffix", "test_ prefix"]


def test_layout(paths: DataFrame) -> DataFrame:
    """CV2. The dominant test layout of two test files or more, the first by name among equals."""
    p = F.col("path")
    kind = (
        F.when(p.rlike("(^|/)tests/"), TEST_LAYOUTS[0]).when(p.rlike("(^|/)test/"), TEST_LAYOUTS[1]).when(p.endswith("_test.rs"), TEST_LAYOUTS[2])
        .when(p.endswith("_tests.rs"), TEST_LAYOUTS[3]).when(p.rlike(r"(^|/)test_.*\.rs$"), TEST_LAYOUTS[4])
    )
    per = paths.select(kind.alias("layout")).where("layout is not null").groupBy("layout").agg(F.count(F.lit(1)).alias("n"))
    best = per.agg(F.min_by("layout", F.struct(-F.col("n"), F.col("layout"))).alias("layout"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.where("total >= 2").select("layout", "n", "total", F.round(F.col("n") / F.col("total"), 6).alias("confidence"))


def directory_depth(paths: DataFrame) -> DataFrame:
    """CV3. flat up to a mean depth of 2, nested from 3, none between."""
    depth = F.char_length("path") - F.char_length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    per = paths.agg(F.avg(depth).alias("mean"), F.max(depth).cast("bigint").alias("deepest"))
    m = F.col("mean")
    confidence = F.when(m <= 1.5, 0.95).when(m <= 2, 0.8).when(m >= 4, 0.9).otherwise(0.75)
    title = F.when(m <= 2, "flat structure").when(m >= 3, "nested/feature-based structure")
    return per.select(title.alias("title"), F.round(m, 6).alias("mean"), "deepest", confidence.cast("double").alias("confidence")).where("title is not null")


def list_conventions(rows: DataFrame, category: str | None = None) -> DataFrame:
    """CV4. By confidence, then id."""
    rows = rows if category is None else rows.where(F.col("category") == category)
    return rows.orderBy(F.desc("confidence"), "id")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
