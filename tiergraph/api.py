"""The library: open a graph, keep it fresh, ask it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.errors import InvalidInput, NotFound
from tiergraph.functions import text as X
from tiergraph.operators import detect as D
from tiergraph.operators import graph as G
from tiergraph.operators import metrics as M
from tiergraph.operators import ranking as R
from tiergraph.operators import search as S
from tiergraph.plans import refresh as RF
from tiergraph.plans.store import Store
from tiergraph.sources import directory as Y
from tiergraph.sources import documents as DOC

MODEL = "token-hash-64"


class Graph:
    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)

    # ---- keeping

    def create_project(self, name: str, description: str | None = None, if_absent: bool = False) -> str:
        return self.store.create_project(name, description, if_absent=if_absent)

    def list_projects(self) -> DataFrame:
        return self.store.projects()

    def project(self, name: str | None = None) -> str:
        return self.store.resolve_project(name)

    def add_repo(self, path: str, project: str | None = None, name: str | None = None, git_url: str | None = None) -> str:
        return self.store.add_repo(self.project(project), path, name, git_url)

    def list_repos(self, project: str | None = None) -> DataFrame:
        return self.store.repos(project)

    def link_repo(self, repo_id: str, project: str) -> None:
        self.store.link_repo(repo_id, project)

    def is_stale(self, project: str | None = None) -> bool:
        return RF.is_stale(self.store, self.project(project))

    def ensure_fresh(self, project: str | None = None, full: bool = False) -> RF.RefreshStats:
        return RF.refresh(self.store, self.project(project), full)

    def build_vectors(self) -> None:
        """SE1, SNK15. Vectors of names and code."""
        u = self.store.read("code_units").where("unit_type <> 'file_imports_marker'")
        rows = u.select(F.xxhash64("repo_id", "file", "qualified_name", "line").alias("vec_id"), F.col("file").alias("path"), "name", X.truncate(F.coalesce("code", F.lit("")), 200).alias("snippet"), F.concat_ws("\n", "name", "code").alias("text"))
        self.store.save_vectors(S.with_norm(S.embed(rows, "text").drop("text")), MODEL)

    # ---- asking

    def entities(self, project: str | None = None, tier: str | None = None) -> DataFrame:
        rows = self.store.read("entities").where(F.col("project_id") == self.project(project))
        return rows if tier is None else rows.where(F.col("tier") == tier)

    def relationships(self, project: str | None = None) -> DataFrame:
        return G.project_edges(self.store.read("relationships"), self.entities(project), self.project(project))

    def subsystems(self, project: str | None = None) -> DataFrame:
        return self.entities(project, "subsystem").orderBy("name", "id")

    def modules_in(self, subsystem_id: str) -> DataFrame:
        return self.store.read("entities").where(F.col("parent_id") == subsystem_id).orderBy("name", "id")

    files_in = modules_in

    def entity(self, entity_id: str):
        row = self.store.read("entities").where(F.col("id") == entity_id).first()
        if row is None:
            raise NotFound(f"no entity {entity_id!r}")
        return row

    def entity_by_path(self, repo_id: str, path: str):
        row = self.store.read("entities").where((F.col("repo_id") == repo_id) & (F.col("path") == path) & (F.col("tier") != "function")).orderBy("id").first()
        if row is None:
            raise NotFound(f"nothing at {path!r}")
        return row

    def hotspots(self, project: str | None = None, limit: int = 10, tier: str | None = None) -> DataFrame:
        m = self.store.read("metrics").select("id", F.col("complexity_max").alias("complexity"))
        f = self.store.read("functions_complexity")
        rows = self.entities(project).select("id", "tier", "name", "path").join(m.unionByName(f), "id")
        return M.hotspots(rows, X.clamp_limit(limit, 10, 50), "name" if tier else "id", tier)

    def insights(self, project: str | None = None, category: str | None = None, severity: str | None = None, limit: int = 50) -> DataFrame:
        return D.list_insights(self.store.read("insights").where(F.col("project_id") == self.project(project)), category, severity, limit)

    def conventions(self, project: str | None = None, category: str | None = None) -> DataFrame:
        return D.list_conventions(self.store.read("conventions").where(F.col("project_id") == self.project(project)), category)

    def _one(self, entity_id: str) -> DataFrame:
        self.entity(entity_id)
        return self.store.spark.createDataFrame([(entity_id,)], "id string")

    def dependencies_of(self, entity_id: str) -> DataFrame:
        return G.outgoing(self.store.read("relationships"), self.store.read("entities"), self._one(entity_id)).orderBy("target_id", "rel_type")

    def dependents_of(self, entity_id: str) -> DataFrame:
        return G.incoming(self.store.read("relationships"), self.store.read("entities"), self._one(entity_id)).orderBy("source_id", "rel_type")

    def impact(self, paths: list[str], project: str | None = None) -> DataFrame:
        wanted = self.store.spark.createDataFrame([(p,) for p in paths], "path string")
        return G.impact(self.entities(project), self.relationships(project), wanted).orderBy("kind", "id")

    def blast_radius(self, file_id: str, project: str | None = None) -> DataFrame:
        return G.blast_radius(self.entities(project), self.relationships(project), file_id)

    def flows(self, project: str | None = None, contains: str | None = None, limit: int = 20) -> DataFrame:
        heads = self.store.read("flows").where("step = 0").select("entry_id", "has_cycle")
        return G.list_flows(heads, self.entities(project).select("id", "name"), contains, limit)

    def search(self, query: str, project: str | None = None, tier: str | None = None, limit: int | None = None) -> DataFrame:
        words = X.search_words(query)
        if not words:
            raise InvalidInput("a query needs a word of two characters or more")
        return R.keyword(self.entities(project), words, X.clamp_limit(limit), tier)

    def semantic_search(self, query: str, limit: int | None = None) -> DataFrame:
        v = self.store.load_vectors(MODEL)
        q = S.embed(self.store.spark.createDataFrame([(query,)], "text string"), "text").select(F.col("embedding").alias("query_embedding"))
        return S.nearest(v, q, X.clamp_limit(limit)).select("path", "name", "snippet", "score")

    def explore(self, query: str, project: str | None = None, max_files: int = 8) -> DataFrame:
        """RK1 to RK3. Files by how well their name, path and symbols answer a query."""
        words = X.query_words(query)
        if not words:
            raise InvalidInput("nothing to look for")
        e = self.entities(project)
        symbol = R.symbol_scores(R.symbols(e, words), words)
        scored = R.score_files(e.where("tier = 'file'").select("id", "name", "path"), words)
        return R.rank(R.matched(scored, symbol), symbol, min(max(max_files, 1), 30))

    def list_directory(self, repo_id: str, path: str = "") -> list[dict]:
        """DC2. A folder of a repository's checkout with the entities of what it holds."""
        repo = self.store.repo(repo_id)
        known = self.store.read("entities").where((F.col("repo_id") == repo_id) & (F.col("tier") != "function"))
        folder = "/".join(x for x in path.split("/") if x not in ("", "."))
        below = F.substring("path", len(folder) + 2, 1 << 20) if folder else F.regexp_replace("path", r"^\./", "")
        here = known.where(X.under(F.col("path"), folder)).where(~below.contains("/")).select("path", "id")
        return Y.list_directory(self.store.spark, repo.local_path, path, {r.path: r.id for r in here.collect()})  # one folder's entries

    def read_file(self, entity_id: str) -> dict:
        """DC2. entity_id, name, path and content of a file entity."""
        e = self.store.read("entities").where(F.col("id") == entity_id).first()
        if e is None:
            raise NotFound(f"entity not found: {entity_id}")
        if e.tier != "file":
            raise InvalidInput(f"entity {entity_id} is not a file (tier: {e.tier})")
        if e.path is None:
            raise InvalidInput(f"entity {entity_id} has no path")
        return {"entity_id": e.id, "name": e.name, "path": e.path, "content": Y.read_file(self.store.spark, self.store.repo(e.repo_id).local_path, e.path)}

    def bundle(self, scope: str, project: str | None = None) -> DataFrame:
        return G.bundle_edges(self.entities(project), self.relationships(project), X.safe_scope(scope)).orderBy("source_file", "target_file")

    def docs(self, root: str) -> DataFrame:
        return DOC.select_within_budget(DOC.discover(self.store.spark, root)).drop("content")

    def doctor(self) -> dict[str, str]:
        """DR1. What is there and what is missing."""
        s = self.store
        out = {t: s.version(t) or "absent" for t in ("projects", "repositories", "entities", "relationships", "metrics", "flows", "insights", "conventions", "code_units", "file_hashes")}
        return out | {"vectors": s._read("vectors/model") or "absent", "spark": s.spark.version}


def open_graph(spark: SparkSession, root: str) -> Graph:
    return Graph(spark, root)
