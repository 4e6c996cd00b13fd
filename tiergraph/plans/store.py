"""Tables on shared storage: versioned Parquet with an atomic pointer, projects, repositories, runs, vectors.

A write goes to a fresh version folder; then a pointer file of a few bytes, written with Hadoop's
own file system so that any store works, is replaced. Readers resolve the pointer once a query, so a
query sees one version. Old versions stay until vacuum().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph import schema as S
from tiergraph.errors import Conflict, InvalidInput, NotFound, StaleIndex
from tiergraph.functions import text as X
from tiergraph.operators import sinks as K

SCHEMAS = {
    "projects": S.PROJECTS, "repositories": S.REPOSITORIES, "entities": S.ENTITIES, "relationships": S.RELATIONSHIPS, "insights": S.INSIGHTS, "conventions": S.CONVENTIONS,
    "analysis_runs": S.ANALYSIS_RUNS, "file_hashes": S.FILE_HASHES, "code_units": f"repo_id string, {S.CODE_UNITS}", "inline_tests": "repo_id string, file string", "flows": "repo_id string, entry_id string, step bigint, id string, depth bigint, has_cycle boolean",
    "metrics": f"id string, project_id string, tier string, {S.METRICS}", "functions_complexity": "id string, complexity bigint",
}
PARTITIONS = {"entities": ["project_id", "tier"], "relationships": ["rel_type"]}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- files

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _replace(self, name: str, text: str) -> None:
        new, old = self._path(f"{self.root}/{name}.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = jvm.org.apache.hadoop.fs.Options
        rename = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        rename[0] = options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(old), rename)

    # ---- tables

    def version(self, table: str) -> str | None:
        return self._read(f"{table}/current")

    def read(self, table: str) -> DataFrame:
        """SRC18. The table's current version; empty before its first."""
        v = self.version(table)
        if v is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        found = self.spark.read.parquet(f"{self.root}/{table}/{v}")
        ddl = self.spark.createDataFrame([], SCHEMAS[table]).columns if table in SCHEMAS else found.columns
        return found.select(*[c for c in ddl if c in found.columns], *[c for c in found.columns if c not in ddl])

    def stage(self, table: str, rows: DataFrame) -> str:
        v = uuid.uuid4().hex
        writer = rows.write
        if PARTITIONS.get(table):
            writer = writer.partitionBy(*PARTITIONS[table])
        writer.parquet(f"{self.root}/{table}/{v}")
        return v

    def publish(self, **tables: DataFrame) -> None:
        """SNK6. All tables are staged first; then their pointers are replaced one by one."""
        staged = {t: self.stage(t, rows) for t, rows in tables.items()}
        for t, v in staged.items():
            self._replace(f"{t}/current", v)

    def settle(self, rows: DataFrame) -> DataFrame:
        """rows, written to a scratch folder of the store and read back: a short plan that survives lost executors."""
        path = f"{self.root}/scratch/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear_scratch(self) -> None:
        self._fs.delete(self._path(f"{self.root}/scratch"), True)

    def vacuum(self, table: str) -> int:
        """Deletes all versions but the current one; returns how many."""
        current, n = self.version(table), 0
        folder = self._path(f"{self.root}/{table}")
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if f.isDirectory() and f.getPath().getName() != current:
                self._fs.delete(f.getPath(), True)
                n += 1
        return n

    def _rows(self, table: str, values: list[dict]) -> DataFrame:
        cols = self.spark.createDataFrame([], SCHEMAS[table]).schema
        return self.spark.createDataFrame([tuple(v.get(c) for c in cols.names) for v in values], cols)

    # ---- projects and repositories (RM1 to RM4, RG1, RG3)

    def create_project(self, name: str, description: str | None = None, output_dirs: list[str] | None = None, if_absent: bool = False) -> str:
        old = self.read("projects")
        row = old.where(F.col("name") == name).select("id").first()
        if row:
            if if_absent:
                return row[0]
            raise Conflict(f"project {name!r} exists")
        if not name or ":" in name:
            raise InvalidInput("a project's name may not be empty or contain ':'")
        new = self._rows("projects", [{"id": name, "name": name, "description": description, "output_dirs": output_dirs or []}]).withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
        self.publish(projects=old.unionByName(new))
        return name

    def projects(self) -> DataFrame:
        return self.read("projects").orderBy("name")

    def resolve_project(self, name: str | None = None) -> str:
        """RG3. The named project, or the only one."""
        rows = self.read("projects") if name is None else self.read("projects").where((F.col("name") == name) | (F.col("id") == name))
        ids = [r[0] for r in rows.select("id").limit(2).collect()]
        if len(ids) != 1:
            raise (NotFound(f"no project {name!r}") if name else InvalidInput("name a project: there is none or more than one") if not ids or len(ids) > 1 else NotFound("no project"))
        return ids[0]

    def add_repo(self, project: str, path: str, name: str | None = None, git_url: str | None = None) -> str:
        """RG1, RM5. Registers a checkout; one known by path is attached, one whose origin another path has is a conflict."""
        path = path.rstrip("/")
        old = self.read("repositories")
        known = old.where(F.col("local_path") == path).select("id", "project_id").first()
        if known:
            if known.project_id != project:
                raise Conflict(f"{path} belongs to project {known.project_id!r}")
            return known.id
        new = self._rows("repositories", [{"project_id": project, "local_path": path, "git_url": git_url}])
        if git_url:
            key = X.origin_key(F.lit(git_url))
            if old.where((F.col("project_id") == project) & (X.origin_key(F.col("git_url")) == key)).count():
                raise Conflict(f"the origin of {path} is registered from another path")
        base = name or path.split("/")[-1].replace(":", "-") or "repo"
        taken = {r[0] for r in old.where((F.col("project_id") == project) & F.col("name").startswith(base)).select("name").collect()}  # names of one stem
        pick = base if base not in taken else next(f"{base}-{k}" for k in range(2, len(taken) + 3) if f"{base}-{k}" not in taken)
        rid = f"{project}/{pick}"
        new = new.withColumns({"id": F.lit(rid), "name": F.lit(pick), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
        self.publish(repositories=old.unionByName(new))
        return rid

    def repos(self, project: str | None = None) -> DataFrame:
        rows = self.read("repositories")
        return (rows if project is None else rows.where(F.col("project_id") == project)).orderBy("name")

    def repo(self, repo_id: str):
        row = self.read("repositories").where(F.col("id") == repo_id).first()
        if row is None:
            raise NotFound(f"no repository {repo_id!r}")
        return row

    def update_repo(self, repo_id: str, **values) -> None:
        """RM2, RM3. Commit, index path, origin, place and unresolved counts."""
        mine = F.col("id") == repo_id
        rows = self.read("repositories")
        kinds = dict(rows.dtypes)
        rows = rows.withColumns({k: F.when(mine, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in values.items()} | {"updated_at": F.when(mine, F.current_timestamp()).otherwise(F.col("updated_at"))})
        self.publish(repositories=rows)

    def relocate(self, repo_id: str, new_path: str) -> None:
        """RG2, RM3. A checkout that moved keeps its id and graph; a path in use is a conflict."""
        if self.read("repositories").where((F.col("local_path") == new_path.rstrip("/")) & (F.col("id") != repo_id)).count():
            raise Conflict(f"{new_path} is another repository's")
        self.repo(repo_id)
        self.update_repo(repo_id, local_path=new_path.rstrip("/"))

    def link_repo(self, repo_id: str, project: str) -> None:
        """SNK11. Moves a repository and its entities to another project."""
        self.resolve_project(project)
        mine = F.col("id") == repo_id
        repos = self.read("repositories").withColumn("project_id", F.when(mine, project).otherwise(F.col("project_id")))
        self.publish(repositories=repos, entities=K.move_repo(self.read("entities"), repo_id, project))

    def delete_repo(self, repo_id: str) -> dict[str, int]:
        """SNK10. Counts of what goes."""
        self.repo(repo_id)
        e, r = self.read("entities"), self.read("relationships")
        ids = e.where(F.col("repo_id") == repo_id).select("id")
        counts = K.delete_counts(e, r, ids).first().asDict()
        edges = r.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(r.columns)
        keep = {t: self.read(t).where(F.col("repo_id") != repo_id) for t in ("file_hashes", "code_units", "flows", "inline_tests")}
        self.publish(entities=e.where(F.col("repo_id") != repo_id), relationships=edges, repositories=self.read("repositories").where(F.col("id") != repo_id), **keep)
        return counts

    def delete_project(self, project: str) -> dict[str, int]:
        """SNK10."""
        total = {"entities": 0, "relationships": 0}
        for r in self.repos(project).select("id").collect():  # repositories of one project
            total = {k: total[k] + v for k, v in self.delete_repo(r.id).items()}
        self.publish(**{t: self.read(t).where(F.col(c) != project) for t, c in (("projects", "id"), ("insights", "project_id"), ("conventions", "project_id"))})
        return total

    # ---- runs and vectors

    def record_run(self, run: dict) -> None:
        """SNK14."""
        self.publish(analysis_runs=K.last_wins(self.read("analysis_runs").unionByName(self._rows("analysis_runs", [run])), ["id"], ["finished_at", "started_at"]))

    def save_vectors(self, rows: DataFrame, model: str) -> None:
        """SNK15. Vectors with the name of the model that made them."""
        self.publish(vectors=rows)
        self._replace("vectors/model", model)

    def load_vectors(self, model: str) -> DataFrame:
        """SNK15. Refuses vectors that another model made."""
        made = self._read("vectors/model")
        if made != model:
            raise StaleIndex(f"vectors were made by {made!r}, not {model!r}")
        return self.read("vectors")
