"""Vector search and retrieval evaluation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.functions import text as X


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def with_norm(vectors: DataFrame) -> DataFrame:
    """SE2. The index: vectors with their norms, computed once."""
    return vectors.withColumn("norm", norm(F.col("embedding")))


def nearest(index: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """SE3. The k vectors nearest one query (query_embedding) by (1 + cosine) / 2, then id; exact, one pass, no shuffle of vectors."""
    q = query.select("query_embedding").withColumn("query_norm", norm(F.col("query_embedding")))
    cosine = dot(F.col("embedding"), F.col("query_embedding")) / (F.col("norm") * F.col("query_norm"))
    scored = index.crossJoin(F.broadcast(q)).where("norm > 0 and query_norm > 0").withColumn("score", F.round((1 + cosine) / 2, 6))  # one query
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def nearest_resolved(index: DataFrame, query: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """SE3. Twice k hits are fetched, those with an entity (vec_id, path) stay, the k best of them count."""
    hits = nearest(index, query, 2 * k)
    return hits.join(entities, "vec_id").orderBy(F.desc("score"), "vec_id").limit(k)


def suffix_hits(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """JN20. hits (hit, path) to entities (id, path): the same path, else one path a suffix of the other; the least id counts.

    Suffixes are listed and joined by equality, so no pair of unrelated paths is compared.
    """

    def tails(p: str) -> Column:
        parts = F.split(p, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))

    e = entities.select("id", F.col("path").alias("epath"))
    same = hits.join(e, hits["path"] == F.col("epath")).select("hit", "id", F.lit(0).alias("how"))
    longer = hits.select("hit", F.explode(tails("path")).alias("epath")).join(e, "epath").select("hit", "id", F.lit(1).alias("how"))
    shorter = e.select("id", F.explode(tails("epath")).alias("path")).join(hits, "path").select("hit", "id", F.lit(1).alias("how"))
    return same.unionByName(longer).unionByName(shorter).groupBy("hit").agg(F.min_by("id", F.struct("how", "id")).alias("id"))


def embed(rows: DataFrame, text: str, size: int = 64) -> DataFrame:
    """SE1. rows with embedding: token counts hashed to signed places and normed, a stand-in where no model is at hand."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import re

        for pdf in batches:
            out = []
            for t in pdf[text]:
                v = np.zeros(size, np.float32)
                for w in re.findall(r"[^\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1.0 if h & 0x80000000 else -1.0
                n = float(np.sqrt((v * v).sum()))
                out.append((v / n if n else v).tolist())
            yield pdf.assign(embedding=out)

    return rows.mapInPandas(run, T.StructType(rows.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def recall_at_k(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """SE5. probe, recall: of truth (probe, item) found among the first k of ranked (probe, item, rank), by occurrence."""
    n = truth.groupBy("probe").agg(F.count(F.lit(1)).alias("wanted"))
    hit = ranked.where(F.col("rank") <= k).join(truth.distinct(), ["probe", "item"], "left_semi").groupBy("probe").agg(F.count(F.lit(1)).alias("found"))
    return n.join(hit, "probe", "left").select("probe", F.round(F.coalesce("found", F.lit(0)) / F.col("wanted"), 6).alias("recall"))


def mrr(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """SE6. probe, rr: one over the first rank that hits, 0 without a hit."""
    first = ranked.join(truth.distinct(), ["probe", "item"], "left_semi").groupBy("probe").agg(F.min("rank").alias("first"))
    return truth.select("probe").distinct().join(first, "probe", "left").select("probe", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def validate_probes(probes: DataFrame, corpus: DataFrame) -> DataFrame:
    """SE7. probe, in_corpus, overlap: whether the target (path) is in corpus (path), and how many query tokens its path shares."""
    known = corpus.select("path").distinct().withColumn("known", F.lit(True))
    shared = F.size(F.array_intersect(X.tokens(F.col("query")), X.tokens(F.col("path"))))
    return probes.join(known, "path", "left").select("probe", F.coalesce("known", F.lit(False)).alias("in_corpus"), shared.cast("bigint").alias("overlap"))


def probe_gate(results: DataFrame, least_recall: float, least_payload: int) -> DataFrame:
    """SE8. worst_recall, mean_recall, least_payload and passed over results (probe, recall, payload)."""
    return results.agg(
        F.min("recall").alias("worst_recall"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.min("payload").alias("least_payload"), ((F.min("recall") >= least_recall) & (F.min("payload") >= least_payload)).alias("passed")
    )


def coverage_warning(hits: DataFrame, indexed: int, total: int) -> tuple[str | None, bool]:
    """SE4. A warning if vectors cover less than all entities, and whether to fall back on keywords (no hit)."""
    warning = None if indexed >= total else f"{indexed} of {total} entities have vectors"
    return warning, hits.isEmpty()
