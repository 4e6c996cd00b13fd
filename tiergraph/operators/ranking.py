"""Ranking, paging, budgets and caps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiergraph.functions import text as X

SYMBOL_CAP = 2000
# Scores of a symbol's name and what they add to a reason.
EXACT, PREFIX = 4, 2
EXACT_REASON = "; symbol: exact name match"
PREFIX_REASON = "; symbol: name prefix match"
RESPONSE_CAP = 24_000


def any_of(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def keyword(entities: DataFrame, words: list[str], limit: int = 10, tier: str | None = None) -> DataFrame:
    """FIL1, FIL2. Entities whose name or path holds a word, whatever its case, by name and id; the tier is applied before the limit."""
    rows = entities if tier is None else entities.where(F.col("tier") == tier)
    hit = any_of([F.lower("name").contains(w) | F.lower("path").contains(w) for w in words])
    return rows.where(hit).orderBy("name", "id").limit(limit)


def substring_search(entities: DataFrame, needle: str) -> DataFrame:
    """FIL4. The whole needle in name, path or summary, by lower-case name and id."""
    n = needle.lower()
    hit = any_of([F.coalesce(F.lower(c).contains(n), F.lit(False)) for c in ("name", "path", "summary")])
    return entities.where(hit).orderBy(F.lower("name"), "id")


def symbols(entities: DataFrame, words: list[str], cap: int = SYMBOL_CAP) -> DataFrame:
    """FIL5. Non-file entities whose name holds a word, names equal to one first, cap of them."""
    exact = F.lower("name").isin(words)
    hit = any_of([F.lower("name").contains(w) for w in words])
    return entities.where("tier <> 'file'").where(hit).select("id", "name", "parent_id", exact.alias("exact")).orderBy(F.desc("exact"), "name", "id").limit(cap)


def symbol_scores(symbols_: DataFrame, words: list[str]) -> DataFrame:
    """RK2. file_id, symbol_score: 4 if a symbol's lower-case name is a word, 2 if a token of it starts with one; the best counts."""
    name = F.lower("name")
    score = F.when(name.isin(words), EXACT).when(any_of([X.word_matches(name, w) for w in words]), PREFIX).otherwise(0)
    return symbols_.groupBy(F.col("parent_id").alias("file_id")).agg(F.max(score).alias("symbol_score")).where("symbol_score > 0")


def score_files(files: DataFrame, words: list[str]) -> DataFrame:
    """RK1. files (id, name, path) with score (2 for each word that starts a token of the name, else 1 for one of the path) and reason.

    Names and paths are lower-cased first, so case cuts no token. The reason names the words by where they hit.
    """
    words = list(dict.fromkeys(words))
    name = {w: F.coalesce(X.word_matches(F.lower("name"), w), F.lit(False)) for w in words}
    path = {w: ~name[w] & X.word_matches(F.lower(F.coalesce("path", F.lit(""))), w) for w in words}
    total = F.lit(0)
    for w in words:
        total = total + F.when(name[w], 2).when(path[w], 1).otherwise(0)
    listed = lambda hits: F.concat_ws(", ", *[F.when(hits[w], w) for w in words])
    clause = lambda label, hits: F.when(any_of(list(hits.values())), F.concat(F.lit(label), listed(hits)))
    reason = F.concat_ws("; ", clause("name: ", name), clause("path: ", path))
    return files.withColumn("score", total).withColumn("reason", F.when(reason == "", "no query-word hit").otherwise(reason))


def matched(scored: DataFrame, symbol: DataFrame) -> DataFrame:
    """RK3. The scored files that a word hits, or that hold a symbol that one hits."""
    held = symbol.select(F.col("file_id").alias("id"), F.lit(True).alias("held"))
    return scored.join(held, "id", "left").where("score > 0 or held").select(scored.columns)


def rank(scored: DataFrame, symbol: DataFrame, n: int) -> DataFrame:
    """RK2, RK3. The n best of the matched files by the greater of score and symbol score, then path; not_shown counts the rest.

    A symbol score that is the greater says so in the reason. Which files match is decided before (RK3).
    """
    raised = F.coalesce(F.col("symbol_score") > F.col("score"), F.lit(False))
    why = F.concat("reason", F.when(F.col("symbol_score") >= EXACT, EXACT_REASON).otherwise(PREFIX_REASON))
    all_ = scored.join(symbol, scored["id"] == symbol["file_id"], "left")
    all_ = all_.withColumn("total", F.when(raised, F.col("symbol_score")).otherwise(F.col("score"))).withColumn("reason", F.when(raised, why).otherwise(F.col("reason")))
    count = all_.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("not_shown"))
    top = all_.orderBy(F.desc("total"), F.coalesce("path", F.lit(""))).limit(n)
    return top.select("id", "path", F.col("total").cast("bigint").alias("total"), "reason").crossJoin(F.broadcast(count)).orderBy(F.desc("total"), F.coalesce("path", F.lit("")))  # one row


def page(rows: DataFrame, order: list[str], offset: int, n: int) -> DataFrame:
    """RK6. Rows offset to offset + n, with total and next_offset (null at the end)."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    some = rows.orderBy(*order).offset(offset).limit(n)
    after = F.when(F.col("total") > offset + n, F.lit(offset + n).cast("bigint"))
    return some.crossJoin(F.broadcast(total)).withColumn("next_offset", after)  # one row


def cap_prefix(rows: DataFrame, size: str, order: list[str], cap: int = RESPONSE_CAP) -> DataFrame:
    """RK7. The longest prefix of a ranked answer whose sizes sum to cap or less. For answers of one request, not for tables."""
    used = F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= cap)


def budget_groups(rows: DataFrame, by: str, size: str, order: list[Column | str], budget: int) -> DataFrame:
    """RK9. taken and state (full, truncated, skipped) of each row of a group filled in order up to budget."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    taken = F.least(F.col(size), F.greatest(F.lit(0), budget - before))
    state = F.when(taken == F.col(size), "full").when(taken > 0, "truncated").otherwise("skipped")
    return rows.withColumn("taken", taken).withColumn("state", state)


def pack_batches(rows: DataFrame, by: str, order: str, size: str, budget: int, overhead: int = 25) -> DataFrame:
    """RK10. batch of each row of a group: rows in order, a new batch when the next would not fit; a row larger than the budget has its own.

    Each batch depends on the one before, so a group's sizes pass through one task in turn; the rows
    stream and only a running sum is kept.
    """
    slim = rows.select(F.col(by).alias("g"), F.col(order).alias("o"), F.col(size).cast("bigint").alias("s"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        group, used, batch = None, 0, -1
        for pdf in batches:
            out = []
            for g, s in zip(pdf["g"], pdf["s"]):
                need = int(s) + overhead
                if g != group:
                    group, used, batch = g, 0, 0
                elif used and used + need > budget:
                    used, batch = 0, batch + 1
                used += need
                out.append(batch)
            yield pd.DataFrame({"g": pdf["g"], "o": pdf["o"], "s": pdf["s"], "batch": out})

    dealt = slim.repartition("g").sortWithinPartitions("g", "o")
    schema = f"g {dict(slim.dtypes)['g']}, o {dict(slim.dtypes)['o']}, s bigint, batch bigint"
    return dealt.mapInPandas(run, schema).select(F.col("g").alias(by), F.col("o").alias(order), F.col("s").alias(size), "batch")


def shed_to_fit(rows: list[dict], cap: int = RESPONSE_CAP) -> list[dict]:
    """RK8. At most 30 file answers made to fit: depth goes first, then sources are cut at a line, then dropped, last file first."""

    def size() -> int:
        return sum(len(r.get("depth") or "") + len(r.get("source") or "") + len(r["path"]) for r in rows)

    rows = [dict(r) for r in rows]
    for step in ("depth", "cut", "drop"):
        for r in reversed(rows):
            over = size() - cap
            if over <= 0:
                return rows
            if step == "depth":
                r["depth"] = None
            elif step == "cut" and r.get("source"):
                room = max(0, len(r["source"]) - over)
                cut = r["source"].rfind("\n", 0, room + 1)
                r["source"] = r["source"][: max(cut, 0)]
                r["truncated"] = True
            elif step == "drop":
                r["source"] = None
    return rows
