"""SU1, SU2. Summaries of functions in packed batches, and of the tiers above from their children.

The client is a function from prompts to answers that is given to the workers; without one, nothing
is summarised. No network is used here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tiergraph.functions import text as X
from tiergraph.operators.ranking import pack_batches

Client = Callable[[list[str]], list[str | None]]


def first_sentence_client(prompts: list[str]) -> list[str | None]:
    """A stand-in that answers each '#i:' snippet with its first line."""
    out = []
    for p in prompts:
        lines = [x for x in p.split("\n") if x.startswith("#") and ":" in x]
        out.append("\n".join(f"{x.split(':', 1)[0]}: {x.split(':', 1)[1].strip()[:80]}" for x in lines) or p.strip().split("\n")[-1][:80])
    return out


def ask(prompts: DataFrame, client: Client) -> DataFrame:
    """prompts (.., prompt) with answer; a prompt that fails has none."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            try:
                answers = client(list(pdf["prompt"]))
            except Exception:  # one by one, so that one failure costs one answer
                answers = []
                for p in pdf["prompt"]:
                    try:
                        answers += client([p])
                    except Exception:
                        answers.append(None)
            yield pdf.assign(answer=answers)

    return prompts.mapInPandas(run, T.StructType(prompts.schema.fields + [T.StructField("answer", T.StringType())]))


def summarize_functions(units: DataFrame, client: Client, budget: int = 8_000) -> DataFrame:
    """SU1. id, summary of units (repo_id, id, name, code): packed in order up to budget characters, answers '#i: text' taken apart; what is missing is salvaged by itself once."""
    body = F.concat_ws("\n", "name", F.left("code", F.lit(budget)))
    rows = units.select("repo_id", "id", body.alias("text")).withColumn("size", F.char_length("text"))
    packed = pack_batches(rows, "repo_id", "id", "size", budget).select("repo_id", "id", "batch").join(rows, ["repo_id", "id"])
    numbered = packed.withColumn("i", F.row_number().over(W.partitionBy("repo_id", "batch").orderBy("id")) - 1)
    line = F.concat(F.lit("#"), F.col("i").cast("string"), F.lit(": "), F.regexp_replace("text", r"\s+", " "))
    prompts = numbered.groupBy("repo_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda x: x["t"]), "\n").alias("prompt"), F.count(F.lit(1)).alias("n"))
    answers = ask(prompts, client).withColumn("texts", X.batch_responses(F.coalesce("answer", F.lit("")), 200))
    got = numbered.join(answers.select("repo_id", "batch", "texts"), ["repo_id", "batch"]).select("id", "text", F.try_element_at("texts", F.col("i") + 1).alias("summary"))
    alone = ask(got.where("summary is null").select("id", F.concat(F.lit("#0: "), F.regexp_replace("text", r"\s+", " ")).alias("prompt")), client)
    saved = alone.select("id", X.batch_responses(F.coalesce("answer", F.lit("")), 1)[0].alias("summary"))
    return got.where("summary is not null").select("id", "summary").unionByName(saved)


def roll_up(entities: DataFrame, tier: str, client: Client) -> DataFrame:
    """SU2. id, summary, skipped of a tier's entities: the first three children's summaries make the prompt.

    skipped says why there is none: no_children, or children_without_summaries.
    """
    mine = entities.where(F.col("tier") == tier).select("id", "name")
    kids = entities.where("parent_id is not null").select(F.col("parent_id").alias("id"), F.struct("name", "path", "summary").alias("c"))
    rn = F.row_number().over(W.partitionBy("id").orderBy(F.col("c.name"), F.col("c.path")))
    some = kids.withColumn("rn", rn)
    said = some.where(F.col("c.summary").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("said"))
    n = kids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("- "), F.col("c.name"), F.lit(": "), F.coalesce("c.summary", F.lit("")))
    text = some.where("rn <= 3").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("t")))), lambda x: x["t"]), "\n").alias("children"))
    joined = mine.join(n, "id", "left").join(said, "id", "left").join(text, "id", "left")
    reason = F.when(F.col("n").isNull(), "no_children").when(F.col("said").isNull(), "children_without_summaries")
    ready = joined.where("said is not null").select("id", F.concat(F.lit(f"Say what the {tier} '"), "name", F.lit("' is for, from its parts:\n"), "children").alias("prompt"))
    done = ask(ready, client).select("id", F.col("answer").alias("summary"), F.lit(None).cast("string").alias("skipped"))
    return done.unionByName(joined.where("said is null").select("id", F.lit(None).cast("string").alias("summary"), reason.alias("skipped")))


def incomplete(entities: DataFrame) -> DataFrame:
    """RM7. Function entities that still want a summary."""
    return entities.where("tier = 'function'").where(X.missing_summary(F.col("summary"), F.col("name")))


def outcome(results: DataFrame) -> DataFrame:
    """RM21, RM22. summarized, missing."""
    return results.agg(F.count("summary").alias("summarized"), F.count_if(F.col("summary").isNull()).alias("missing"))
