"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line, by (doc_id, text hash, line number), equals it or lies within one
character edit of it (lines of ``min_chars`` or more). Lines are compared over the whole corpus,
each once: copies collapse to their earliest first.

The neighbourhood of a line is itself and its one-character deletions, as hashed keys. Within one
edit, lines of equal length share a deletion *at the same position*, and lines of lengths that differ
by one share a deletion of the longer with the shorter itself; so the earliest partner is a minimum
over each key, and no pairs of a group are made. Partners are verified by edit distance.

Emitting every deletion of every line would multiply the corpus by its line length, so lines are
first cut, without loss, to those that share half of their characters (first or last, by the
shorter length) with another: one edit leaves one half as it was.

DataFrame functions only. Defined results: a null text stays null; lines without a word are kept and
never compared; a null doc_id sorts before others; rows that repeat doc_id and text are one document
and get one decision; an empty table gives no rows; other columns are carried, whatever
their names, but n_lines, n_exact and n_near, which are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiergraph.llm.common import cut_lineage, free_prefix, sized

MIN_CHARS = 16


def _lines(docs: DataFrame) -> DataFrame:
    """__id, __th, __no, line of every line with a word."""
    base = docs.where("text is not null").select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"), F.posexplode(F.split("text", "\n")).alias("__no", "line"))
    return base.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _hashes() -> list[Column]:
    """A line's 128-bit name; the first half is also the key of the line itself."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]


def _place() -> Column:
    """Order of lines over the corpus."""
    return F.struct(F.col("__id").alias("id"), F.col("__th").alias("th"), F.col("__no").alias("no"))


def _half_keys() -> Column:
    """Hashes of the first and last half, for this length and the one below as the shorter length."""

    def of(short: Column) -> list[Column]:
        half = F.floor((short - 1) / 2).cast("int")
        return [F.xxhash64(short, F.substring(F.col("line"), F.lit(1), half)), F.xxhash64(-short, F.substring(F.col("line"), F.col("__n") - half + 1, half))]

    return F.array(*of(F.col("__n")), *of(F.col("__n") - 1))


def near_earlier(docs: DataFrame, distinct: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 of the lines of distinct (h1, h2, first) that have an earlier line within one edit."""
    long_lines = _lines(docs).withColumn("__n", F.char_length("line")).where(F.col("__n") >= min_chars)
    keyed = long_lines.select(*_hashes(), "line", F.explode(_half_keys()).alias("half"))
    # keys that two different lines share; partial minima and maxima keep a frequent half cheap
    shared = keyed.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half")
    mates = keyed.join(sized(shared, width=32), "half").select("h1", "h2", "line").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    mates = cut_lineage(mates.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]))
    n = F.char_length("line")
    deletions = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.struct(F.xxhash64(F.concat(F.substring(F.col("line"), F.lit(1), i - 1), F.substring(F.col("line"), i + 1, n))).alias("key"), i.alias("at"))
    )
    whole = F.array(F.struct(F.col("h1").alias("key"), F.lit(0).alias("at")))
    me = F.struct("first", "h1", "h2").alias("me")
    variants = mates.select(me, F.explode(F.concat(whole, deletions)).alias("v")).select("me", "v.key", "v.at")
    # distinct lines that share a deletion at one position differ in that one character: these groups stay small
    same, by_key = W.partitionBy("key", "at"), W.partitionBy("key")
    at_whole = F.col("at") == 0
    substituted = F.when(~at_whole, F.min("me").over(same))
    other = F.when(at_whole, F.min(F.when(~at_whole, F.col("me"))).over(by_key)).otherwise(F.min(F.when(at_whole, F.col("me"))).over(by_key))
    earliest = variants.select("me", F.least(substituted, other).alias("mate")).where("mate < me")
    best = earliest.groupBy("me").agg(F.min("mate").alias("mate")).select("me.h1", "me.h2", F.col("mate.h1").alias("m1"), F.col("mate.h2").alias("m2"))
    text = mates.select("h1", "h2", "line")
    texts = best.join(text, ["h1", "h2"]).join(text.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), F.col("line").alias("mate_line")), ["m1", "m2"])
    return texts.where(F.levenshtein("line", "mate_line", 1).between(0, 1)).select("h1", "h2")


def decisions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """__id, __th, __exact and __near: the line numbers that go, by document; documents that lose none are absent."""
    occurrences = _lines(docs).select(*_hashes(), _place().alias("place"))
    distinct = occurrences.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    near = near_earlier(docs, distinct, min_chars).withColumn("near", F.lit(True))
    judged = distinct.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = occurrences.join(sized(judged, width=96), ["h1", "h2"]).withColumn("exact", ~F.col("place").eqNullSafe(F.col("first"))).where("near or exact")
    return gone.groupBy(F.col("place.id").alias("__id"), F.col("place.th").alias("__th")).agg(
        F.collect_set(F.when(F.col("exact"), F.col("place.no"))).alias("__exact"), F.collect_set(F.when(~F.col("exact"), F.col("place.no"))).alias("__near")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text rewritten, and n_lines (with a word), n_exact and n_near (lines that went)."""
    p = free_prefix(docs.columns)
    went = decisions(docs, min_chars).select(*[F.col(f"__{c}").alias(f"{p}{c}") for c in ("id", "th", "exact", "near")])
    went = sized(went, width=F.lit(64) + 4 * (F.size(f"{p}exact") + F.size(f"{p}near")))
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_exact", "n_near")]
    keyed = docs.withColumn(f"{p}key", F.xxhash64("text"))
    joined = keyed.join(went, keyed["doc_id"].eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}key") == F.col(f"{p}th")), "left")
    lines = F.split("text", "\n")
    # array_except looks positions up by hash
    left = F.array_except(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), f"{p}exact"), f"{p}near")
    text = F.when(F.col(f"{p}th").isNull(), F.col("text")).otherwise(
        F.transform(F.array(lines), lambda x: F.array_join(F.transform(left, lambda i: x[i]), "\n"))[0]
    )
    counted = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return joined.select(
        *[keyed[c] for c in columns],
        text.alias("text"),
        F.coalesce(counted.cast("long"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(f"{p}exact"), F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce(F.size(f"{p}near"), F.lit(0)).cast("long").alias("n_near"),
    )
