"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps the measurements and one failure bit a rule. Policies
are versions of a mask of rules that count, applied to the stored ledger without reading a text
again; ablations come from a row's bits, or from counting rows by their bits and masking those few counts.

DataFrame functions only. Defined results: a null text has no words and fails ``few_words``; a null
doc_id and repeated rows are kept as they come; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.llm.common import SPACE_CLASS, cut_lineage

WINDOW_WORDS = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Rules by bit: name and the condition of failure over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "2 * n_words > word_chars"),
    ("long_words", "word_chars > 25 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("many_words", "n_words > 1000000"),
]
BASE_RULES = ("few_words", "repeated_windows")

#: Policies by version: the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "short_words", "long_words", "symbols", "repeated_lines", "many_words"),
}
PRODUCTION = "v2"


def mask_of(rules: tuple[str, ...] | list[str]) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in set(rules))


def _let(value: Column, body) -> Column:
    """body over value computed once: a lambda's argument is never evaluated again inside it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, n: int = WINDOW_WORDS) -> Column:
    """Words that lie in an n-word window found twice or more in the text, each word once.

    Windows are compared by 64-bit hash. Only a text with an equal pair of windows is sorted, by
    (hash, position): neighbours of equal hash are repeats, and consecutive repeated windows cover
    the lesser of n and their distance.
    """

    def covered(positions: Column) -> Column:
        gaps = F.zip_with(F.slice(positions, 2, F.size(positions)), positions, lambda b, a: F.when(b.isNull(), F.lit(n)).otherwise(F.least(b - a, F.lit(n))))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def heavy(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def neighbours(s: Column) -> Column:
            both = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

        return _let(_let(pairs, neighbours), covered)

    def from_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), heavy(hashes)).otherwise(0)

    def windows(word_hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(word_hashes) - (n - 1)), lambda i: F.xxhash64(F.slice(word_hashes, i, n)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= n, 0).otherwise(_let(_let(hashed, windows), from_hashes)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", SPACE_CLASS), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    symbols = F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long")
    got = base.select("doc_id", _let(words, of).alias("w"), _let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))
    return got.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def ledger(docs: DataFrame) -> DataFrame:
    """measure() with failed: bit k is set if rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs).withColumn("failed", failed)


def stored(rows: DataFrame) -> DataFrame:
    """The ledger, written once to the shared folder: policies and ablations read its narrow rows, never a text."""
    return cut_lineage(rows)


def apply_policy(rows: DataFrame, version: str = PRODUCTION, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """ledger rows with policy, base_failed, kept and only_rule: the rule without which the policy would keep the row, if there is one."""
    rules = (policies or POLICIES)[version]
    counts = F.lit(mask_of(rules)).cast("long")
    only = F.lit(None).cast("string")
    for r in rules:
        only = F.when(F.col("failed").bitwiseAND(counts) == mask_of([r]), r).otherwise(only)
    base = F.lit(mask_of(BASE_RULES)).cast("long")
    base_failed = F.col("failed").bitwiseAND(base) != 0
    kept = ~base_failed & (F.col("failed").bitwiseAND(counts) == 0)
    return rows.withColumns({"policy": F.lit(version), "base_failed": base_failed, "kept": kept, "only_rule": only})


def ablations(rows: DataFrame, version: str = PRODUCTION, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """rule, failing, only_this, kept_without: of every rule of a policy.

    Ledger rows are first counted by their bits (2 to the number of rules at most, whatever the corpus).
    """
    rules = (policies or POLICIES)[version]
    counts = mask_of(rules)
    by_bits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(counts).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("long").alias("bit")) for r in rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    n = F.col("n")
    return (
        by_bits.select("bits", "n", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, n).otherwise(0)).alias("failing"),
            F.sum(F.when(alone, n).otherwise(0)).alias("only_this"),
            F.sum(F.when(alone | (F.col("bits") == 0), n).otherwise(0)).alias("kept_without"),
        )
    )
