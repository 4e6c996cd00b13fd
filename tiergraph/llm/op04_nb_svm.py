"""Quality classifier: naive Bayes support vectors.

Binary n-gram indicators are scaled by their class log-count ratios, then a linear model is fitted
under the squared hinge loss by dual coordinate descent, and its margin is made a probability by a
logistic fitted on margins that did not see their rows. N-grams run over words (1 and 2) and over word
shapes (1 to 3); a shape says how a word is cased, numbered and punctuated and whether it repeats the
word before it. An n-gram that one row of the sample alone holds has ratio zero.

The fit takes labelled rows in the order of a hash of doc_id: at most ``sample`` of them, and no more
than have ``SAMPLE_BYTES`` of indicators together (the first always counts); scoring covers every row.

Defined results: a null text scores as an empty one, which has the bias alone; a null doc_id is
scored and never trains; labels that repeat a doc_id count once, by their smallest value; of rows that
repeat a doc_id the one with the least text trains, and each is scored; without labels of both classes every score is 0.5 moved by nothing else;
an empty table gives no rows; lang, source and other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiergraph.llm.common import cut_lineage, free_prefix, give_back

BUCKETS = 1 << 18
SAMPLE = 20_000
#: Indicators (4 bytes each) that the fit takes at most.
SAMPLE_BYTES = 256 << 20
THRESHOLD = 0.7
MEMO_WORDS = 120_000
MIX = np.uint64(0x9E3779B97F4A7C15)  # 2^64 divided by the golden ratio


def shape(word: str) -> str:
    """Letters as X or x, digits as 9, runs of one sign as one; other signs as they are, runs as two."""
    out, last, run = [], "", 0
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        run = run + 1 if k == last else 1
        if run == 1 or (run == 2 and k not in "Xx9"):
            out.append(k)
        last = k
    return "".join(out) + ("~" if len(word) > 24 else "")


class _Memo(dict):
    """word -> its 32-bit hash above its shape's 31-bit hash."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 31 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) >> 1
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value
        return value


MEMO = _Memo()


def _hash(*columns: np.ndarray, kind: int) -> np.ndarray:
    h = np.full(len(columns[0]), kind, np.uint64)
    for c in columns:
        h = (h ^ c) * MIX
        h ^= h >> np.uint64(29)
    return ((h * MIX) >> np.uint64(46)).astype(np.int64)  # the top 18 bits


def indicators(text: str | None) -> np.ndarray:
    """Sorted buckets of the n-grams that a whole text holds."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    packed = np.fromiter(map(MEMO.__getitem__, words), np.int64, len(words)).view(np.uint64)
    word, form = packed >> np.uint64(31), packed & np.uint64((1 << 31) - 1)
    again = np.zeros(len(words), np.uint64)
    again[1:] = word[1:] == word[:-1]
    form = form << np.uint64(1) | again
    found = np.zeros(BUCKETS, bool) if len(words) > 20_000 else None
    parts = [_hash(word, kind=1), _hash(form, kind=3)]
    if len(words) > 1:
        parts += [_hash(word[:-1], word[1:], kind=2), _hash(form[:-1], form[1:], kind=4)]
    if len(words) > 2:
        parts.append(_hash(form[:-2], form[1:-1], form[2:], kind=5))
    if found is not None:
        for p in parts:
            found[p] = True
        return np.flatnonzero(found)
    return np.unique(np.concatenate(parts))


@dataclass(frozen=True)
class Model:
    """weights hold ratio x coefficient of each bucket; score = 1 / (1 + exp(-(slope x margin + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, buckets: np.ndarray) -> float:
        margin = float(self.weights[buckets].sum()) / max(1.0, float(len(buckets)) ** 0.5) + self.bias
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of (alpha + documents of class 1 with the n-gram) over the same of class 0, each normed."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for c in (0, 1):
        some = [r for r, k in zip(rows, y) if k == c]
        for lo in range(0, len(some), 500):
            counts[c] += np.bincount(np.concatenate(some[lo : lo + 500]), minlength=BUCKETS)
    q, p = alpha + counts
    seen = counts.sum(axis=0) > 1  # an n-gram of one document says nothing of others
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    return np.where(seen, np.log(p / (n1 + 2 * alpha)) - np.log(q / (n0 + 2 * alpha)), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7, tolerance: float = 0.05) -> tuple[np.ndarray, float]:
    """Minimises half the squared norm plus the cost-weighted squared hinge losses, one dual variable at a time.

    A row's values are its buckets' ratios over the square root of its length, taken when needed.
    """
    w, bias = np.zeros(BUCKETS), 0.0
    dual = np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    damp = 0.5 / cost
    scale = np.array([1.0 / max(1.0, len(r) ** 0.5) for r in rows])
    norm = np.array([float((ratios[r] ** 2).sum()) * k * k + 1.0 for r, k in zip(rows, scale)]) + damp
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            v = ratios[r] * scale[i]
            slope = sign[i] * (float(w[r] @ v) + bias) - 1.0 + damp[i] * dual[i]
            if dual[i] == 0.0 and slope >= 0.0:
                continue
            worst = max(worst, abs(slope))
            new = max(dual[i] - slope / norm[i], 0.0)
            step = (new - dual[i]) * sign[i]
            w[r] += step * v
            bias += step
            dual[i] = new
        if worst < tolerance:
            break
    return w, bias


def fit_logistic(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """slope and shift of the logistic that best gives y (smoothed) from margins, by Newton's method."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 0.0), b


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0) -> Model:
    """The model of labelled indicator rows.

    A machine, ratios and all, of four fifths gives margins of the last fifth, on which the logistic
    is fitted; the machine that scores is of all rows.
    """
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0)

    def machine(at: np.ndarray) -> tuple[np.ndarray, float]:
        some = [rows[i] for i in at]
        share = np.array([(y[at] == 0).mean(), (y[at] == 1).mean()])
        costs = cost * 0.5 / share[::-1][y[at]]  # both classes weigh the same
        ratios = log_count_ratios(some, y[at])
        w, b = dual_coordinate_descent(some, ratios, y[at], costs)
        return w * ratios, b

    every = np.arange(len(rows))
    fold = every % 5 == 4
    w, b = machine(every)
    v, c = w, b
    if len(set(y[~fold].tolist())) < 2 or len(set(y[fold].tolist())) < 2:
        fold[:] = True
    else:
        v, c = machine(every[~fold])
    margin = np.array([v[rows[i]].sum() / max(1.0, len(rows[i]) ** 0.5) + c for i in every[fold]])
    slope, shift = fit_logistic(margin, y[fold])
    return Model(w, b, slope, shift)


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, quality of at most ``sample`` labelled rows, one a doc_id, whose crc32(doc_id as text) mod 4 is not 2.

    The labels are cut to the sample first, so that what is sent to the documents is bounded.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    return rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on the driver from the sample's indicators, bounded in rows by ``sample`` and in bytes by ``sample_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [indicators(t).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(data, pa.binary())], names=["doc_id", "quality", "buckets"])
        give_back()

    rows = cut_lineage(training_sample(docs, labels, sample).select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, buckets binary"))
    before = F.sum(F.octet_length("buckets")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    # a row of two numbers for each of ``sample`` rows at most
    fits = rows.select("doc_id", "buckets").withColumn("bytes", before).where((F.col("bytes") <= sample_bytes) | (F.col("bytes") == F.octet_length("buckets"))).select("doc_id")
    rows = rows.join(F.broadcast(fits), "doc_id").toArrow()
    data = [np.frombuffer(b.as_buffer(), "<i4") for b in rows.column("buckets")]  # views, not copies
    ids, y = rows.column("doc_id").to_numpy(), rows.column("quality").to_numpy()
    order = np.lexsort(([zlib.crc32(d) for d in data], ids))
    return fit([data[i] for i in order], y[order])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """keep's columns, then the score and whether it reaches the threshold, for every row of docs. The model's size is fixed by BUCKETS.

    The last two columns are named __score and __predicted, with more underscores where docs has such names.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.slope, model.shift))
    keep = keep or ["doc_id"]
    p = free_prefix(docs.columns)
    named = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*named).schema.add(f"{p}score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for batch in batches:
            scores = [m.score(indicators(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(scores, pa.float64())], names=[*keep, f"{p}score"])
        give_back()

    scored = docs.select(*named, F.col("text").alias(f"{p}text")).mapInArrow(run, schema)
    return scored.withColumn(f"{p}predicted", (F.col(f"{p}score") >= threshold).cast("int"))
