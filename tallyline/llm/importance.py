"""Quality classifier by importance resampling.

Two generative models over hashed byte n-grams, one of target text and one of all raw text, give every document the
logarithm of its importance weight. That is a sum over its n-grams, which in long texts adds up the slightest difference
of language or topic; so a text of more than GRAMS n-grams weighs as much as GRAMS of its average ones. Documents are drawn
without replacement by Gumbel top-k: the k largest sums of (this) weight and Gumbel noise, the noise being a function of the
document's id, so a run can be repeated. By default k is the number of documents whose weight reaches the cut that best separates the labelled ones; the cut lies half way between the
lowest good value that is kept and the highest bad one below it.

The raw model counts every n-gram of every document, whatever its length. The target model and the cut are fitted on at most
``labelled_rows`` labelled documents (those with the smallest hash of the id). The models have BUCKETS entries whatever the
input.

Defined results: a text without n-grams (null, empty, shorter than N bytes) has the log weight NO_TEXT, below that of any other:
it is drawn when all others are. Without good labels every other weight is 1; without labels of both kinds the cut is
-infinity, so everything is kept. A document labelled twice is good if all its labels are. Ties of the noisy weight are broken
by a hash of the id. Repeated rows are drawn alike. An empty table gives no rows. Very long texts are counted in pieces of
rows, one long text at a time. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyline.llm import vector
from tallyline.session import pin

N = 3  # bytes of an n-gram: a context of two and the byte that follows
CONTEXT_BITS = 11
BUCKETS = 1 << (CONTEXT_BITS + 7)  # hashed context, low seven bits of the byte
SHRINK = 50.0  # pseudo-occurrences of a context by which the target model leans on the raw one
NO_TEXT = -1e9
GRAMS = 1_000
LABELLED_ROWS = 20_000
SEED = 11
EXACT_ROWS = 20_000  # the last rows around the threshold are ordered, not counted


def _buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of N bytes inside a row, and the first run of every row (and the total)."""
    runs = np.maximum(np.diff(bounds) - N + 1, 0)
    if len(data) < N:
        return np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(runs)])
    wide = data.astype(np.uint32)
    context = ((wide[:-2] << np.uint32(8) | wide[1:-1]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - CONTEXT_BITS)
    value = context << np.uint32(7) | wide[2:] & np.uint32(127)
    inside = np.ones(len(value), bool)
    for k in range(1, N):
        ends = bounds[1:-1] - k  # a run that begins here would cross into the next row
        inside[ends[(ends >= 0) & (ends < len(value))]] = False
    return value[inside].astype(np.int64), np.concatenate([[0], np.cumsum(runs)])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) from (text, target boolean): one row per bucket and task, summed."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for first, data, bounds in vector.pieces(batch.column("text")):
                at, starts = _buckets(data, bounds)
                raw += np.bincount(at, minlength=BUCKETS)
                taken = np.repeat(good[first: first + len(bounds) - 1], np.diff(starts))
                target += np.bincount(at[taken], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    partial = docs.mapInArrow(count, "bucket long, raw long, target long")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: pa.Table) -> np.ndarray:
    """log p_target(byte | context) - log p_raw(byte | context) of every bucket.

    Conditional models: how much text of a language or a topic either side has cancels out.
    """
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("bucket").to_numpy()
    raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    by_context = lambda x: np.repeat(x.reshape(-1, 128).sum(1), 128)
    p_raw = (raw + 1e-9) / (by_context(raw) + 128e-9)
    return np.log((target + SHRINK * p_raw) / (by_context(target) + SHRINK)) - np.log(p_raw)


def label_sample(labels: DataFrame, label: str, label_key: str, rows: int) -> DataFrame:
    """(id, target) of at most ``rows`` labelled documents: small enough for a broadcast."""
    one = labels.groupBy(F.col(label_key).alias("id")).agg((F.min(label) == 1).alias("target")).where("id IS NOT NULL AND target IS NOT NULL")
    return one.orderBy(F.xxhash64("id"), "id").limit(rows)


def weigh(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_grams, log_weight) of every row; ``carry`` names further columns to keep."""
    vector.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    marked = rows.join(F.broadcast(sample), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    ratio = log_ratios(gram_counts(marked).toArrow())  # at most BUCKETS rows, as columns: a fraction of their size as rows

    kept = list(dict.fromkeys([key, text, *carry]))
    fields = [f for f in docs.select(*kept).schema.fields if f.name == key or f.name in carry]
    names = [f.name for f in fields]

    def score(batches):
        for batch in batches:
            weight, grams = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, data, bounds in vector.pieces(batch.column(text)):
                at, starts = _buckets(data, bounds)
                n = len(bounds) - 1
                total = np.concatenate([[0.0], np.cumsum(ratio[at])])
                grams[first: first + n] = np.diff(starts)
                weight[first: first + n] = np.where(grams[first: first + n] > 0, total[starts[1:]] - total[starts[:-1]], NO_TEXT)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(grams), pa.array(weight)], [*names, "n_grams", "log_weight"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_grams long, log_weight double"
    return docs.select(*kept).mapInArrow(score, schema)


def top_threshold(scores: DataFrame, k: int) -> tuple[float, list] | None:
    """The value above which rows are taken whatever the ties, and the (value, id) rows still taken from there on downwards.

    The interval that holds the k-th largest value is cut by counting until few rows are left in it.
    """
    low, high, n = scores.agg(F.min("value"), F.max("value"), F.count("*")).first()
    if k >= n or n == 0:
        return None
    above = 0  # rows over ``high``
    while n > EXACT_ROWS and high > low:
        parts = 1024
        wide = (high - low) / parts
        if low + wide <= low:
            break
        at = f"least({parts - 1}, greatest(0, int(floor((value - {low!r}D) / {wide!r}D))))"
        counted = scores.where(F.col("value").between(low, high)).groupBy(F.expr(at).alias("at")).agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy(F.desc("at")).collect()
        for r in counted:
            if above + r.n >= k:
                if (r.low, r.high) == (low, high):
                    n = r.n
                    low = high
                else:
                    low, high, n = r.low, r.high, r.n
                break
            above += r.n
    # ties of one value share an id order; they are ordered on the executors and only the last one comes back
    edge = scores.where(F.col("value").between(low, high)).orderBy(F.desc("value"), "tie").limit(k - above).agg(
        F.min(F.struct(F.col("value"), (-F.col("tie")).alias("tie")))).first()[0]
    return edge.value, -edge.tie


def best_cut(weighed: DataFrame, key: str, sample: DataFrame) -> float:
    """The lowest weight at which the share of good labelled documents kept, less that of bad ones, is within half a percent of the best.

    It is moved into the gap below: half way to the next bad value, or to the next good one that was given up.
    """
    rows = weighed.select(F.col(key).alias("id"), "weight").join(F.broadcast(sample), "id").select("target", "weight").collect()
    good = np.sort([r.weight for r in rows if r.target])
    bad = np.sort([r.weight for r in rows if not r.target])
    if not len(good) or not len(bad):
        return -math.inf
    gain = np.searchsorted(bad, good) / len(bad) - np.arange(len(good)) / len(good)
    lowest = good[np.flatnonzero(gain >= gain.max() - 0.005)[0]]
    below = [x[k - 1] for x in (good, bad) if (k := np.searchsorted(x, lowest))]
    return float((lowest + max(below)) / 2 if below else lowest)


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", label_key: str = "doc_id",
             k: int | None = None, seed: int = SEED, labelled_rows: int = LABELLED_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows drawn: (key, carried columns, n_grams, log_weight of the whole text, weight, noisy)."""
    sample = pin(label_sample(labels, label, label_key, labelled_rows), "labelled")
    noise = f"-ln(-ln((shiftrightunsigned(xxhash64({seed}, `{key}`), 11) + 0.5D) / {2.0**53!r}D))"
    weighed = weigh(docs, sample, key, text, carry).withColumn("weight", F.expr(f"log_weight / greatest(n_grams, {GRAMS}) * {GRAMS}"))
    weighed = weighed.withColumn("noisy", F.expr(f"weight + {noise}"))
    pinned = pin(weighed, "importance")
    scores = pinned.selectExpr("noisy AS value", f"xxhash64({seed + 1}, `{key}`) AS tie")
    if k is None:
        cut = best_cut(pinned, key, sample)
        k = pinned.count() if cut == -math.inf else pinned.where(f"weight >= {cut!r}D").count()
    if k <= 0:
        return pinned.limit(0)
    edge = top_threshold(scores, k)
    if edge is None:
        return pinned
    value, tie = edge
    return pinned.where(f"noisy > {value!r}D OR (noisy = {value!r}D AND xxhash64({seed + 1}, `{key}`) <= {tie}L)")
