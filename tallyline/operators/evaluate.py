"""Evaluation of probability predictions held as a long table (model, split, y, p)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyline.functions.numeric import MODEL_CLIP, clip, logit, one_row
from tallyline.operators.ordering import exact_quantiles, ordered_cumsum
from tallyline.session import pin

GROUP = ("model", "split")


def log_loss_of(y: Column, p: Column) -> Column:
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def score_counts(pred: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Positives and negatives per distinct (clipped) score, written once: every statistic below reads it several times."""
    counts = pred.select(*keys, "y", clip("p", *MODEL_CLIP).alias("p")).groupBy(*keys, "p").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"),
    )
    return pin(counts, "score-counts")


def roc_auc(pred: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Tie-aware exact AUC from counts per distinct score; NULL unless both classes occur."""
    ranked = ordered_cumsum(score_counts(pred, keys), keys, "p", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*keys).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def probability_metrics(pred: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    p = clip("p", *MODEL_CLIP)
    y = F.col("y").cast("double")
    base = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(log_loss_of(y, p)).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg("p").alias("mean_pred"),
        F.stddev_pop("p").alias("std_pred"),
    )
    return base.join(roc_auc(pred, keys), list(keys))


def compare_models(pred: DataFrame, baseline: str = "market") -> DataFrame:
    """Metrics per model and split with the differences to the baseline model of the split."""
    m = probability_metrics(pred)
    at_base = W.partitionBy("split")  # one row per model

    def base(c):
        return F.max(F.when(F.col("model") == baseline, F.col(c))).over(at_base)

    return m.select(
        "*",
        (F.col("log_loss") - base("log_loss")).alias("delta_log_loss_vs_market"),
        (F.col("brier") - base("brier")).alias("delta_brier_vs_market"),
    ).orderBy("split", "log_loss", "model")


def roc_points(pred: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """fpr / tpr of the rule 'score >= threshold' at each distinct score."""
    counts = score_counts(pred, keys)
    ranked = ordered_cumsum(counts, keys, "p", ["pos", "neg"])
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return ranked.join(totals, list(keys)).select(
        *keys,
        F.col("p").alias("threshold"),
        F.try_divide((F.col("n_neg") - F.col("before_neg")).cast("double"), F.col("n_neg").cast("double")).alias("fpr"),
        F.try_divide((F.col("n_pos") - F.col("before_pos")).cast("double"), F.col("n_pos").cast("double")).alias("tpr"),
    )


# ---- calibration error --------------------------------------------------------------------


def bin_edges(pred: DataFrame, n_bins: int, strategy: str, keys: Sequence[str] = GROUP) -> DataFrame:
    """One row per group with the sorted distinct edges, ends forced to 0 and 1."""
    if strategy == "uniform":
        edges = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
        return pred.groupBy(*keys).agg(F.max(edges).alias("edges"))
    q = exact_quantiles(pred, ["p"], [i / n_bins for i in range(n_bins + 1)], keys)
    inner = F.slice("q", 2, n_bins - 1)
    edges = F.array_distinct(F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0))))
    return q.select(*keys, F.sort_array(edges).alias("edges"))


def calibration_bins(pred: DataFrame, n_bins: int = 10, strategy: str = "uniform", keys: Sequence[str] = GROUP) -> DataFrame:
    """Count, positives and probability total per non-empty right-closed bin."""
    keys = list(keys)
    if strategy == "uniform":
        # the same edges for every group: nothing to join, and the predictions are not dealt by their few groups
        edges = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
        binned = pred.dropna(subset=keys).withColumn("edges", edges)
    else:
        found = pin(bin_edges(pred, n_bins, strategy, keys), "bin-edges")  # one row per group, of known size
        binned = pred.join(found, keys)
    inner = F.slice("edges", F.lit(2), F.size("edges") - 2)
    # the edges come back to the bins: an array in the aggregate would sort all predictions
    bins = (
        binned.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("p"))))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("y").cast("double")).alias("sum_y"),
            F.sum("p").alias("sum_p"),
        )
    )
    if strategy == "uniform":
        return bins.withColumn("edges", edges)
    return bins.join(found, keys).select(*bins.columns, "edges")


def merge_small_bins(bins: DataFrame, minimum: int, keys: Sequence[str] = GROUP) -> DataFrame:
    """Adjacent bins accumulate left to right until ``minimum`` rows; the last one closes.

    A group has at most n_bins (~25) bins, so its bins fit an array fold.
    """
    per_bin = F.struct("bin", "n", "sum_y", "sum_p")
    rows = bins.groupBy(*keys).agg(F.collect_list(per_bin).alias("bins"), F.max("edges").alias("edges"))
    last = F.size("edges") - 2
    found = F.map_from_entries(F.transform("bins", lambda b: F.struct(b["bin"], F.struct(b["n"], b["sum_y"], b["sum_p"]))))
    full = rows.withColumn("found", found).withColumn(
        "all_bins", F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.try_element_at("found", i).alias("v")))
    )
    empty = F.expr(
        "named_struct('done', cast(array() as array<struct<n:bigint,sum_y:double,sum_p:double,low:double,high:double>>),"
        " 'n', 0L, 'y', 0.0D, 'p', 0.0D, 'low', edges[0])"
    )

    def step(acc, b):
        n = acc["n"] + F.coalesce(b["v"]["n"], F.lit(0))
        y = acc["y"] + F.coalesce(b["v"]["sum_y"], F.lit(0.0))
        p = acc["p"] + F.coalesce(b["v"]["sum_p"], F.lit(0.0))
        high = F.get("edges", b["i"] + 1)
        closes = (n >= minimum) | (b["i"] == last)
        bin_ = F.struct(n.alias("n"), y.alias("sum_y"), p.alias("sum_p"), acc["low"].alias("low"), high.alias("high"))
        zero = F.lit(0.0)
        return F.when(
            closes,
            F.struct(
                F.concat(acc["done"], F.array(bin_)).alias("done"), F.lit(0).cast("long").alias("n"),
                zero.alias("y"), zero.alias("p"), high.alias("low"),
            ),
        ).otherwise(
            F.struct(acc["done"].alias("done"), n.alias("n"), y.alias("y"), p.alias("p"), acc["low"].alias("low"))
        )

    merged = full.select(*keys, F.aggregate("all_bins", empty, step, lambda acc: acc["done"]).alias("m"))
    return merged.select(*keys, F.posexplode("m").alias("bin", "b")).select(*keys, "bin", "b.*")


def reliability(bins: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    n = F.col("n").cast("double")
    mid = ((F.col("low") + F.col("high")) / 2) if "low" in bins.columns else F.lit(None).cast("double")
    return bins.select(
        *keys, "bin", "n",
        F.coalesce(F.try_divide(F.col("sum_p"), n), mid).alias("prob_pred"),
        F.try_divide(F.col("sum_y"), n).alias("prob_true"),
    )


def calibration_error(bins: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Expected calibration error: count-weighted |observed - predicted| over non-empty bins."""
    full = bins.where(F.col("n") > 0)
    gap = F.abs(F.col("sum_y") - F.col("sum_p"))
    return full.groupBy(*keys).agg(F.try_divide(F.sum(gap), F.sum("n").cast("double")).alias("ece"))


# ---- distributions ------------------------------------------------------------------------


def distribution_summary(pred: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Percentiles 1, 5, 25, 50, 75, 95, 99 and the shares below 0.30 and above 0.70."""
    points = (1, 5, 25, 50, 75, 95, 99)
    q = exact_quantiles(pred, ["p"], [x / 100 for x in points], keys)
    tails = pred.groupBy(*keys).agg(
        (F.avg(F.when(F.col("p") < 0.30, 1.0).otherwise(0.0)) * 100).alias("pct_below_30"),
        (F.avg(F.when(F.col("p") > 0.70, 1.0).otherwise(0.0)) * 100).alias("pct_above_70"),
    )
    return q.join(tails, list(keys)).select(
        *keys, *[F.get("q", F.lit(i)).alias(f"p{x}") for i, x in enumerate(points)], "pct_below_30", "pct_above_70"
    )


def logit_delta(pred: DataFrame) -> DataFrame:
    return pred.withColumn("delta", logit("p") - logit("p_mkt"))


def logit_delta_summary(pred: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    d = logit_delta(pred)
    stats = d.groupBy(*keys).agg(
        F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("std_delta")
    )
    q = exact_quantiles(d, ["delta"], [0.05, 0.95], keys)
    return stats.join(q, list(keys)).select(
        *keys, "mean_delta", "std_delta", F.get("q", F.lit(0)).alias("p5"), F.get("q", F.lit(1)).alias("p95")
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed. Empty bins are 0."""
    span = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    lo, hi = F.col("__s")["lo"], F.col("__s")["hi"]
    raw = F.floor(F.try_divide(F.col(value) - lo, hi - lo) * bins)
    b = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))
    counts = (
        df.where(F.col(value).isNotNull()).withColumn("__s", span)
        .groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: lo + (hi - lo) * i / bins
    return (
        grid.join(counts, "bin", "left").withColumn("__s", span)
        .select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def importance_share(gains: DataFrame) -> DataFrame:
    """Per feature: gain, percent of the total and rank (a table of features, so small)."""
    total = gains.agg(F.sum("gain")).scalar()
    w = W.orderBy(F.col("gain").desc(), "feature")
    return gains.select(
        "feature", "gain", (F.try_divide(F.col("gain"), total) * 100).alias("gain_pct"), F.row_number().over(w).alias("rank")
    )


def top_importances(gains: DataFrame, n: int = 20) -> DataFrame:
    return importance_share(gains).orderBy("rank").limit(n)


def stability_score(log: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss", window: int = 5) -> DataFrame:
    """Best moving mean + 0.25 * late rise over the best epoch + 0.02 * too early a peak.

    Fixed values: window 5, weights 0.25 and 0.02, early limit 15 % of the epochs.
    """
    w = W.partitionBy(run).orderBy(epoch)
    rows = log.select(
        run, loss,
        (F.row_number().over(w) - 1).alias("__i"),
        F.count(F.lit(1)).over(W.partitionBy(run)).alias("__n"),
        F.avg(loss).over(w.rowsBetween(-(window - 1), 0)).alias("__mean"),
    )
    i, n = F.col("__i"), F.col("__n")
    # a run shorter than the window has one moving mean: that of all its rows
    complete = i >= F.least(n, F.lit(window)) - 1
    per_run = rows.groupBy(run).agg(
        F.min(F.when(complete, F.col("__mean"))).alias("best_mean"),
        F.max(F.when(i == n - 1, F.col("__mean"))).alias("tail_mean"),
        F.min(loss).alias("best"),
        F.min_by("__i", F.struct(loss, "__i")).alias("best_epoch"),
        F.max("__n").alias("n"),
    )
    late = F.greatest(F.lit(0.0), F.col("tail_mean") - F.col("best"))
    early = F.greatest(F.lit(0.0), (F.floor(F.col("n") * 0.15) - F.col("best_epoch")) / F.col("n"))
    return per_run.select(
        run, F.col("n").alias("epochs"), "best_epoch",
        (F.col("best_mean") + 0.25 * late + 0.02 * early).alias("stability"),
    )
