"""Calibrators of residual logits, fitted with distributed passes over the calibration rows."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.functions.numeric import CALIBRATION_CLIP, clip, logit, sigmoid
from tallyline.operators import isotonic
from tallyline.operators.evaluate import calibration_bins, calibration_error, log_loss_of, merge_small_bins
from tallyline.session import pin, scratch_path

# The slope and offset grid of the residual Platt fit, the temperature range.
SLOPES = tuple(float(x) for x in np.linspace(0.6, 1.4, 41))
OFFSETS = tuple(float(x) for x in np.linspace(-0.15, 0.15, 61))
TEMPERATURES = (0.01, 20.0)


def residual_frame(df: DataFrame, y="y", p="p", p_mkt="p_mkt") -> DataFrame:
    z = logit(p_mkt, CALIBRATION_CLIP)
    return df.select(
        F.col(y).cast("double").alias("y"), z.alias("z"), (logit(p, CALIBRATION_CLIP) - z).alias("r")
    )


def grid_losses(rows: DataFrame, cells: Sequence[tuple[float, float]]) -> DataFrame:
    """Mean log loss of sigmoid(z + a*r + b) for every cell (a, b).

    Each task reduces its rows to one total per cell (vectorised), so the exchange carries
    tasks x cells numbers, whatever the number of rows.
    """
    a = np.array([c[0] for c in cells])
    b = np.array([c[1] for c in cells])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(a)), 0
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024]
                y, z, r = (part[c].to_numpy()[:, None] for c in ("y", "z", "r"))
                m = z + a * r + b
                total += (np.logaddexp(0.0, m) - y * m).sum(axis=0)
                n += len(part)
        yield pd.DataFrame({"cell": np.arange(len(a)), "a": a, "b": b, "loss": total, "n": n})

    sums = rows.mapInPandas(partial, "cell long, a double, b double, loss double, n long")
    return sums.groupBy("cell", "a", "b").agg(
        F.try_divide(F.sum("loss"), F.sum("n").cast("double")).alias("log_loss")
    )


def platt_grid(df: DataFrame) -> DataFrame:
    return grid_losses(residual_frame(df), [(a, b) for a in SLOPES for b in OFFSETS])


def fit_platt(df: DataFrame) -> dict:
    """Slope and offset with the least loss; the first cell wins ties."""
    best = platt_grid(df).orderBy("log_loss", "cell").first()
    return {"kind": "platt", "a": best["a"], "b": best["b"]}


def slopes(rows: DataFrame, points: Sequence[float]) -> list[tuple[float, float]]:
    """First and second derivative of the mean loss of sigmoid(z + u * r) at every ``u``: one aggregate."""
    p = lambda u: f"1 / (1 + exp(-(z + {float(u)!r}D * r)))"
    sums = rows.agg(*[
        e for i, u in enumerate(points)
        for e in (F.expr(f"avg(r * ({p(u)} - y)) AS d{i}"), F.expr(f"avg(r * r * ({p(u)}) * (1 - {p(u)})) AS c{i}"))
    ]).first()
    return [(sums[f"d{i}"], sums[f"c{i}"]) for i in range(len(points))]


def fit_temperature(df: DataFrame, tolerance: float = 1e-12, passes: int = 60) -> dict:
    """Temperature with the least loss, by Newton steps on u = 1 / T, in which the loss is convex.

    The rows are stored once; a step is one aggregate over them. A step that leaves the bracket is replaced by the bracket's
    geometric middle. Without rows, or where the model never differs from the market, T = 1.
    """
    rows = pin(residual_frame(df), "residuals")
    low, high = 1 / TEMPERATURES[1], 1 / TEMPERATURES[0]
    u = 1.0
    (at_low, _), (here, curve), (at_high, _) = slopes(rows, [low, u, high])
    if not curve:
        return {"kind": "temperature", "T": 1.0}
    if at_low >= 0 or at_high <= 0:
        return {"kind": "temperature", "T": 1 / (low if at_low >= 0 else high)}
    for _ in range(passes):
        low, high = (low, u) if here > 0 else (u, high)
        step = u - here / curve if curve > 0 else low
        if not low < step < high:
            step = math.sqrt(low * high)
        moved, u = abs(step - u), step
        if moved <= tolerance * u:
            break
        here, curve = slopes(rows, [u])[0]
    return {"kind": "temperature", "T": 1 / u}


def fit_isotonic(df: DataFrame, y="y", p="p", range_rows: int = isotonic.RANGE_ROWS) -> dict:
    """Monotone fit; the thresholds are a stored table, the parameters only name it."""
    thresholds, cuts = isotonic.fit(df, y, p, range_rows)
    path = scratch_path(df.sparkSession, "isotonic")
    isotonic.save(thresholds, path)
    return {"kind": "isotonic", "thresholds": path, "cuts": cuts}


def calibrated(params: dict, p: Column | str = "p", p_mkt: Column | str | None = "p_mkt") -> Column:
    """Calibrated probability of a residual calibrator as a column expression."""
    p = F.col(p) if isinstance(p, str) else p
    if p_mkt is None:
        raise ValueError("a residual calibrator needs the market probability")
    z = logit(p_mkt, CALIBRATION_CLIP)
    r = logit(p, CALIBRATION_CLIP) - z
    if params["kind"] == "platt":
        return sigmoid(z + params["a"] * r + params["b"])
    if params["kind"] == "temperature":
        if params["T"] <= 0:
            raise ValueError("temperature must be positive")
        return sigmoid(z + r / params["T"])
    raise ValueError(f"unknown calibrator {params['kind']}")


def calibrate(df: DataFrame, params: dict, p: str = "p", p_mkt: str | None = "p_mkt", output: str = "p_cal") -> DataFrame:
    """``df`` with the calibrated probability, whatever the calibrator."""
    if params["kind"] == "isotonic":
        return isotonic.apply(df, isotonic.load(df.sparkSession, params["thresholds"]), params["cuts"], p, output)
    return df.withColumn(output, calibrated(params, p, p_mkt))


def fit(df: DataFrame, method: str) -> dict:
    return {"platt": fit_platt, "temperature": fit_temperature, "isotonic": fit_isotonic}[method](df)


def candidate_metrics(evaluation: DataFrame, fitted: dict[str, dict], n_bins=10, strategy="quantile", min_bin: int | None = None) -> DataFrame:
    """ECE, Brier and log loss of each fitted candidate, all candidates in one pass."""
    wide = evaluation.select("y", "p", "p_mkt") if "p_mkt" in evaluation.columns else evaluation.select("y", "p")
    for m, f in fitted.items():
        wide = calibrate(wide, f, output=f"__{m}")
    long = wide.select("y", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"__{m}").alias("p")) for m in fitted])))
    bins = calibration_bins(long, n_bins, strategy, ("model",))
    if min_bin is not None:
        bins = merge_small_bins(bins, min_bin, ("model",))
    ece = calibration_error(bins, ("model",))
    p, y = clip("p", *CALIBRATION_CLIP), F.col("y").cast("double")
    rest = long.groupBy("model").agg(
        F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"), F.avg(log_loss_of(y, p)).alias("logloss")
    )
    return ece.join(rest, "model")


def select_calibrator(
    calibration: DataFrame, evaluation: DataFrame | None = None, methods: Iterable[str] = ("platt", "isotonic"), metric: str = "ece", **bins
) -> tuple[dict, DataFrame]:
    fitted = {m: fit(calibration, m) for m in methods}
    metrics = candidate_metrics(evaluation if evaluation is not None else calibration, fitted, **bins)
    best = metrics.orderBy(metric, "model").first()["model"]
    return fitted[best], metrics


def save_calibrator(spark: SparkSession, params: dict, path: str) -> dict:
    """Parameters as JSON; thresholds are copied beside them. Returns what ``load_calibrator`` will."""
    if params["kind"] == "isotonic":
        isotonic.save(isotonic.load(spark, params["thresholds"]), f"{path}/thresholds")
        params = {**params, "thresholds": f"{path}/thresholds"}
    spark.createDataFrame([(json.dumps(params),)], "value string").write.mode("overwrite").text(f"{path}/parameters")
    return params


def load_calibrator(spark: SparkSession, path: str) -> dict:
    params = json.loads(spark.read.text(f"{path}/parameters", wholetext=True).first()[0])
    if params.get("kind") not in ("platt", "temperature", "isotonic"):
        raise ValueError(f"unknown calibrator {params.get('kind')}")
    return params
