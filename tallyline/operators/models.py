"""Market baseline, residual and market-free models (boosted trees or linear), stacking, searches over time folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.market import MARKET_PROBABILITY, STACKED_LOGIT, of_role
from tallyline.functions.numeric import MODEL_CLIP, clip, logit, sigmoid
from tallyline.operators import boosting
from tallyline.operators.evaluate import log_loss_of

# Bound and weight of the residual combination.
MAX_RESIDUAL = 0.5
ALPHA = 0.7


def market_baseline(df: DataFrame, p: str = MARKET_PROBABILITY) -> DataFrame:
    if p not in df.columns:
        raise ValueError(f"{p} is required for the market baseline")
    return df.withColumn("p", clip(p, *MODEL_CLIP))


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)


def fit_residual(train: DataFrame, features: Sequence[str], target: str = "y", p_mkt: str = MARKET_PROBABILITY, reg: float = 0.0):
    """Binary logistic model whose margin starts at the market logit."""
    if p_mkt not in train.columns:
        raise ValueError(f"{p_mkt} is required as the offset")
    data = assemble(train, features).withColumn("offset", logit(p_mkt)).withColumn("label", F.col(target).cast("double"))
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", offsetCol="offset", regParam=reg, maxIter=25, tol=1e-8
    )
    return glm.fit(data)


def predict_residual(model, df: DataFrame, features: Sequence[str], p_mkt: str = MARKET_PROBABILITY, output: str = "p") -> DataFrame:
    """sigmoid(market logit + intercept + w.x): the coefficients as one column expression."""
    score = linear_score(features, model.coefficients, model.intercept)
    return df.withColumn(output, sigmoid(logit(p_mkt) + score))


def linear_score(features: Sequence[str], weights, intercept: float) -> Column:
    terms = [F.col(c).cast("double") * float(w) for c, w in zip(features, weights)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))


def fit_residual_trees(
    df: DataFrame, features: Sequence[str], settings: boosting.Settings = boosting.Settings(), train: str = "true", stopping: str = "false",
    target: str = "y", p_mkt: str = MARKET_PROBABILITY,
) -> dict:
    """Boosted trees whose margin starts at the market logit; early stopping on the rows of ``stopping``."""
    if p_mkt not in df.columns:
        raise ValueError(f"{p_mkt} is required as the base margin")
    return boosting.fit(df, features, settings, train, stopping, target, logit(p_mkt))


def predict_residual_trees(model: dict, df: DataFrame, p_mkt: str = MARKET_PROBABILITY, output: str = "p") -> DataFrame:
    return boosting.predict(model, df, logit(p_mkt), output)


def fit_market_free(train: DataFrame, features: Sequence[str], target: str = "y", reg: float = 0.0):
    """Logistic regression; boosted trees without a margin come from ``boosting.fit``."""
    data = assemble(train, features).withColumn("label", F.col(target).cast("double"))
    return LogisticRegression(regParam=reg, maxIter=50).fit(data)


def predict_market_free(model, df: DataFrame, features: Sequence[str], output: str = "p") -> DataFrame:
    if isinstance(model, dict):
        return boosting.predict(model, df, output=output).select(*df.columns, output)
    # the coefficients as one column expression: no model object travels in the plan
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in features])
    p = sigmoid(linear_score(features, model.coefficients, model.intercept))
    out = df.withColumn(output, F.when(missing, F.raise_error(F.lit("a feature is NULL or NaN"))).otherwise(p))
    return out.select(*df.columns, output)


def stack_logit(df: DataFrame, model, pretrained_features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The market-free model's logit as one more feature, after the signature contract."""
    actual = [c for c in of_role(df.columns, "baseball") if c not in keys]
    missing = sorted(set(pretrained_features) - set(actual))
    extra = sorted(set(actual) - set(pretrained_features))
    if missing or extra:
        raise ValueError(f"feature signatures differ: missing {missing}, extra {extra}")
    scored = predict_market_free(model, df, pretrained_features, "__p")
    return scored.withColumn(STACKED_LOGIT, logit("__p")).drop("__p")


def pretraining_border(df: DataFrame, season: str = "season"):
    """The last season of the earlier half: the market-free model learns up to it, the residual model after it."""
    seasons = sorted(r[0] for r in df.select(season).where(F.col(season).isNotNull()).distinct().collect())
    if len(seasons) < 2:
        raise ValueError("a stacked model needs two seasons at least")
    return seasons[len(seasons) // 2 - 1]


def random_candidates(n: int = 20, rounds: int = 100, patience: int = 20, seed: int = 42) -> list[boosting.Settings]:
    """Settings drawn from fixed ranges: depth 2-8, rate 0.001-0.1, shares of rows and columns 0.1-1, and the penalties."""
    rng = np.random.default_rng(seed)
    return [
        boosting.Settings(
            rounds=rounds, patience=patience, depth=int(rng.integers(2, 9)), rate=float(rng.uniform(0.001, 0.1)), subsample=float(rng.uniform(0.1, 1)),
            colsample=float(rng.uniform(0.1, 1)), min_child_weight=int(rng.integers(1, 9)), reg_alpha=float(rng.uniform(0, 1)), reg_lambda=float(rng.uniform(1, 8)),
            gamma=float(rng.uniform(0, 5)), seed=seed,
        ) for _ in range(n)
    ]


def search_trees(
    folded: DataFrame, features: Sequence[str], candidates: Sequence[boosting.Settings], folds: int = 4, target: str = "y", p_mkt: str | None = MARKET_PROBABILITY,
) -> DataFrame:
    """(candidate, fold, rounds, log_loss): every candidate on every expanding fold, all grown together.

    The loss is that of the best round on the fold's own rows, where it also stops.
    """
    tasks = [boosting.Task(s, f"fold < {k}", f"fold = {k}") for s in candidates for k in range(folds)]
    fitted = boosting.fit_many(folded, features, tasks, target, logit(p_mkt) if p_mkt else None)
    rows = []
    for i, model in enumerate(fitted):
        losses = [e["stopping"] for e in model["losses"]]
        rows.append((i // folds, i % folds, len(model["trees"]), losses[len(model["trees"])]))
    return folded.sparkSession.createDataFrame(rows, "candidate int, fold int, rounds int, log_loss double")


def best_candidates(losses: DataFrame) -> DataFrame:
    """Mean fold loss of every candidate, the best first (as a rank)."""
    mean = losses.groupBy("candidate").agg(F.avg("log_loss").alias("mean_log_loss"), F.avg("rounds").alias("mean_rounds"))
    return mean.withColumn("rank", F.expr("row_number() OVER (ORDER BY mean_log_loss, candidate)"))


def grid_search(folded: DataFrame, features: Sequence[str], regs: Sequence[float], folds: int = 4, target: str = "y") -> DataFrame:
    """Mean fold log loss per regularisation strength over expanding time folds."""
    losses = []
    for reg in regs:
        for k in range(folds):
            model = fit_market_free(folded.where(F.col("fold") < k), features, target, reg=reg)
            p = clip(sigmoid(linear_score(features, model.coefficients, model.intercept)), *MODEL_CLIP)
            test = folded.where(F.col("fold") == k)
            loss = F.avg(log_loss_of(F.col(target).cast("double"), p))
            losses.append(test.agg(loss.alias("log_loss")).select(F.lit(reg).alias("reg"), F.lit(k).alias("fold"), "log_loss"))
    return reduce(DataFrame.unionByName, losses)


def best_parameters(losses: DataFrame) -> DataFrame:
    return losses.groupBy("reg").agg(F.avg("log_loss").alias("mean_log_loss")).orderBy("mean_log_loss", "reg")


def bounded_combination(score: Column, p_mkt: Column | str) -> Column:
    """sigmoid(market logit + ALPHA * MAX_RESIDUAL * tanh(score))."""
    return sigmoid(logit(p_mkt) + ALPHA * MAX_RESIDUAL * F.tanh(score))
