"""Weighted means and the tiers of priors a rate is shrunk to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.history import Metric, zero


def _mean_sql(value: str, weight: str, where: str | None = None) -> str:
    v, w = zero(value), zero(weight)
    rows = f" FILTER (WHERE {where})" if where else ""
    total = f"sum({w}){rows}"
    return f"try_divide(sum({v} * {w}){rows}, CASE WHEN {total} > 0 THEN {total} END)"


def weighted_mean(value: str, weight: str) -> Column:
    """Sum v*w / sum w; a NULL value counts as 0 with its weight; NULL when the weight is not > 0."""
    return F.expr(_mean_sql(value, weight))


def prior_columns(metrics: Sequence[Metric], prefix: str = "prior_") -> list[Column]:
    return [F.expr(f"{_mean_sql(m.value, m.weight)} AS {prefix}{m.name}") for m in metrics]


def league_priors(df: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = (), prefix="prior_") -> DataFrame:
    """One row (or one per ``by``) with the weighted mean of every metric."""
    return df.groupBy(*by).agg(*prior_columns(metrics, prefix))


def _floored(m: Metric, floors: Mapping[str, float], name: str, where: str | None = None) -> Column:
    v, w = zero(m.value), zero(m.weight)
    rows = f" FILTER (WHERE {where})" if where else ""
    total = f"sum({w}){rows}"
    keep = f"CASE WHEN {total} >= {floors.get(m.weight, 0)} AND {total} <> 0 THEN {total} END"
    return F.expr(f"try_divide(sum({v} * {w}){rows}, {keep}) AS {name}")


def entity_priors(
    previous: DataFrame, metrics: Sequence[Metric], floors: Mapping[str, float], entity: Sequence[str], prefix: str = "own_"
) -> DataFrame:
    """Previous-season weighted mean per entity, kept where the weight reaches its floor."""
    return previous.groupBy(*entity).agg(*[_floored(m, floors, prefix + m.name) for m in metrics])


def role_priors(
    previous: DataFrame, metrics: Sequence[Metric], floors: Mapping[str, float], entity: Sequence[str], role: str
) -> DataFrame:
    """``own_`` (rows of the role) and ``any_`` (all rows) priors in a single aggregation.

    The role is a filter on the aggregates (SQL text), so both share one scan and exchange.
    """
    return previous.groupBy(*entity).agg(
        *[_floored(m, floors, "own_" + m.name, role) for m in metrics],
        *[_floored(m, floors, "any_" + m.name) for m in metrics],
    )


def role_or_all(
    previous: DataFrame, role: str, metrics: Sequence[Metric], by: Sequence[str] = (), prefix="league_"
) -> DataFrame:
    """League means over the rows of a role; over everybody when the role has no row."""
    return previous.groupBy(*by).agg(
        *[
            F.expr(
                f"CASE WHEN count_if({role}) > 0 THEN {_mean_sql(m.value, m.weight, role)}"
                f" ELSE {_mean_sql(m.value, m.weight)} END AS {prefix}{m.name}"
            )
            for m in metrics
        ]
    )


def resolve_priors(
    df: DataFrame,
    metrics: Sequence[Metric],
    entity: Sequence[str],
    own: DataFrame,
    previous_league: Column,
    current_league: Column,
    own_prefixes: Sequence[str] = ("own_",),
    prefix: str = "prior_",
) -> DataFrame:
    """Own prior -> fallback population -> previous league mean -> current league mean.

    The league means come as one-row structs (``one_row``).
    """
    joined = df.join(own, list(entity), "left").withColumn("__prev", previous_league).withColumn("__cur", current_league)
    own_tiers = lambda m: ", ".join(p + m.name for p in own_prefixes)
    return joined.selectExpr(
        *df.columns,
        *[
            f"coalesce({own_tiers(m)}, __prev.league_{m.name}, __cur.league_{m.name}) AS {prefix}{m.name}"
            for m in metrics
        ],
    )


def season_league(log: DataFrame, population: DataFrame, metrics: Sequence[Metric], role: str = "true") -> DataFrame:
    """One row per season of ``log``: the league mean of the season before (role rows of
    ``population``), else of the season itself."""
    names = [m.name for m in metrics]
    before = role_or_all(population, role, metrics, ["season"], "prev_").withColumn("season", F.col("season") + 1)
    now = league_priors(log, metrics, ["season"], "now_")
    return now.join(before, "season", "left").selectExpr(
        "season", *[f"coalesce(prev_{n}, now_{n}) AS league_{n}" for n in names]
    )


def with_season_priors(
    log: DataFrame,
    population: DataFrame,
    metrics: Sequence[Metric],
    floors: Mapping[str, float],
    entity: str = "player_id",
    role: str = "true",
) -> DataFrame:
    """``prior_{m}`` for several seasons at once: every season looks at the one before it.

    Own rate in the role -> own rate in any role -> league. The join on (entity, season) has
    one row per player and season on the right; the league table one row per season.
    """
    own = role_priors(population, metrics, floors, [entity, "season"], role).withColumn("season", F.col("season") + 1)
    league = F.broadcast(season_league(log, population, metrics, role))
    joined = log.join(own, [entity, "season"], "left").join(league, "season")
    return joined.selectExpr(
        *log.columns, *[f"coalesce(own_{m.name}, any_{m.name}, league_{m.name}) AS prior_{m.name}" for m in metrics]
    )
