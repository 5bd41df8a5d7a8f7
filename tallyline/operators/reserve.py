"""Reserve groups (bullpens): roles, exclusion, group means, rest and availability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.numeric import as_col, ratio


def classify_appearances(matchups: DataFrame, log: DataFrame, on=("game_date", "team", "dh")) -> DataFrame:
    """Pitching rows of scheduled match-ups, flagged by whether the pitcher started."""
    starters = matchups.select(*on, "opposing_team", "team_starter_id")
    return starters.join(log, list(on)).withColumn(
        "is_starter", F.coalesce(F.col("player_id") == F.col("team_starter_id"), F.lit(False))
    )


def opener_flags(rows: DataFrame, entity: Sequence[str] = ("player_id",), limit: float = 0.25) -> DataFrame:
    """Starts / games below the limit; unknown or zero games -> not an opener."""
    share = F.try_divide(F.sum("gs").cast("double"), F.sum("games").cast("double"))
    return rows.groupBy(*entity).agg(F.coalesce(share < limit, F.lit(False)).alias("is_opener_flag"))


def classify_openers(rows: DataFrame, entity: Sequence[str] = ("player_id",)) -> DataFrame:
    flags = opener_flags(rows, entity)
    return rows.join(flags, list(entity), "left").select(
        *rows.columns,
        (F.col("is_starter") & F.coalesce("is_opener_flag", F.lit(False))).alias("is_opener"),
    )


def exclude_starter(roster: DataFrame, player="player_id", starter="team_starter_id") -> DataFrame:
    """The roster without that day's starter; an unknown starter excludes nobody."""
    return roster.where(F.coalesce(F.col(player) != F.col(starter), F.lit(True)))


def group_means(rows: DataFrame, keys: Sequence[str], values: Sequence[str], prefix: str = "team_pen_") -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(v).alias(prefix + v) for v in values])


def availability(
    rows: DataFrame, keys: Sequence[str], leverage: str | None, date="game_date", last="last_app_date", prefix: str = "team_pen_"
) -> DataFrame:
    """Rest, freshness and leverage-weighted availability of a group.

    Normalised weights are written as sum(w*x)/sum(w), so the group needs one combined
    aggregate and no window; without any leverage the plain mean stands in.
    """
    rest = F.coalesce(F.date_diff(date, last), F.lit(4)).cast("double")
    fresh = F.greatest(F.least(rest, F.lit(3.0)), F.lit(0.0)) / 3.0
    ready = F.when(rest >= 1, 1.0).otherwise(0.0)
    w = F.greatest(F.coalesce(F.col(leverage), F.lit(0.0)), F.lit(0.0)) if leverage else F.lit(1.0)

    def weighted(x):
        return F.coalesce(ratio(F.sum(w * x), F.sum(w)), F.avg(x))

    return rows.groupBy(*keys).agg(
        F.avg(rest).alias(f"{prefix}rest_days_mean"),
        F.median(rest).alias(f"{prefix}rest_days_median"),
        F.avg(fresh).alias(f"{prefix}freshness_mean"),
        weighted(fresh).alias(f"{prefix}freshness_gmliw"),
        weighted(ready).alias(f"{prefix}hi_lev_available"),
    )


def fill_with_priors(df: DataFrame, priors: Mapping[str, str], marker: str = "pen_") -> DataFrame:
    """NULLs of every column whose name contains ``pen_{metric}`` take that metric's prior
    (SQL text: a column or a number)."""

    def filled(c):
        used = [p for m, p in priors.items() if f"{marker}{m}" in c]
        return f"coalesce({c}, {', '.join(used)}) AS {c}" if used else c

    return df.selectExpr(*[filled(c) for c in df.columns])


def velocity_columns() -> tuple[str, str]:
    """Usage-weighted velocity total and usage of three pitch types (SQL text)."""
    use = {k: f"coalesce(try_cast({k}_percent as double), 0D)" for k in ("fa", "fc", "si")}
    return " + ".join(f"{k}_velo * {u}" for k, u in use.items()), " + ".join(use.values())


def velocity_trend(state: DataFrame, average: Column, default: float = 91.0) -> DataFrame:
    """Season, short and long velocity and their difference from running-state columns."""
    mean = F.coalesce(average, F.lit(default))
    season = ratio(F.col("__velo"), F.col("__usage"))
    short = ratio(F.col("__velo_2"), F.col("__usage_2"))
    long = ratio(F.col("__velo_6"), F.col("__usage_6"))
    helper = [c for c in state.columns if c.startswith(("__velo", "__usage"))]
    return state.select(
        *[c for c in state.columns if c not in helper],
        F.coalesce(season, mean).alias("velo_season"),
        F.coalesce(short, mean).alias("velo_short"),
        F.coalesce(long, mean).alias("velo_long"),
        F.coalesce(short - long, F.lit(0.0)).alias("velo_diff"),
    )
