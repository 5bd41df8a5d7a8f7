"""Team form features: win rate, run differential, one-run games, Pythagorean expectation.

All blocks come from one running state per (season, team); the reference of every value is
the team's earlier games, home or away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyline.operators.history import Metric, measure, rolling_rates
from tallyline.operators.metrics import TEAM_HALFLIVES, horizons
from tallyline.operators.priors import prior_columns
from tallyline.operators.sides import collapse_sides

# Exponent and pseudo-games of the Pythagorean expectation.
GAMMA = 1.83
PSEUDO_GAMES = 10
WIN = Metric("win_pct", "is_winner", "gp", 10)
RUNS = Metric("run_diff", "run_diff", "gp", 10, rate=False)
ONE_RUN = Metric("one_run_win_pct", "one_run_win", "one_run_game", 5)
HEAD_TO_HEAD = Metric("h2h_win_pct", "is_winner", "gp", 5)
ORDER = ("game_date", "dh", "game_datetime", "game_id")


def team_log(rows: DataFrame) -> DataFrame:
    """Indicator columns of the team blocks."""
    margin = F.col("team_score") - F.col("opposing_team_score")
    one_run = F.when(F.abs(margin) == 1, 1).otherwise(0)
    return rows.select(
        "*",
        F.lit(1).alias("gp"),
        margin.alias("run_diff"),
        one_run.alias("one_run_game"),
        F.when(F.col("is_winner") == 1, one_run).otherwise(0).alias("one_run_win"),
    )


def team_form(
    rows: DataFrame,
    metrics: Sequence[Metric] = (WIN, RUNS, ONE_RUN),
    halflives: Sequence[int] = TEAM_HALFLIVES,
    entity: Sequence[str] = ("season", "team"),
    season: str = "season",
    pythagorean: bool = True,
    order: Sequence[str] = ORDER,
    keep: Sequence[str] = ("game_id", "game_date", "dh", "game_datetime", "season", "team", "opposing_team", "is_home"),
    **options,
) -> DataFrame:
    """Rolling columns per team row, plus ``team_gp`` (games played before)."""
    log = team_log(rows)
    alpha = [(F.avg("team_score") * PSEUDO_GAMES).alias("__alpha")] if pythagorean else []
    priors = log.groupBy(season).agg(*prior_columns(metrics), *alpha)
    sums, ewms = {}, {}
    if pythagorean:
        rs, ra, one = "team_score", "opposing_team_score", "gp"
        sums = {"__rs": rs, "__ra": ra}
        for h in halflives:
            ewms |= {f"__rs_{h}": (rs, h), f"__ra_{h}": (ra, h), f"__gp_{h}": (one, h)}
    size = options.pop("size", None) or measure(rows, entity)
    with_priors = log.join(F.broadcast(priors), season)  # one row per season
    extra = ["__alpha"] if pythagorean else []
    out = rolling_rates(
        with_priors, entity, order, metrics, halflives, keep=[*keep, *extra], date=None,
        extra_sums=sums, extra_ewms=ewms, size=size, **options,
    )
    if pythagorean:
        out = out.selectExpr("*", *_pythagorean(halflives)).drop(*sums, *ewms, "__alpha")
    return out.withColumnRenamed("seq", "team_gp")


def _pythagorean(halflives) -> list[str]:
    def expectation(scored, allowed, name):
        s, a = (f"pow({x} + __alpha, {GAMMA}D)" for x in (scored, allowed))
        return f"coalesce(try_divide({s}, {s} + {a}), 0.5D) AS pyth_expectation_{name}"

    out = [expectation("__rs", "__ra", "season")]
    for h in halflives:
        rates = (f"try_divide(__{x}_{h}, __gp_{h})" for x in ("rs", "ra"))
        out.append(expectation(*rates, f"ewm_h{h}"))
    return out


def form_columns(halflives=TEAM_HALFLIVES, bases=("win_pct", "pyth_expectation", "run_diff", "one_run_win_pct")) -> list[str]:
    return [f"{b}_{h}" for b in bases for h in horizons(halflives)]


def game_form(form: DataFrame, halflives=TEAM_HALFLIVES, bases=("win_pct", "pyth_expectation", "run_diff", "one_run_win_pct")) -> DataFrame:
    """One row per game with home_/away_ form columns."""
    cols = [*form_columns(halflives, bases), "team_gp"]
    return collapse_sides(form, ["game_id", "game_date", "dh", "game_datetime", "season"], cols)
