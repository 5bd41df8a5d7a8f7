"""From stored tables to model-ready splits: all seasons in one plan.

``tables`` maps the names of ``tallyline.schemas.SCHEMAS`` to DataFrames. Blocks are built
once per game key and joined on it; the season is part of every history key, so no season
loop is needed and a season only knows the one before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, functions as F

from tallyline.functions import context
from tallyline.functions.market import MARKET_PROBABILITY, add_market_probabilities
from tallyline.operators import asof, league, lineups, metrics, prepare, quotes, reserve, sides, teams
from tallyline.operators.history import rolling_rates
from tallyline.operators.metrics import horizons
from tallyline.operators.priors import season_league, with_season_priors
from tallyline.operators.selection import group_medians
from tallyline.session import bucketed, pin
from tallyline.sources.sinks import cache_key, cached

KEY = list(sides.GAME_KEY)
# Blocks are written to the shared folder and read back: each is used more than once, and a
# lost executor then costs a re-read instead of the whole history.
Store = Callable[[DataFrame, str], DataFrame]
PLAYER_ORDER = ("game_date", "dh")
STARTER_WHERE, RELIEVER_WHERE = "gs > 0", "coalesce(gs, 0) = 0"


@dataclass(frozen=True)
class FeatureConfig:
    stage: str = "finetune"  # or "pretrain": without market information
    market_only: bool = False
    perspective_duplication: bool = False
    structured: bool = False
    scale: bool = True
    batter: tuple[int, ...] = metrics.BATTER_HALFLIVES
    starter: tuple[int, ...] = metrics.STARTER_HALFLIVES
    reliever: tuple[int, ...] = metrics.RELIEVER_HALFLIVES
    team: tuple[int, ...] = metrics.TEAM_HALFLIVES

    def key(self, **more) -> str:
        return cache_key(**asdict(self), **more)


def clean_schedule(schedule: DataFrame) -> DataFrame:
    """Completed games that were not moved by more than two days, with the label."""
    return schedule.where(
        "game_datetime <= cast(game_date as timestamp_ntz) + INTERVAL '2' DAY AND winning_team IS NOT NULL"
    ).withColumn("is_winner_home", F.expr("cast(winning_team = home_team as int)"))


def batting_features(tables: Mapping[str, DataFrame], config: FeatureConfig) -> DataFrame:
    """Rolling batting block of position players plus the month's fielding rate."""
    log = tables["batting_stats"].where(context.is_position_player("pos", "player_id"))
    log = with_season_priors(log, log, metrics.BATTING, metrics.BATTING_FLOORS)
    rolled = rolling_rates(
        log, ["player_id", "season"], PLAYER_ORDER, metrics.BATTING, config.batter,
        keep=["player_id", "mlb_id", "pos", "team", "game_date", "dh", "season"],
    )
    fielding = tables["fielding"].selectExpr(
        "player_id AS mlb_id", "season", "month", "try_divide(frv, total_innings) * 9 AS frv_per_9"
    )
    joined = rolled.withColumn("month", context.season_month("game_date")).join(fielding, ["mlb_id", "season", "month"], "left")
    return joined.selectExpr(*rolled.columns, "coalesce(frv_per_9, 0D) AS frv_per_9").drop("seq")


def batting_columns(config: FeatureConfig) -> list[str]:
    return [f"{m.name}_{h}" for m in metrics.BATTING for h in horizons(config.batter)] + ["frv_per_9"]


def position_block(schedule: DataFrame, tables, batting: DataFrame, config: FeatureConfig) -> DataFrame:
    """Line-up means of both sides per game, missing players at the season's median."""
    cols = batting_columns(config)
    listed = tables["lineup_players"].where(context.is_position_player("position", "player_id")).select(
        "game_date", "dh", "team", "opposing_team", "player_id", "batting_order"
    )
    rows = lineups.lineup_players(schedule, listed, batting, cols, keep=["season"])
    return lineups.side_means(rows, cols, group_medians(batting, cols, "season", stored=True))


def pitching_log(tables, matchups: DataFrame) -> DataFrame:
    """Appearances of scheduled match-ups with role flags and derived metrics."""
    log = tables["pitching_stats"].selectExpr(
        "*", "k_percent - bb_percent AS k_bb_percent", "try_divide(wpa, gmli) AS wpa_li", "1 AS apps"
    )
    rows = reserve.classify_appearances(matchups.drop("season"), log)
    return reserve.classify_openers(rows, ["player_id", "season"])


def pitching_block(tables, config: FeatureConfig, store: Store = pin) -> DataFrame:
    """One row per match-up: own and opposing starter, bullpen rest and bullpen rates."""
    matchups = asof.mirror_fill(
        tables["lineups"].select("game_date", "dh", "season", "team", "opposing_team", "team_starter_id", "opposing_starter_id")
    )
    matchups = store(matchups, "matchups")
    log = store(pitching_log(tables, matchups), "pitching-log")
    population = tables["pitching_stats"].selectExpr(
        "*", "k_percent - bb_percent AS k_bb_percent", "try_divide(wpa, gmli) AS wpa_li", "1 AS apps"
    )
    keep = ["player_id", "mlb_id", "team", "game_date", "dh", "season", "is_opener"]

    starts = with_season_priors(log.where("is_starter"), population, metrics.STARTER, metrics.PITCHING_FLOORS, role=STARTER_WHERE)
    total, usage = reserve.velocity_columns()
    starts = rolling_rates(
        starts, ["player_id", "season"], PLAYER_ORDER, metrics.STARTER, config.starter,
        keep=[*keep, "fa_velo", "fc_velo", "si_velo", "fa_percent", "fc_percent", "si_percent"],
        extra_sums={"__velo": total, "__usage": usage},
        extra_ewms={f"__{n}_{h}": (c, h) for n, c in (("velo", total), ("usage", usage)) for h in (2, 6)},
    )
    speed = F.expr(f"try_divide({total}, {usage})")
    # one row per season
    mean = log.where("is_starter").groupBy("season").agg(F.avg(F.when(speed > 0, speed)).alias("__velo_mean"))
    starts = starts.join(F.broadcast(mean), "season", "left")
    starts = store(reserve.velocity_trend(starts, F.col("__velo_mean")), "starters")
    starter_cols = [f"{m.name}_{h}" for m in metrics.STARTER for h in horizons(config.starter)]
    starter_cols += ["velo_season", "velo_short", "velo_long", "velo_diff", "is_opener"]

    own = starts.selectExpr("game_date", "dh", "player_id AS team_starter_id", *[f"{c} AS team_starter_{c}" for c in starter_cols])
    pairs = matchups.join(own, ["game_date", "dh", "team_starter_id"], "left")

    relief = log.where("NOT is_starter")
    relief = with_season_priors(relief, population, metrics.RELIEVER, metrics.PITCHING_FLOORS, role=RELIEVER_WHERE)
    pen_priors = season_league(log.where("NOT is_starter"), population, metrics.RELIEVER, RELIEVER_WHERE)
    relief = rolling_rates(relief, ["player_id", "season"], PLAYER_ORDER, metrics.RELIEVER, config.reliever, keep=keep)
    relief = store(relief, "relievers")
    pen_cols = [f"{m.name}_{h}" for m in metrics.RELIEVER for h in horizons(config.reliever)]

    bullpen = bullpen_members(tables, matchups)
    stats = relief.select(F.col("mlb_id").alias("player_id"), "season", "game_date", F.col("dh").alias("__dh"), "last_app_date", *pen_cols)
    known = asof.asof_before(bullpen, stats, ["player_id", "season"], "game_date", ["last_app_date", *pen_cols], ["__dh"])
    known = store(known, "bullpen")
    leverage = "gmli_ewm_h8" if 8 in config.reliever else None
    group = ["game_date", "team"]
    usage_rows = reserve.availability(known, group, leverage)
    means = reserve.group_means(known, group, pen_cols)
    out = pairs.join(usage_rows, group, "left").join(means, group, "left")
    out = out.join(F.broadcast(pen_priors), "season", "left")
    priors = {m.name: f"league_{m.name}" for m in metrics.RELIEVER}
    out = reserve.fill_with_priors(out, priors, "team_pen_")
    return out.drop(*[f"league_{m.name}" for m in metrics.RELIEVER], "season", "team_starter_id", "opposing_starter_id")


def bullpen_members(tables, matchups: DataFrame) -> DataFrame:
    """Rostered pitchers without that day's starter; holes take the latest earlier roster.

    Rosters carry other player ids than match-ups, so the starter is translated first.
    """
    ids = tables["pitching_stats"].groupBy(F.col("player_id").alias("team_starter_id")).agg(F.max("mlb_id").alias("starter_mlb_id"))
    starters = matchups.select("game_date", "team", "season", "team_starter_id").distinct().join(ids, "team_starter_id", "left")
    starters = starters.groupBy("game_date", "team", "season").agg(F.collect_set("starter_mlb_id").alias("starter_ids"))
    pitchers = tables["rosters"].where("position IN ('P', 'TWP')").select("game_date", "team", "season", "player_id").distinct()
    listed = pitchers.join(starters, ["game_date", "team", "season"])
    # the first day of a season has no earlier roster
    filled = asof.forward_fill_groups(pitchers, starters, ["team", "season"], "game_date", ["starter_ids"])
    return listed.unionByName(filled).where("NOT coalesce(array_contains(starter_ids, player_id), false)").drop("starter_ids")


def context_block(schedule: DataFrame, parks: DataFrame) -> DataFrame:
    parks = parks.select("venue_id", F.col("season").cast("int").alias("season"), F.col("park_factor").alias("__park"))
    return schedule.join(parks, ["venue_id", "season"], "left").select(
        *KEY,
        F.coalesce("__park", F.lit(100)).alias("park_factor"),
        "venue_elevation",
        F.col("temp"),
        *context.one_hot(F.coalesce("condition", F.lit("Unknown")), context.CONDITIONS, "condition"),
        *context.one_hot(context.wind_direction("wind"), context.WIND_DIRECTIONS, "wind_direction"),
        context.wind_magnitude("wind").alias("wind_magnitude"),
        context.is_day_game("day_night_game").alias("day_night_game"),
    )


def team_block(schedule: DataFrame, config: FeatureConfig) -> DataFrame:
    form = teams.team_form(sides.team_rows(schedule), halflives=config.team)
    return teams.game_form(form, config.team).drop("game_datetime", "season")


def league_delta_tables(tables, dates: DataFrame):
    """As-of league averages per season and date for batters, starters and relievers."""
    batters = tables["batting_stats"].where(context.is_position_player("pos", "player_id"))
    pitchers = tables["pitching_stats"].selectExpr("*", "k_percent - bb_percent AS k_bb_percent")
    make = lambda rows, stats: league.league_averages(rows, stats, dates, season=["season"])
    return (
        make(batters, metrics.BATTING_LEAGUE),
        make(pitchers.where(STARTER_WHERE), metrics.PITCHING_LEAGUE),
        make(pitchers.where(f"NOT ({STARTER_WHERE}) OR gs IS NULL"), metrics.PITCHING_LEAGUE),
    )


def join_blocks(base: DataFrame, blocks) -> DataFrame:
    """One row per game with the columns of all blocks (C17): stored in buckets of the key, they meet without an exchange."""
    for block in blocks:
        base = base.join(block, KEY, "left")
    return base


def season_features(
    tables: Mapping[str, DataFrame], config: FeatureConfig = FeatureConfig(), store: Store = pin
) -> tuple[DataFrame, DataFrame | None]:
    """(one wide row per game, long quote table or None)."""
    schedule, long_quotes = clean_schedule(tables["schedule"]), None
    if config.stage == "finetune":
        q = add_market_probabilities(tables["odds"].drop("season").withColumn("quote_id", F.col("sportsbook")))
        schedule, long_quotes = quotes.reconcile(schedule, q, config.market_only, store)
        schedule = prepare.drop_market_extras(schedule, config.market_only)
    # blocks with the game key are stored in buckets of it, so the wide join moves none of them again
    by_game = bucketed(KEY) if store is pin else store
    schedule = by_game(schedule, "schedule")
    batting = store(batting_features(tables, config), "batting")
    players = by_game(position_block(schedule, tables, batting, config), "players")
    pitching = store(pitching_block(tables, config, store), "pitching")
    pen_and_starter = [c for c in pitching.columns if c.startswith(("team_starter_", "team_pen_"))]
    pitchers = by_game(sides.attach_both_sides(schedule.select(*KEY), pitching, pen_and_starter), "pitchers")
    env, form = by_game(context_block(schedule, tables["park_factors"]), "environment"), by_game(team_block(schedule, config), "teams")
    wide = join_blocks(schedule.drop("venue_elevation", "temp", "condition", "wind", "day_night_game"), (players, pitchers, env, form))
    bat, sta, rel = league_delta_tables(tables, schedule.select("season", "game_date"))
    on = ("season", "game_date")
    wide = league.apply_league_deltas(wide, bat, metrics.BATTING_LEAGUE, on=on)
    wide = league.apply_league_deltas(wide, sta, metrics.PITCHING_LEAGUE, "starter_", on=on)
    wide = league.apply_league_deltas(wide, rel, metrics.PITCHING_LEAGUE, "pen_", on=on)
    diffs = sides.matchup_diffs(wide.columns, config.batter, config.starter, config.reliever, config.team)
    return wide.selectExpr("*", *diffs), long_quotes


def structured_features(wide: DataFrame, tables, config: FeatureConfig) -> DataFrame:
    """Fixed batting slots (relative to the league) and starter vectors per game."""
    cols = batting_columns(config)
    batting = batting_features(tables, config)
    dates = tables["batting_stats"].select("season", "game_date")
    batters = tables["batting_stats"].where(context.is_position_player("pos", "player_id"))
    avg = league.league_averages(batters, metrics.BATTING_LEAGUE, dates, season=["season"])
    batting = league.apply_league_deltas(batting, avg, metrics.BATTING_LEAGUE, sides=("",), on=("season", "game_date"))
    rows = lineups.lineup_players(wide, tables["lineup_players"].where("batting_order BETWEEN 1 AND 9").select(
        "game_date", "dh", "team", "opposing_team", "player_id", "batting_order"), batting, cols)
    slots = lineups.slot_vectors(rows, cols)
    vectors = slots.join(lineups.starter_vectors(wide), KEY, "left")
    return wide.select(*sides.CANONICAL_KEY).join(vectors, KEY, "left")


def model_splits(wide: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One table with a ``split`` column: cut by season, flipped copies for training, rows with
    any NULL dropped, typed and scaled by the training rows."""
    keys = [c for c in sides.CANONICAL_KEY]
    df = prepare.feature_columns(wide).drop("scraped_at")
    df = prepare.season_split(df)
    halves = dict(batter=config.batter, starter=config.starter, reliever=config.reliever, team=config.team)
    if config.perspective_duplication:
        train = sides.duplicate_perspective(df.where("split = 'train'"), market=MARKET_PROBABILITY, **halves)
        rest = sides.recompute_diffs(df.where("split <> 'train'").withColumn("focal_is_home", F.lit(True)), **halves)
        df = train.unionByName(rest)
    else:
        df = df.withColumn("focal_is_home", F.lit(True))
    df = df.na.drop("any")
    if config.structured:
        df = df.drop(*[c for c in df.columns if c not in keys and prepare.duplicated_by_vectors(c)])
    fixed = [*keys, "split", "is_winner_home"]
    numeric = [c for c, t in df.dtypes if t in prepare.NUMERIC_TYPES and c not in (*fixed, MARKET_PROBABILITY)]
    df = prepare.typed_partition(df, fixed)
    if config.scale:
        df = prepare.standardize(df, numeric, "split = 'train'")
    return df


def cached_features(spark, root: str, tables, config: FeatureConfig, seasons, force: bool = False) -> DataFrame:
    """The wide table from the cache, keyed by every parameter."""
    return cached(spark, root, config.key(kind="wide", seasons=sorted(seasons)), lambda: season_features(tables, config)[0], force)
