"""The event log as a small league in the stored-table layout, and the whole feature build on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.plans.features import FeatureConfig, model_splits, season_features, structured_features
from tallyline.plans.registry import query, tidy
from tallyline.session import pin


def club_tables(v) -> dict[str, DataFrame]:
    log = v.player_game
    scores = log.groupBy("game_date", "dh", "team").agg(F.sum("pa").alias("score"))
    side = lambda s: scores.select("game_date", "dh", F.col("team").alias(f"{s}_team"), F.col("score").alias(f"{s}_score"))
    games = (
        v.club_games.join(side("home"), ["game_date", "dh", "home_team"], "left")
        .join(side("away"), ["game_date", "dh", "away_team"], "left")
        .na.fill(0, ["home_score", "away_score"])
    )
    schedule = games.selectExpr(
        "game_id", "game_date", "cast(game_date as timestamp_ntz) + dh * INTERVAL '6' HOUR AS game_datetime",
        "if(dh = 1, 'day', 'night') AS day_night_game", "if(day(game_date) <= 15, 1, 2) AS season", "away_team", "home_team", "dh",
        "home_team AS venue_id", "home_team * 10 AS venue_elevation", "60 + dh AS temp",
        "if(dh = 1, 'Sunny', 'Clear') AS condition", "'7 mph, Out To CF' AS wind", "away_score", "home_score",
        "if(home_score >= away_score, home_team, away_team) AS winning_team",
        "if(home_score >= away_score, away_team, home_team) AS losing_team",
    )
    books = log.selectExpr("game_date", "dh", "team - team % 2 AS home_team", "player_id AS sportsbook", "k_percent", "pa")
    odds = schedule.join(books, ["game_date", "dh", "home_team"]).selectExpr(
        "game_date", "game_datetime", "away_team", "home_team", "sportsbook", "season",
        "if(pa % 2 = 0, 105 + pa, -110 - pa) AS away_opening_odds", "if(pa % 2 = 0, -120 - pa, 102 + pa) AS home_opening_odds",
    )
    seasoned = lambda df: df.withColumn("season", F.expr("if(day(game_date) <= 15, 1, 2)"))
    fielding = v.events.groupBy((F.col("user_id") + 1000).alias("player_id"), F.expr("if(day(ts) <= 15, 1, 2)").alias("season")).agg(
        F.month(F.max("ts")).alias("month"), F.count(F.lit(1)).cast("double").alias("frv"),
        F.expr("cast(count_if(event_type = 'view') as double)").alias("total_innings"),
    )
    log = log.withColumn("season", F.col("season").cast("int"))
    derived = {
        "schedule": schedule,
        "odds": odds,
        "batting_stats": log,
        "pitching_stats": log.where("pos = 'P'").drop("k_bb_percent", "wpa_li", "apps"),
        "lineups": seasoned(v.matchups),
        "lineup_players": seasoned(v.lineups),
        "fielding": fielding,
        "rosters": seasoned(v.rosters.selectExpr("game_date", "team", "player_id + 1000 AS player_id", "'P' AS position")),
        "park_factors": v.parks.selectExpr("cast(venue_id as int) AS venue_id", "park_factor", "explode(array(1, 2)) AS season"),
    }
    return {name: pin(df, name) for name, df in derived.items()}  # stored tables, as in real use


def built(v) -> tuple[dict[str, DataFrame], DataFrame]:
    tables = club_tables(v)
    features, _ = season_features(tables)
    return tables, pin(features, "wide")


@query("s1_wide_features")
def wide(v):
    """Every block of the feature table for all seasons (the blocks have oracles of their own)."""
    return tidy(built(v)[1].drop("game_datetime"))


@query("s2_model_splits")
def splits(v):
    """Wide table -> splits with flipped training copies, typed and scaled."""
    return tidy(model_splits(built(v)[1], FeatureConfig(perspective_duplication=True)).drop("game_datetime"))


@query("s3_structured_vectors")
def vectors(v):
    """Slot and starter vectors aligned to the wide rows."""
    tables, features = built(v)
    return tidy(structured_features(features, tables, FeatureConfig()).drop("game_datetime"))
