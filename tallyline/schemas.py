"""Table schemas and their primary keys (column order and types are fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    out = T.StructType()
    for part in text.split(","):
        name, kind, *rest = part.split()
        out = out.add(name, _TYPES[kind], nullable="!" not in rest)
    return out


_TYPES = {
    "str": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "dbl": T.DoubleType(),
    "date": T.DateType(), "ts": T.TimestampNTZType(),
}

SCHEMAS: dict[str, T.StructType] = {
    "schedule": _schema(
        "game_id str !, game_date date !, game_datetime ts, day_night_game str, season int, away_team str,"
        "home_team str, dh int, venue_name str, venue_id int, venue_elevation int, venue_timezone str,"
        "venue_gametime_offset int, status str, away_probable_pitcher str, home_probable_pitcher str,"
        "away_starter_normalized str, home_starter_normalized str, away_pitcher_id long, home_pitcher_id long,"
        "wind str, condition str, temp int, away_score int, home_score int, winning_team str, losing_team str,"
        "scraped_at str"
    ),
    "odds": _schema(
        "game_date date !, game_datetime ts, away_team str !, home_team str !, away_starter str, home_starter str,"
        "away_starter_normalized str, home_starter_normalized str, away_score int, home_score int, winner str,"
        "sportsbook str !, away_opening_odds dbl, home_opening_odds dbl, away_current_odds dbl,"
        "home_current_odds dbl, season int"
    ),
    "players": _schema(
        "player_id long !, mlb_id long, name str, normalized_player_name str, pos str, current_team str,"
        "last_updated str"
    ),
    "batting_stats": _schema(
        "player_id long !, mlb_id long, name str, normalized_player_name str, game_date date !, team str,"
        "batorder str, pos str, dh int !, ab int, pa int, bip int, ops dbl, babip dbl, k_percent dbl,"
        "bb_percent dbl, bb_k dbl, wrc_plus dbl, woba dbl, barrel_percent dbl, hard_hit dbl, ev dbl, iso dbl,"
        "gb_fb dbl, baserunning dbl, wraa dbl, wpa dbl, season int, scraped_at str"
    ),
    "pitching_stats": _schema(
        "player_id long !, mlb_id long, name str, normalized_player_name str, game_date date !, team str, dh int !,"
        "games int, gs int, era dbl, babip dbl, ip dbl, tbf int, bip int, runs int, k_percent dbl, bb_percent dbl,"
        "barrel_percent dbl, hard_hit dbl, ev dbl, hr_fb dbl, siera dbl, fip dbl, stuff dbl, iffb int, wpa dbl,"
        "gmli dbl, fa_percent dbl, fc_percent dbl, si_percent dbl, fa_velo dbl, fc_velo dbl, si_velo dbl,"
        "season int, scraped_at str"
    ),
    "lineups": _schema(
        "game_date date !, team_id int, team str !, dh int !, opposing_team_id int, opposing_team str,"
        "team_starter_id long, opposing_starter_id long, season int, scraped_at str"
    ),
    "lineup_players": _schema(
        "game_date date !, team_id int, team str !, opposing_team_id int, opposing_team str, dh int !,"
        "player_id long !, position str, batting_order int, season int, scraped_at str"
    ),
    "fielding": _schema(
        "name str !, normalized_player_name str, player_id long, season int !, month int !, frv dbl,"
        "total_innings dbl, innings_C dbl, innings_1B dbl, innings_2B dbl, innings_3B dbl, innings_SS dbl,"
        "innings_LF dbl, innings_CF dbl, innings_RF dbl"
    ),
    "rosters": _schema(
        "game_date date !, season int, team str !, player_name str !, normalized_player_name str, player_id long,"
        "position str, status str, scraped_at str"
    ),
    "park_factors": _schema("venue_id int !, venue_name str, season int !, park_factor int, scraped_at str"),
}

KEYS: dict[str, tuple[str, ...]] = {
    "schedule": ("game_id",),
    "odds": ("game_date", "away_team", "home_team", "sportsbook"),
    "players": ("player_id",),
    "batting_stats": ("player_id", "game_date", "dh"),
    "pitching_stats": ("player_id", "game_date", "dh"),
    "lineups": ("game_date", "team", "dh"),
    "lineup_players": ("game_date", "team", "dh", "player_id"),
    "fielding": ("name", "month", "season"),
    "rosters": ("game_date", "player_name", "team"),
    "park_factors": ("venue_id", "season"),
}
