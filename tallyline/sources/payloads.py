"""Flattening of raw payloads into table rows. Bad records go to a rejects DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.functions.aliases import QUOTE_ALIASES, TEAM_ALIASES
from tallyline.functions.context import doubleheader_code, winner_by_flags, winner_by_score
from tallyline.functions.text import canonical, normalize_name, parse_timestamp, reverse_comma_name

# Payload shapes (fixed values: the field names of the sources).
TEAM_SIDE = "struct<team: struct<name: string>, score: int, isWinner: boolean, probablePitcher: struct<id: bigint, fullName: string>>"
SCHEDULE_PAYLOAD = f"""struct<dates: array<struct<games: array<struct<
    gamePk: bigint, gameType: string, officialDate: string, gameDate: string, dayNight: string,
    doubleHeader: string, gameNumber: int, status: struct<detailedState: string>,
    teams: struct<away: {TEAM_SIDE}, home: {TEAM_SIDE}>,
    weather: struct<condition: string, temp: string, wind: string>,
    venue: struct<id: int, name: string, location: struct<elevation: int>,
                  timeZone: struct<tz: string, offsetAtGameTime: int>>>>>>>"""
ROSTER_PAYLOAD = """struct<roster: array<struct<person: struct<id: bigint, fullName: string>,
    position: struct<abbreviation: string>, status: struct<description: string>>>>"""
STARTER = "struct<firstName: string, lastName: string>"
LINE = "struct<awayOdds: double, homeOdds: double>"
QUOTE_PAYLOAD = f"""struct<gameRows: array<struct<gameView: struct<gameId: bigint, startDate: string,
    awayTeam: struct<shortName: string>, homeTeam: struct<shortName: string>, awayStarter: {STARTER},
    homeStarter: {STARTER}, awayTeamScore: int, homeTeamScore: int>,
    oddsViews: array<struct<sportsbook: string, openingLine: {LINE}, currentLine: {LINE}>>>>>"""
LINEUP_PAYLOAD = """array<struct<gameInfo: array<struct<Team: string, oppTeam: string, teamid: int, oppteamid: int,
    gameDate: string, dh: int, oppSP: bigint>>, lineupInfo: array<struct<playerId: bigint, position: string,
    GS: int, BatOrder: int>>>>"""
BATTER_FIELDS = {
    "bip": ("bipCount", 0.0), "ops": ("OPS", 0.0), "babip": ("BABIP", 0.0), "k_percent": ("K%", 0.0),
    "bb_percent": ("BB%", 0.0), "bb_k": ("BB/K", 0.0), "wrc_plus": ("wRC+", 100.0), "woba": ("wOBA", 0.0),
    "barrel_percent": ("Barrel%", 0.0), "hard_hit": ("HardHit%", 0.0), "ev": ("EV", 0.0), "iso": ("ISO", 0.0),
    "gb_fb": ("GB/FB", 0.0), "baserunning": ("wBSR", 0.0), "wraa": ("wRAA", 0.0), "wpa": ("WPA", 0.0),
}
PITCHER_FIELDS = {
    "ip": ("IP", 0.0), "tbf": ("TBF", 0.0), "bip": ("bipCount", 0.0), "runs": ("R", 0.0), "era": ("ERA", 0.0),
    "babip": ("BABIP", 0.0), "k_percent": ("K%", 0.0), "bb_percent": ("BB%", 0.0),
    "barrel_percent": ("Barrel%", 0.0), "hard_hit": ("HardHit%", 0.0), "ev": ("EV", 0.0), "hr_fb": ("HR/FB", 0.0),
    "siera": ("SIERA", 0.0), "fip": ("FIP", 0.0), "stuff": ("sp_stuff", 100.0), "iffb": ("IFFB", 0.0),
    "wpa": ("WPA", 0.0), "gmli": ("gmLI", 0.0), "fa_percent": ("pfxFA%", 0.0), "fc_percent": ("pfxFC%", 0.0),
    "si_percent": ("pfxSI%", 0.0), "fa_velo": ("pivFA", 0.0), "fc_velo": ("pivFC", 0.0), "si_velo": ("pivSI", 0.0),
}
FIELDING_OUTS = {
    "total_innings": "outs_total", "innings_C": "outs_2", "innings_1B": "outs_3", "innings_2B": "outs_4",
    "innings_3B": "outs_5", "innings_SS": "outs_6", "innings_LF": "outs_7", "innings_CF": "outs_8",
    "innings_RF": "outs_9",
}
LEAGUE_FIELDS = {
    "Bats": {
        "ops": "OPS", "babip": "BABIP", "bb_k": "BB/K", "woba": "wOBA", "barrel_percent": "Barrel%",
        "hard_hit": "HardHit%", "ev": "EV", "iso": "ISO", "gb_fb": "GB/FB",
    },
    "Throws": {
        "era": "ERA", "babip": "BABIP", "k_percent": "K%", "bb_percent": "BB%", "barrel_percent": "Barrel%",
        "hard_hit": "HardHit%", "siera": "SIERA", "fip": "FIP", "ev": "EV", "hr_fb": "HR/FB", "gmli": "gmLI",
    },
}
ALL_STAR = "American League All-Stars"


def flatten_schedule(raw: DataFrame, payload: str = "payload", season: str = "season", aliases=TEAM_ALIASES) -> tuple[DataFrame, DataFrame]:
    """(games, rejects): regular-season games that were played; a game without exactly one
    winner, with an unknown team or with an odd double-header code is a reject."""
    games = (
        raw.select(season, F.from_json(payload, SCHEDULE_PAYLOAD).alias("p"))
        .select(season, F.explode("p.dates").alias("d"))
        .select(season, F.explode("d.games").alias("g"))
        .where((F.col("g.gameType") == "R") & ~F.col("g.status.detailedState").isin("Cancelled", "Postponed"))
        .where((F.col("g.teams.away.team.name") != ALL_STAR) & (F.col("g.teams.home.team.name") != ALL_STAR))
    )
    away, home = (canonical(f"g.teams.{s}.team.name", aliases, default_to_input=False) for s in ("away", "home"))
    won = [F.col(f"g.teams.{s}.isWinner") for s in ("away", "home")]
    rows = games.withColumns({"away_team": away, "home_team": home}).select(
        F.col("g.gamePk").cast("string").alias("game_id"),
        F.col("g.officialDate").try_cast("date").alias("game_date"),
        parse_timestamp("g.gameDate").alias("game_datetime"),
        F.col("g.dayNight").alias("day_night_game"),
        F.col(season).cast("int").alias("season"),
        "away_team", "home_team",
        doubleheader_code("g.doubleHeader", "g.gameNumber").alias("dh"),
        F.col("g.venue.name").alias("venue_name"),
        F.col("g.venue.id").alias("venue_id"),
        F.coalesce("g.venue.location.elevation", F.lit(0)).alias("venue_elevation"),
        F.col("g.venue.timeZone.tz").alias("venue_timezone"),
        F.col("g.venue.timeZone.offsetAtGameTime").alias("venue_gametime_offset"),
        F.col("g.status.detailedState").alias("status"),
        F.col("g.teams.away.probablePitcher.fullName").alias("away_probable_pitcher"),
        F.col("g.teams.home.probablePitcher.fullName").alias("home_probable_pitcher"),
        normalize_name("g.teams.away.probablePitcher.fullName").alias("away_starter_normalized"),
        normalize_name("g.teams.home.probablePitcher.fullName").alias("home_starter_normalized"),
        F.col("g.teams.away.probablePitcher.id").alias("away_pitcher_id"),
        F.col("g.teams.home.probablePitcher.id").alias("home_pitcher_id"),
        F.col("g.weather.wind").alias("wind"),
        F.col("g.weather.condition").alias("condition"),
        F.col("g.weather.temp").try_cast("int").alias("temp"),
        F.col("g.teams.away.score").alias("away_score"),
        F.col("g.teams.home.score").alias("home_score"),
        winner_by_flags(won[0], won[1], "away_team", "home_team").alias("winning_team"),
        winner_by_flags(won[1], won[0], "away_team", "home_team").alias("losing_team"),
        (F.coalesce(won[0], F.lit(False)) != F.coalesce(won[1], F.lit(False))).alias("__one_winner"),
    )
    good = F.col("__one_winner") & F.col("dh").isNotNull() & F.col("game_date").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return rows.where(good).drop("__one_winner"), rows.where(~good).drop("__one_winner")


def flatten_rosters(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per player, day and team."""
    return (
        raw.select("game_date", "season", "team", F.from_json(payload, ROSTER_PAYLOAD).alias("p"))
        .select("game_date", "season", "team", F.explode("p.roster").alias("r"))
        .select(
            "game_date", "season", "team",
            F.col("r.person.fullName").alias("player_name"),
            normalize_name("r.person.fullName").alias("normalized_player_name"),
            F.col("r.person.id").alias("player_id"),
            F.col("r.position.abbreviation").alias("position"),
            F.col("r.status.description").alias("status"),
        )
    )


def flatten_quotes(raw: DataFrame, payload: str = "payload", aliases=QUOTE_ALIASES) -> DataFrame:
    """One row per game and book that quoted it; an All-Star game ends the day's list."""
    starter = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(" ", F.col(f"{c}.firstName"), F.col(f"{c}.lastName")))
    rows = raw.select("game_date", "season", F.from_json(payload, QUOTE_PAYLOAD).alias("p"))
    star = F.array_position(
        F.transform("p.gameRows", lambda r: (r["gameView"]["awayTeam"]["shortName"] == "AL") | (r["gameView"]["homeTeam"]["shortName"] == "AL")),
        F.lit(True),
    )
    listed = F.when(star > 0, F.slice("p.gameRows", F.lit(1), star.cast("int") - 1)).otherwise(F.col("p.gameRows"))
    games = rows.select("game_date", "season", F.explode(listed).alias("g")).select("game_date", "season", "g.gameView.*", "g.oddsViews")
    games = games.select(
        "*",
        canonical("awayTeam.shortName", aliases).alias("away_team"),
        canonical("homeTeam.shortName", aliases).alias("home_team"),
        starter("awayStarter").alias("away_starter"),
        starter("homeStarter").alias("home_starter"),
    )
    quoted = games.select("*", F.explode(F.filter("oddsViews", lambda o: o.isNotNull())).alias("o"))
    return quoted.select(
        "game_date",
        parse_timestamp("startDate").alias("game_datetime"),
        "away_team", "home_team", "away_starter", "home_starter",
        normalize_name("away_starter").alias("away_starter_normalized"),
        normalize_name("home_starter").alias("home_starter_normalized"),
        F.col("awayTeamScore").alias("away_score"),
        F.col("homeTeamScore").alias("home_score"),
        winner_by_score("awayTeamScore", "homeTeamScore", "away_team", "home_team").alias("winner"),
        F.col("o.sportsbook").alias("sportsbook"),
        F.col("o.openingLine.awayOdds").alias("away_opening_odds"),
        F.col("o.openingLine.homeOdds").alias("home_opening_odds"),
        F.col("o.currentLine.awayOdds").alias("away_current_odds"),
        F.col("o.currentLine.homeOdds").alias("home_current_odds"),
        "season",
    )


def flatten_lineups(raw: DataFrame, payload: str = "payload", aliases=TEAM_ALIASES) -> tuple[DataFrame, DataFrame]:
    """(match-ups, players). The starter is the last listed player with GS = 1; his batting
    order is unknown when 0 or in season 2021."""
    games = (
        raw.select("season", F.from_json(payload, LINEUP_PAYLOAD).alias("p"))
        .select("season", F.explode("p").alias("g"))
        .select("season", F.get("g.gameInfo", F.lit(0)).alias("i"), F.col("g.lineupInfo").alias("players"))
    )
    head = [
        F.left(F.col("i.gameDate"), F.lit(10)).try_cast("date").alias("game_date"),
        F.col("i.oppteamid").alias("team_id"),
        canonical("i.Team", aliases, default_to_input=False).alias("team"),
        F.col("i.dh").alias("dh"),
        F.col("i.teamid").alias("opposing_team_id"),
        canonical("i.oppTeam", aliases, default_to_input=False).alias("opposing_team"),
        "season",
    ]
    starters = F.filter("players", lambda p: p["GS"] == 1)
    matchups = games.select(
        *head,
        F.try_element_at(starters, F.lit(-1))["playerId"].alias("team_starter_id"),
        F.col("i.oppSP").alias("opposing_starter_id"),
    )
    p = games.select("*", F.explode("players").alias("pl"))
    hidden = (F.col("pl.GS") == 1) & ((F.col("season") == 2021) | (F.col("pl.BatOrder") == 0))
    players = p.select(
        *head,
        F.col("pl.playerId").alias("player_id"),
        F.col("pl.position").alias("position"),
        F.when(~F.coalesce(hidden, F.lit(False)), F.col("pl.BatOrder")).alias("batting_order"),
    )
    return matchups, players


def _number(entry: Column, field: str, default: float) -> Column:
    return F.coalesce(F.try_element_at(entry, F.lit(field)).try_cast("double"), F.lit(default))


def flatten_game_logs(raw: DataFrame, payload: str = "payload", aliases=TEAM_ALIASES) -> tuple[DataFrame, DataFrame]:
    """(batters, pitchers): the first record (totals) is skipped, the rest is routed by shape
    (batters carry AB, pitchers TBF or W); absent metrics take their typed default."""
    logs = raw.select("season", "mlb_id", F.from_json(payload, "struct<mlb: array<map<string, string>>>").alias("p"))
    rows = logs.select("season", "mlb_id", F.explode(F.slice("p.mlb", F.lit(2), F.greatest(F.size("p.mlb"), F.lit(1)))).alias("e"))
    e = F.col("e")
    at = lambda k: F.try_element_at(e, F.lit(k))
    common = [
        at("playerid").try_cast("long").alias("player_id"), "mlb_id", at("PlayerName").alias("name"),
        normalize_name(at("PlayerName")).alias("normalized_player_name"),
        canonical(at("Team"), aliases).alias("team"),
        at("gamedate").try_cast("date").alias("game_date"), at("dh").try_cast("int").alias("dh"), "season",
    ]
    is_batter = F.map_contains_key(e, "AB")
    batters = rows.where(is_batter).select(
        *common, at("BatOrder").alias("batorder"), at("Pos").alias("pos"),
        at("AB").try_cast("int").alias("ab"), at("PA").try_cast("int").alias("pa"),
        *[_number(e, f, d).alias(n) for n, (f, d) in BATTER_FIELDS.items()],
    )
    pitchers = rows.where(~is_batter & (F.map_contains_key(e, "W") | F.map_contains_key(e, "TBF"))).select(
        *common, at("G").try_cast("int").alias("games"), at("GS").try_cast("int").alias("gs"),
        *[_number(e, f, d).alias(n) for n, (f, d) in PITCHER_FIELDS.items()],
    )
    return batters, pitchers


def merge_league_averages(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Batting and pitching league rows of a year in one record, once both have arrived."""
    first = F.get(F.from_json(payload, "struct<data: array<map<string, string>>>")["data"], F.lit(0))
    rows = raw.select("year", "type", first.alias("e")).where(F.col("e").isNotNull())
    aggs, both = [], F.lit(True)
    for kind, fields in LEAGUE_FIELDS.items():
        of_kind = F.col("type") == kind
        aggs.append(F.count(F.when(of_kind, 1)).alias(f"__{kind}"))
        both = both & (F.col(f"__{kind}") > 0)
        for n, f in fields.items():
            value = F.try_element_at("e", F.lit(f)).try_cast("double")
            aggs.append(F.max(F.when(of_kind, value)).alias(f"{kind.lower()}_{n}"))
    return rows.groupBy("year").agg(*aggs).where(both).drop(*[f"__{k}" for k in LEAGUE_FIELDS])


def read_fielding(spark: SparkSession, path: str, season: int) -> DataFrame:
    return flatten_fielding(spark.read.csv(path, header=True).withColumn("season", F.lit(season)))


def flatten_fielding(raw: DataFrame) -> DataFrame:
    """'Last, First' reversed, outs to innings, run value rounded to 2 digits."""
    name = reverse_comma_name("name")
    return raw.select(
        name.alias("name"),
        normalize_name(name).alias("normalized_player_name"),
        F.col("id").try_cast("long").alias("player_id"),
        F.col("season").cast("int").alias("season"),
        F.col("api_game_date_month_mm").try_cast("int").alias("month"),
        F.round(F.col("total_runs").try_cast("double"), 2).alias("frv"),
        *[(F.col(o).try_cast("double") / 3).alias(n) for n, o in FIELDING_OUTS.items()],
    )


def embedded_rows(pages: DataFrame, html: str, variable: str, element: str, keep=()) -> DataFrame:
    """Rows of a ``var NAME = [...];`` JSON array inside a page."""
    pattern = rf"var\s+{variable}\s*=\s*(\[[\s\S]*?\])\s*;"
    text = F.regexp_extract(html, pattern, 1)
    return pages.select(*keep, F.inline(F.from_json(text, f"array<{element}>")))


def flatten_park_factors(pages: DataFrame, html: str = "html", season: str = "season") -> DataFrame:
    element = "struct<venue_id: int, venue_name: string, index_woba: int>"
    return embedded_rows(pages, html, "data", element, (season,)).select(
        "venue_id", "venue_name", season, F.col("index_woba").alias("park_factor")
    )
