"""Queries of family A: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T


from tallyline.plans.registry import query, r, tidy
from tallyline.session import scratch_path
from tallyline.sources import payloads, shapes, sinks, tables
from tallyline.sources.align import align_to_schema
from tallyline.streaming.ingest import stream_upserts

GAME_COLS = ["game_id", "game_date", "season", "dh", "home_team", "away_team", "home_score", "away_score", "winning_team"]
GC = ", ".join(GAME_COLS)


@query("a1_season_scan", f"SELECT {GC} FROM @games g WHERE season = 1997")
def a1(v):
    return tables.season_scan(v.games, 1997, GAME_COLS)


@query(
    "a2_range_scan",
    "SELECT player_id, game_date, dh, team, pa FROM @player_game p"
    " WHERE game_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND team = 3",
)
def a2(v):
    return tables.range_scan(
        v.player_game, "2024-01-05", "2024-01-20", team=3, columns=["player_id", "game_date", "dh", "team", "pa"]
    )


_HIST = f"""SELECT {GC}, CASE WHEN home_team = 7 THEN 'home' ELSE 'away' END AS team_side,
    CASE WHEN winning_team = 7 THEN 1 ELSE 0 END AS team_won FROM @games g
    WHERE (home_team = 7 OR away_team = 7)
      AND (game_date < DATE '1998-06-01' OR (game_date = DATE '1998-06-01' AND dh < 2))"""


@query("a3_history_before_game", _HIST)
def a3(v):
    return tidy(tables.history_scan(v.games, 7, "1998-06-01", 2).select(*GAME_COLS, "team_side", "team_won"))


@query("a4_history_same_season", _HIST + " AND season = 1998")
def a4(v):
    out = tables.history_scan(v.games, 7, "1998-06-01", 2, season=1998)
    return tidy(out.select(*GAME_COLS, "team_side", "team_won"))


@query(
    "a5_side_and_result_tags",
    """SELECT team, CASE WHEN is_home = 1 THEN 'home' ELSE 'away' END AS team_side,
         count(*) AS games, CAST(sum(is_winner) AS BIGINT) AS won FROM @team_log t GROUP BY 1, 2""",
)
def a5(v):
    from tallyline.operators.sides import team_rows

    side = F.when(F.col("is_home"), "home").otherwise("away")
    return team_rows(v.games).groupBy("team", side.alias("team_side")).agg(
        F.count(F.lit(1)).alias("games"), F.sum("is_winner").alias("won")
    )


@query("a6_season_games_of_team", f"SELECT {GC} FROM @games g WHERE season = 1999 AND (home_team = 11 OR away_team = 11)")
def a6(v):
    return tables.season_games(v.games, 1999, 11).select(*GAME_COLS)


@query("a7_entity_scan", "SELECT player_id, game_date, dh, pa, woba FROM @player_game p WHERE player_id = 42 AND season = 2")
def a7(v):
    return tables.entity_scan(v.player_game, 42, 2).select("player_id", "game_date", "dh", "pa", "woba")


@query(
    "a8_snapshot_scan",
    "SELECT game_date, team, player_id FROM @rosters x WHERE team = 3 AND game_date = DATE '2024-01-09'",
)
def a8(v):
    rosters = v.rosters.withColumn("season", F.year("game_date"))
    return tables.snapshot_scan(rosters, 2024, 3, "2024-01-09").select("game_date", "team", "player_id")


@query(
    "a8_lineup_scan",
    "SELECT game_date, dh, player_id, batting_order FROM @lineups x WHERE team = 4 AND game_date = DATE '2024-01-10'",
)
def a8_lineups(v):
    lineups = v.lineups.withColumn("season", F.year("game_date"))
    return tables.snapshot_scan(lineups, 2024, 4, "2024-01-10").select("game_date", "dh", "player_id", "batting_order")


@query(
    "a8_matchup_scan",
    "SELECT game_date, dh, team, opposing_team, team_starter_id, opposing_starter_id FROM @matchups x WHERE year(game_date) = 2024 AND team = 5",
)
def a8_matchups(v):
    matchups = v.matchups.withColumn("season", F.year("game_date"))
    return tables.snapshot_scan(matchups, 2024, 5).select("game_date", "dh", "team", "opposing_team", "team_starter_id", "opposing_starter_id")


@query(
    "a9_quote_lookup",
    """SELECT game_date, home_team, away_team, sportsbook, quote_id, home_opening_odds, away_opening_odds FROM @quotes q
       WHERE game_date = DATE '1998-09-18' AND home_team = 9 AND away_team = 11""",
)
def a9(v):
    return tables.quote_lookup(v.quotes, "1998-09-18", 11, 9).select(
        "game_date", "home_team", "away_team", "sportsbook", "quote_id", "home_opening_odds", "away_opening_odds"
    )


_STARTED = """(SELECT *, 'starter ' || CAST((true_game_id + away_team) % 7 AS STRING) AS away_starter_normalized,
    'starter ' || CAST((true_game_id + home_team) % 7 AS STRING) AS home_starter_normalized FROM @quotes q0)"""


@query(
    "a9_quote_lookup_starters",
    f"""WITH q AS {_STARTED}, g AS (SELECT * FROM q QUALIFY row_number() OVER (ORDER BY true_game_id, sportsbook, quote_id) = 1)
        SELECT q.game_date, q.home_team, q.away_team, q.sportsbook, q.quote_id FROM q JOIN g ON q.game_date = g.game_date AND q.home_team = g.home_team
          AND q.away_team = g.away_team AND q.away_starter_normalized = g.away_starter_normalized AND q.home_starter_normalized = g.home_starter_normalized""".replace(" AS STRING", " AS VARCHAR"),
)
def a9_starters(v):
    """The books of the first quoted game whose starters are those of its first quote."""
    starter = lambda side: F.concat(F.lit("starter "), ((F.col("true_game_id") + F.col(f"{side}_team")) % 7).cast("string"))
    started = v.quotes.withColumn("away_starter_normalized", starter("away")).withColumn("home_starter_normalized", starter("home"))
    g = started.orderBy("true_game_id", "sportsbook", "quote_id").first()
    if g is None:
        return started.select("game_date", "home_team", "away_team", "sportsbook", "quote_id")
    found = tables.quote_lookup(started, g.game_date, g.away_team, g.home_team, away_starter=g.away_starter_normalized, home_starter=g.home_starter_normalized)
    return found.select("game_date", "home_team", "away_team", "sportsbook", "quote_id")


@query("a10_fielding_scan", "SELECT player_id, month, frv, total_innings FROM @fielding f")
def a10_fielding(v):
    """All rows of the season, by month."""
    return tables.fielding_scan(v.fielding.withColumn("season", F.lit(2024)), 2024).select("player_id", "month", "frv", "total_innings")


@query(
    "a10_dimension_scan",
    "SELECT venue_id, park_factor FROM @parks p WHERE park_factor IS NOT NULL",
)
def a10(v):
    return tables.park_factor_scan(v.parks.withColumn("season", F.lit(2024)), 2024).select("venue_id", "park_factor")


@query(
    "a11_load_validation",
    """SELECT event_id, CAST(ts AS DATE) AS game_date, CASE WHEN user_id % 5 = 0 OR user_id % 7 = 0 THEN NULL ELSE value END AS value
       FROM @events e""",
)
def a11(v):
    raw = v.events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("game_date"),
        F.when(F.col("user_id") % 5 == 0, float("inf")).when(F.col("user_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("value"),
    )
    return tables.validate(raw, ["event_id", "game_date", "value"])


_TARGET = T.StructType(
    [
        T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()),
        T.StructField("rating", T.IntegerType(), False), T.StructField("score", T.DoubleType(), False),
        T.StructField("note", T.StringType(), False), T.StructField("phone", T.StringType()),
    ]
)


@query(
    "a12_schema_alignment",
    """SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(0 AS BIGINT) AS rating, CAST(0 AS DOUBLE) AS score,
         '' AS note, CAST(NULL AS VARCHAR) AS phone FROM @supplier s""",
)
def a12(v):
    return align_to_schema(v.supplier, _TARGET).withColumn("rating", F.col("rating").cast("long"))


_LINE_VERSION = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a13_keyed_upsert",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (l_returnflag <> 'A') DESC,
           l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) AS n
         FROM @lineitem l) x WHERE n = 1""",
)
def a13(v):
    line = v.lineitem
    stored, batch = line.where("l_returnflag = 'A'"), line.where("l_returnflag <> 'A'")
    out = sinks.upsert(stored, batch, ["l_orderkey", "l_linenumber"], _LINE_VERSION)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


@query(
    "a13_partition_move",
    """SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS season FROM @orders o""",
)
def a13_partition_move(v):
    """A fifth of the orders is delivered again with the next season: each order is stored once, in its new partition."""
    path = f"{scratch_path(v.spark, 'upsert')}/table"
    orders = v.orders.selectExpr("o_orderkey", "o_custkey", "o_totalprice", "year(o_orderdate) AS season", "1 AS delivery")
    moved = orders.where("o_orderkey % 5 = 0").selectExpr("o_orderkey", "o_custkey", "o_totalprice", "season + 1 AS season", "2 AS delivery")
    for batch in (orders, moved):
        sinks.upsert_table(batch, path, ["o_orderkey"], ["delivery"], "season")
    return v.spark.read.parquet(path).selectExpr("o_orderkey", "o_custkey", "o_totalprice", "bigint(season) AS season")


@query(
    "a14_latest_players",
    """SELECT player_id, mlb_id, pos, team AS current_team, game_date FROM (
         SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, dh DESC) AS n FROM @player_game p) x
       WHERE n = 1""",
)
def a14(v):
    stats = v.player_game.select(
        "player_id", "mlb_id", F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("normalized_player_name"), "pos", "team", "game_date", "dh",
    )
    players = sinks.latest_players(stats, ["game_date", "dh"])
    seen = stats.groupBy("player_id").agg(F.max("game_date").alias("game_date"))
    return players.select("player_id", "mlb_id", "pos", "current_team").join(seen, "player_id")


_TEAM_NAMES = ", ".join(f"'{n}'" for n in (
    "Arizona Diamondbacks", "Atlanta Braves", "Chicago Cubs", "Boston Red Sox", "New York Mets",
    "Oakland Athletics", "Tampa Bay Rays", "San Diego Padres", "Unknown Club", "American League All-Stars"))


@query(
    "a15_schedule_payload",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS game_id, CAST(o_orderdate AS DATE) AS game_date,
          CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 24) * 3600 AS game_second, away_team, home_team,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS BIGINT) WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS dh,
          o_custkey % 9 AS home_score, CASE WHEN w THEN home_team ELSE away_team END AS winning_team,
          CASE WHEN w THEN away_team ELSE home_team END AS losing_team,
          CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(50 + o_orderkey % 40 AS BIGINT) END AS temp
        FROM (SELECT *, o_orderkey % 2 = 0 AS w,
           ['ARI','ATL','CHC','BOS','NYM','ATH','TBR','SDP',NULL,'*'][CAST(1 + o_custkey % 10 AS INT)] AS away_team,
           ['ARI','ATL','CHC','BOS','NYM','ATH','TBR','SDP',NULL,'*'][CAST(1 + (o_custkey // 10) % 10 AS INT)] AS home_team
          FROM @orders o) x
        WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' AND coalesce(away_team, '') <> '*'
          AND coalesce(home_team, '') <> '*' AND o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 2""",
)
def a15(v):
    """Payloads are built from the orders, one document per game."""
    raw = v.orders.select(F.year("o_orderdate").alias("season"), F.expr(f"""to_json(named_struct('dates', array(named_struct('games', array(
        named_struct('gamePk', o_orderkey, 'gameType', if(o_orderpriority = '1-URGENT', 'S', 'R'),
          'officialDate', date_format(o_orderdate, 'yyyy-MM-dd'),
          'gameDate', concat(date_format(o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR, "yyyy-MM-dd'T'HH:mm:ss"), 'Z'),
          'dayNight', 'day',
          'doubleHeader', CASE o_orderkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'Y' ELSE 'X' END,
          'gameNumber', CAST(1 + o_orderkey % 2 AS INT),
          'status', named_struct('detailedState', if(o_orderstatus = 'P', 'Postponed', 'Final')),
          'teams', named_struct(
            'away', named_struct('team', named_struct('name', array({_TEAM_NAMES})[CAST(o_custkey % 10 AS INT)]),
               'score', CAST(o_custkey % 7 AS INT), 'isWinner', o_orderkey % 2 = 1 AND o_orderkey % 11 <> 0),
            'home', named_struct('team', named_struct('name', array({_TEAM_NAMES})[CAST((o_custkey div 10) % 10 AS INT)]),
               'score', CAST(o_custkey % 9 AS INT), 'isWinner', o_orderkey % 2 = 0 AND o_orderkey % 11 <> 0)),
          'weather', if(o_orderstatus = 'F', NULL, named_struct('temp', CAST(50 + o_orderkey % 40 AS STRING), 'wind', '5 mph, L To R')),
          'venue', named_struct('id', 1, 'name', 'Park')))))))""").alias("payload"))
    games, _ = payloads.flatten_schedule(raw)
    return tidy(games.select(
        "game_id", "game_date", F.unix_seconds(F.col("game_datetime").cast("timestamp")).alias("game_second"),
        "away_team", "home_team", "dh", "home_score", "winning_team", "losing_team", "temp",
    ))


@query(
    "a16_roster_payload",
    """SELECT CAST(ts AS DATE) AS game_date, user_id % 10 AS team, user_id AS player_id,
         'jose nunez ' || CAST(user_id AS VARCHAR) AS normalized_player_name, event_type AS status
       FROM @events e""",
)
def a16(v):
    raw = v.events.select(
        F.to_date("ts").alias("game_date"), F.year("ts").alias("season"), (F.col("user_id") % 10).alias("team"),
        F.expr("""to_json(named_struct('roster', array(named_struct('person', named_struct('id', user_id,
            'fullName', concat('José Núñez ', user_id)), 'position', named_struct('abbreviation', 'P'),
            'status', named_struct('description', event_type)))))""").alias("payload"),
    )
    return payloads.flatten_rosters(raw).select("game_date", "team", "player_id", "normalized_player_name", "status")


@query(
    "a17_quote_payload",
    """SELECT l_orderkey AS game_key, 'book' || CAST(l_suppkey AS VARCHAR) AS sportsbook,
         CASE l_linenumber WHEN 1 THEN 'SDP' WHEN 2 THEN 'WSN' ELSE 'NYY' END AS away_team, 'KCR' AS home_team,
         CASE WHEN l_partkey % 8 > l_partkey % 9 THEN (CASE l_linenumber WHEN 1 THEN 'SDP' WHEN 2 THEN 'WSN' ELSE 'NYY' END) ELSE 'KCR' END AS winner,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE 'jp sears' END AS away_starter_normalized,
         -100 - l_quantity AS home_opening_odds, 100 + l_quantity AS away_current_odds
       FROM @lineitem l WHERE l_linenumber <> 5 AND l_linestatus <> 'F'""",
)
def a17(v):
    raw = v.lineitem.select(
        F.to_date("l_shipdate").alias("game_date"), F.col("l_orderkey").alias("season"),
        F.expr("""to_json(named_struct('gameRows', array(named_struct('gameView', named_struct('gameId', l_orderkey,
          'startDate', '2021-04-13T18:10:00+00:00',
          'awayTeam', named_struct('shortName', CASE l_linenumber WHEN 1 THEN 'SD' WHEN 2 THEN 'WAS' WHEN 5 THEN 'AL' ELSE 'NYY' END),
          'homeTeam', named_struct('shortName', 'KC'),
          'awayStarter', if(l_returnflag = 'N', NULL, named_struct('firstName', 'J.P.', 'lastName', 'Sears')),
          'awayTeamScore', CAST(l_partkey % 8 AS INT), 'homeTeamScore', CAST(l_partkey % 9 AS INT)),
        'oddsViews', array(NULL, if(l_linestatus = 'F', NULL, named_struct('sportsbook', concat('book', l_suppkey),
           'openingLine', named_struct('awayOdds', 100 + l_quantity, 'homeOdds', -100 - l_quantity),
           'currentLine', named_struct('awayOdds', 100 + l_quantity, 'homeOdds', -100 - l_quantity))))))),
        map('ignoreNullFields', 'false'))""").alias("payload"),
    )
    return payloads.flatten_quotes(raw).select(
        F.col("season").alias("game_key"), "sportsbook", "away_team", "home_team", "winner", "away_starter_normalized",
        "home_opening_odds", "away_current_odds",
    )


_LINEUP_JSON = """to_json(array(named_struct('gameInfo', array(named_struct('Team', 'Mets', 'oppTeam', 'Yankees', 'teamid', 9,
      'oppteamid', 25, 'gameDate', concat(date_format(ts, 'yyyy-MM-dd'), 'T00:00:00'), 'dh', CAST(event_id AS INT), 'oppSP', user_id + 1)),
    'lineupInfo', array(named_struct('playerId', user_id, 'position', 'P', 'GS', CAST(user_id % 2 AS INT), 'BatOrder', CAST(user_id % 4 AS INT)),
      named_struct('playerId', user_id + 500, 'position', '1B', 'GS', 0, 'BatOrder', 0)))))"""


@query(
    "a18_lineup_matchups",
    """SELECT CAST(ts AS DATE) AS game_date, event_id AS dh, 'NYM' AS team, 'NYY' AS opposing_team,
         CASE WHEN user_id % 2 = 1 THEN user_id END AS team_starter_id, user_id + 1 AS opposing_starter_id FROM @events e""",
)
def a18(v):
    raw = v.events.select(F.year("ts").alias("season"), F.expr(_LINEUP_JSON).alias("payload"))
    m, _ = payloads.flatten_lineups(raw)
    return tidy(m.select("game_date", "dh", "team", "opposing_team", "team_starter_id", "opposing_starter_id"))


@query(
    "a18_lineup_players",
    """SELECT event_id AS dh, user_id AS player_id, 'P' AS position,
         CASE WHEN user_id % 2 = 1 AND user_id % 4 = 0 THEN NULL ELSE user_id % 4 END AS batting_order FROM @events e
       UNION ALL SELECT event_id, user_id + 500, '1B', 0 FROM @events e""",
)
def a18b(v):
    raw = v.events.select(F.year("ts").alias("season"), F.expr(_LINEUP_JSON).alias("payload"))
    _, p = payloads.flatten_lineups(raw)
    return tidy(p.select("dh", "player_id", "position", "batting_order"))


_LOG_JSON = """to_json(named_struct('mlb', array(map('playerid', 'total'),
    if(event_type = 'purchase',
       map('playerid', CAST(user_id AS STRING), 'PlayerName', 'Ann', 'Team', 'Mets', 'gamedate', date_format(ts, 'yyyy-MM-dd'), 'dh', '0', 'W', '1', 'G', '1', 'GS', '1', 'FIP', CAST(value AS STRING)),
       map('playerid', CAST(user_id AS STRING), 'PlayerName', 'Ann', 'Team', 'XYZ', 'gamedate', date_format(ts, 'yyyy-MM-dd'), 'dh', '0', 'AB', '3', 'PA', '4', 'wOBA', CAST(value AS STRING))))))"""


def _game_logs(v):
    return payloads.flatten_game_logs(
        v.events.select(F.year("ts").alias("season"), F.col("event_id").alias("mlb_id"), F.expr(_LOG_JSON).alias("payload"))
    )


@query(
    "a19_game_log_batters",
    """SELECT event_id AS mlb_id, user_id AS player_id, 'XYZ' AS team, CAST(ts AS DATE) AS game_date, CAST(3 AS BIGINT) AS ab, CAST(4 AS BIGINT) AS pa, value AS woba,
         CAST(100 AS DOUBLE) AS wrc_plus, CAST(0 AS DOUBLE) AS ev FROM @events e WHERE event_type <> 'purchase'""",
)
def a19(v):
    return tidy(_game_logs(v)[0].select("mlb_id", "player_id", "team", "game_date", "ab", "pa", "woba", "wrc_plus", "ev"), skip=("woba",))


@query(
    "a19_game_log_pitchers",
    """SELECT event_id AS mlb_id, user_id AS player_id, 'NYM' AS team, CAST(1 AS BIGINT) AS games, CAST(1 AS BIGINT) AS gs, value AS fip, CAST(100 AS DOUBLE) AS stuff,
         CAST(0 AS DOUBLE) AS era FROM @events e WHERE event_type = 'purchase'""",
)
def a19b(v):
    return tidy(_game_logs(v)[1].select("mlb_id", "player_id", "team", "games", "gs", "fip", "stuff", "era"), skip=("fip",))


_MIXED_JSON = f"""CASE event_type WHEN 'error' THEN concat('{{"mlb": [', user_id) WHEN 'signup' THEN '{{"mlb": [{{"playerid": "total"}}, {{"playerid": "7", "gamedate": "2024-01-02", "G": 1}}]}}'
    WHEN 'click' THEN replace({_LOG_JSON}, '"wOBA":"', '"wOBA":"about ') ELSE {_LOG_JSON} END"""


@query(
    "a19_routed_records",
    """SELECT event_id AS mlb_id, CASE event_type WHEN 'view' THEN 'batter' WHEN 'purchase' THEN 'pitcher' END AS route,
         CASE event_type WHEN 'error' THEN 'malformed' WHEN 'signup' THEN 'unknown shape' WHEN 'click' THEN 'bad wOBA' END AS reason,
         CASE WHEN event_type IN ('view', 'purchase') THEN user_id END AS player_id, CASE WHEN event_type IN ('view', 'purchase') THEN value END AS value FROM @events e""",
)
def a19_routed(v):
    """Batters, pitchers and rejects of payloads of five shapes: every record comes out somewhere."""
    raw = v.events.select(F.year("ts").alias("season"), F.col("event_id").alias("mlb_id"), F.expr(_MIXED_JSON).alias("payload"))
    batters, pitchers, rejects = shapes.route_game_logs(raw)
    out = batters.selectExpr("mlb_id", "'batter' AS route", "cast(NULL as string) AS reason", "player_id", "woba AS value")
    out = out.unionByName(pitchers.selectExpr("mlb_id", "'pitcher' AS route", "cast(NULL as string) AS reason", "player_id", "fip AS value"))
    return out.unionByName(rejects.selectExpr("mlb_id", "cast(NULL as string) AS route", "reason", "cast(NULL as bigint) AS player_id", "cast(NULL as double) AS value"))


@query(
    "a20_league_payload_merge",
    """SELECT CAST(b.g AS BIGINT) AS year, b.v AS bats_woba, t.v AS throws_era, CAST(NULL AS DOUBLE) AS throws_fip FROM
         (SELECT user_id AS g, max(value) AS v FROM @events e WHERE event_type = 'view' GROUP BY user_id) b
       JOIN (SELECT user_id AS g, max(value) AS v FROM @events e WHERE event_type = 'click' GROUP BY user_id) t ON b.g = t.g""",
)
def a20(v):
    raw = v.events.where("event_type IN ('view', 'click')").groupBy(
        F.col("user_id").alias("year"), F.when(F.col("event_type") == "view", "Bats").otherwise("Throws").alias("type")
    ).agg(F.max("value").alias("value"))
    raw = raw.select("year", "type", F.expr("to_json(named_struct('data', array(map('wOBA', CAST(value AS STRING), 'ERA', CAST(value AS STRING)))))").alias("payload"))
    return payloads.merge_league_averages(raw).select("year", "bats_woba", "throws_era", "throws_fip")


@query(
    "a21_fielding_csv",
    f"""SELECT 'Anna ' || CAST(s_suppkey AS VARCHAR) || ' Supplier' AS name, 'anna ' || CAST(s_suppkey AS VARCHAR) || ' supplier' AS normalized_player_name,
         s_suppkey AS player_id, CAST(1 + s_suppkey % 12 AS BIGINT) AS month, {r('s_acctbal', 2)} AS frv, {r('CAST(s_nationkey AS DOUBLE) / 3')} AS total_innings
       FROM @supplier s""",
)
def a21(v):
    """The CSV file is written from the supplier table, then scanned."""

    path = scratch_path(v.spark, "fielding-csv")
    raw = v.supplier.select(
        F.concat(F.lit("Supplier, Anna "), F.col("s_suppkey")).alias("name"),
        F.col("s_suppkey").alias("id"),
        (1 + F.col("s_suppkey") % 12).alias("api_game_date_month_mm"),
        F.col("s_acctbal").alias("total_runs"),
        *[F.col("s_nationkey").alias(c) for c in payloads.FIELDING_OUTS.values()],
    )
    raw.write.csv(path, header=True)
    return tidy(payloads.read_fielding(v.spark, path, 2024).select(
        "name", "normalized_player_name", "player_id", "month", "frv", "total_innings"))


@query(
    "a22_embedded_page_rows",
    """SELECT page_id, CAST(regexp_extract(html, 'track\\((\\d+)\\);', 1) AS BIGINT) AS venue_id, url AS venue_name,
         CAST(page_id % 50 AS BIGINT) AS park_factor FROM @pages p""",
)
def a22(v):
    """Every page gets a data array built from its own tracking number and url."""
    number = F.regexp_extract("html", r"track\((\d+)\);", 1)
    data = F.concat(
        F.col("html"), F.lit("<script>\nvar data = "),
        F.to_json(F.array(F.struct(number.cast("int").alias("venue_id"), F.col("url").alias("venue_name"), (F.col("page_id") % 50).alias("index_woba")))),
        F.lit(" ;</script>"),
    )
    pages = v.pages.select(F.col("page_id").alias("season"), data.alias("html"))
    return tidy(payloads.flatten_park_factors(pages).select(F.col("season").alias("page_id"), "venue_id", "venue_name", "park_factor"))


@query(
    "a23_date_coverage",
    """SELECT d.day, CASE WHEN s.game_date IS NULL THEN CAST(0 AS BIGINT) ELSE 1 END AS scraped FROM
         (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day) d
       LEFT JOIN (SELECT DISTINCT game_date FROM @games g) s ON d.day = s.game_date""",
)
def a23(v):
    spans = v.spark.createDataFrame([(f"{y}-01-01", f"{y + 1}-01-01") for y in range(1995, 2002)], "start string, end string")
    spans = spans.select(F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return tidy(sinks.missing_dates(spans, v.games))


@query(
    "a24_feature_cache",
    "SELECT season, count(*) AS n, CAST(sum(is_winner_home) AS BIGINT) AS home_wins FROM @games g GROUP BY season",
)
def a24(v):
    """Built and stored on the first call, read back on the second; force builds again."""
    root = scratch_path(v.spark, "cache")
    key = sinks.cache_key(kind="home_wins", halflives=(3, 8, 20), version=1)
    build = lambda: v.games.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("is_winner_home").cast("long").alias("home_wins"))
    sinks.cached(v.spark, root, key, build)
    return sinks.cached(v.spark, root, key, build)


@query(
    "a24_changed_inputs",
    """SELECT season, count(*) AS n, CAST(sum(is_winner_home + CASE WHEN game_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS home_wins, CAST(2 AS BIGINT) AS builds FROM @games g GROUP BY season""",
)
def a24_changed(v):
    """Built, found again, and built anew once an upsert has changed the table beneath."""
    root, table, builds = scratch_path(v.spark, "cache"), scratch_path(v.spark, "games"), []
    games = v.games.selectExpr("season", "game_id", "is_winner_home AS won")
    sinks.upsert_table(games, table, ["game_id"], ["won"], "season")

    def build():
        builds.append(1)
        return v.spark.read.parquet(table).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("won").cast("long").alias("home_wins"))

    read = lambda: sinks.cached_from(v.spark, root, [v.spark.read.parquet(table)], build, kind="home_wins", version=1)
    read()
    read()
    sinks.upsert_table(games.where("game_id % 10 = 0").withColumn("won", F.col("won") + 1), table, ["game_id"], ["won"], "season")
    return read().select(F.col("season").cast("long").alias("season"), "n", "home_wins").withColumn("builds", F.lit(len(builds)).cast("long"))


@query(
    "a25_table_inventory",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM @{t} t" for t in ("orders", "lineitem", "events", "customer", "supplier", "part", "documents", "pages")),
)
def a25(v):
    names = ("orders", "lineitem", "events", "customer", "supplier", "part", "documents", "pages")
    return tables.inventory({n: getattr(v, n) for n in names})


@query("a25_table_sizes")
def a25_sizes(v):
    """Files and bytes of every table and of all of them (sizes are not in SQL's reach, so no oracle)."""
    names = ("orders", "lineitem", "events", "customer", "supplier", "part", "documents", "pages")
    return tidy(tables.sizes({n: getattr(v, n) for n in names}))


@query(
    "a26_full_refresh",
    "SELECT season, count(*) AS n, CAST(max(game_id) AS BIGINT) AS last_id FROM @games g GROUP BY season",
)
def a26(v):
    """A table is stored, then replaced as a whole, then one season's partition is replaced."""
    path = scratch_path(v.spark, "refresh")
    games = v.games.select("season", "game_id")
    sinks.refresh_table(games.withColumn("game_id", -F.col("game_id")), path, "season")
    sinks.refresh_table(games, path, "season")
    sinks.refresh_table(games.where("season = 1998"), path, "season")
    return v.spark.read.parquet(path).groupBy(F.col("season").cast("long").alias("season")).agg(
        F.count(F.lit(1)).alias("n"), F.max("game_id").alias("last_id")
    )


@query(
    "a27_ad_hoc_sql",
    "SELECT home_team, count(*) AS n FROM @games g WHERE season >= 1997 AND dh = 1 GROUP BY home_team",
)
def a27(v):
    return tables.ad_hoc(
        v.spark, "SELECT home_team, count(*) AS n FROM contest_games WHERE season >= ? AND dh = ? GROUP BY home_team", [1997, 1], contest_games=v.games
    )


@query(
    "j1_incremental_ingest",
    """SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS BIGINT) AS season FROM @orders o""",
)
def j1(v):
    """The orders file is delivered twice; the merged table holds every key once."""
    spark, root = v.spark, scratch_path(v.spark, "ingest")
    target = f"{root}/table"
    add_season = lambda df: df.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("season"))
    for attempt in ("first", "again"):
        stream_upserts(
            spark, v.dir, v.orders.schema, target, f"{root}/checkpoint-{attempt}", ["o_orderkey"], ["o_totalprice"],
            partition="season", pattern="orders.parquet", transform=add_season,
        ).awaitTermination()
    return spark.read.parquet(target).select("o_orderkey", "o_custkey", "o_totalprice", F.col("season").cast("long").alias("season"))
