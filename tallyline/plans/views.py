"""The driver's tables seen as contests, player logs, quotes and predictions.

Each view is one SELECT that Spark and DuckDB both read; ``@name`` stands for a base table
or another view. Values are integer arithmetic on the columns, every row is used.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.session import tune

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"

VIEWS: dict[str, str] = {
    # one row per contest
    "games": """
        SELECT *, CASE WHEN home_score > away_score THEN home_team ELSE away_team END AS winning_team,
               CASE WHEN home_score > away_score THEN away_team ELSE home_team END AS losing_team,
               CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS is_winner_home
        FROM (
          SELECT game_id, game_date, game_datetime, season, dh, home_team, away_team, venue_id, home_score,
                 CASE WHEN a = home_score THEN a + 1 ELSE a END AS away_score
          FROM (
            SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date,
                   o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS game_datetime,
                   CAST(year(o_orderdate) AS BIGINT) AS season,
                   o_orderkey % 3 AS dh,
                   o_custkey % 30 AS home_team,
                   (o_custkey % 30 + 1 + o_orderkey % 29) % 30 AS away_team,
                   o_custkey % 40 AS venue_id,
                   CAST(floor(o_totalprice) AS BIGINT) % 11 AS home_score,
                   (o_orderkey * 7) % 11 AS a
            FROM @orders) g1) g2""",
    # the schedule before cleaning: some games have no result, some start days later
    "raw_schedule": """
        SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date,
               o_orderdate + (o_orderkey % 60) * INTERVAL '1' HOUR AS game_datetime,
               o_custkey % 30 AS home_team, (o_custkey % 30 + 1 + o_orderkey % 29) % 30 AS away_team,
               CASE WHEN o_orderstatus = 'P' THEN NULL
                    WHEN CAST(floor(o_totalprice) AS BIGINT) % 2 = 0 THEN o_custkey % 30
                    ELSE (o_custkey % 30 + 1 + o_orderkey % 29) % 30 END AS winning_team
        FROM @orders""",
    "team_log": """
        SELECT game_id, game_date, dh, game_datetime, season, CAST(1 AS BIGINT) AS is_home, home_team AS team,
               away_team AS opposing_team, home_score AS team_score, away_score AS opposing_team_score,
               is_winner_home AS is_winner FROM @games
        UNION ALL
        SELECT game_id, game_date, dh, game_datetime, season, 0, away_team, home_team, away_score, home_score,
               1 - is_winner_home FROM @games""",
    "weather": """
        SELECT o_orderkey AS game_id, o_custkey % 40 AS venue_id,
               CASE WHEN o_orderstatus = 'P' THEN NULL
                    ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 30 AS STRING) || ' mph, ' ||
                         CASE o_orderpriority WHEN '1-URGENT' THEN 'Out To CF' WHEN '2-HIGH' THEN 'In From LF'
                              WHEN '3-MEDIUM' THEN 'L To R' WHEN '5-LOW' THEN 'Calm' ELSE 'Sideways' END END AS wind,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN NULL
                    WHEN o_orderpriority = '2-HIGH' THEN 'Roof Closed' WHEN o_orderpriority = '3-MEDIUM' THEN 'Sunny'
                    WHEN o_orderpriority = '5-LOW' THEN 'Hail' ELSE 'Partly Cloudy' END AS condition,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 24 < 12 THEN 'day' ELSE 'night' END AS day_night_game
        FROM @orders""",
    "parks": """
        SELECT CAST(n_nationkey AS BIGINT) AS venue_id,
               CASE WHEN n_regionkey = 0 THEN NULL ELSE CAST(90 + n_nationkey AS BIGINT) END AS park_factor
        FROM @nation""",
    # one row per price of a book for a contest
    "quotes": """
        SELECT g.game_id AS true_game_id, g.season,
               CASE WHEN l_linenumber = 7 THEN CAST(g.game_date + INTERVAL '1' DAY AS DATE) ELSE g.game_date END AS game_date,
               CASE WHEN l_linenumber <= 4 THEN g.game_datetime
                    ELSE g.game_datetime + l_linenumber * INTERVAL '1' HOUR END AS game_datetime,
               g.away_team, g.home_team, l_suppkey AS sportsbook,
               CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' ||
                 CAST(CAST(l_quantity AS BIGINT) AS STRING) || '-' ||
                 CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING) || '-' || l_returnflag || l_linestatus AS quote_id,
               CASE WHEN l_linenumber % 2 = 1 THEN 100 + 3 * l_quantity ELSE -(100 + 4 * l_quantity) END AS away_opening_odds,
               CASE WHEN l_linenumber % 2 = 1 THEN -(100 + 4 * l_quantity) ELSE 100 + 3 * l_quantity END AS home_opening_odds
        FROM @lineitem l JOIN @games g ON l.l_orderkey = g.game_id""",
    "quote_probs": """
        SELECT *, hr / (hr + ar) AS home_opening_prob_nv, ar / (hr + ar) AS away_opening_prob_nv, hr + ar AS vig_open,
               hr AS home_opening_prob_raw, ar AS away_opening_prob_raw
        FROM (SELECT *,
                CASE WHEN home_opening_odds < 0 THEN -home_opening_odds / (-home_opening_odds + 100.0) ELSE 100.0 / (home_opening_odds + 100.0) END AS hr,
                CASE WHEN away_opening_odds < 0 THEN -away_opening_odds / (-away_opening_odds + 100.0) ELSE 100.0 / (away_opening_odds + 100.0) END AS ar
              FROM @quotes) q""",
    # one row per player, day and half-day game
    "player_game": f"""
        SELECT player_id, player_id + 1000 AS mlb_id, game_date, dh, team, season, pos,
               n AS games, gs, last_event,
               k % 6 AS pa, k % 5 AS ab, k % 4 AS bip, k % 7 AS tbf, k % 9 AS ip, CAST(1 AS BIGINT) AS apps,
               v AS woba, CASE WHEN k % 7 = 0 THEN NULL ELSE v / 10 END AS ops, CAST(k AS DOUBLE) AS wrc_plus,
               v * 2 AS iso, v + k AS babip, v - k AS k_percent, v / 4 AS bb_percent, CAST(k % 11 AS DOUBLE) AS barrel_percent,
               v / 8 AS hard_hit, 80 + v / 16 AS ev, CAST(k % 13 AS DOUBLE) AS gb_fb, CAST(k % 17 AS DOUBLE) AS bb_k,
               CAST(k % 5 - 2 AS DOUBLE) AS baserunning, v - 20 AS wraa, CAST(k % 9 - 4 AS DOUBLE) AS wpa,
               v / 2 AS era, v / 5 AS hr_fb, v / 3 AS fip, v + 1 AS siera, CAST(100 + k % 20 AS DOUBLE) AS stuff,
               CAST(k % 3 AS DOUBLE) AS gmli, v - k - v / 4 AS k_bb_percent,
               CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 9 - 4 AS DOUBLE) / (k % 3) END AS wpa_li,
               CAST(k % 10 AS DOUBLE) / 10 AS fa_percent, CAST(k % 4 AS DOUBLE) / 10 AS fc_percent, CAST(k % 3 AS DOUBLE) / 10 AS si_percent,
               90 + v / 50 AS fa_velo, 85 + v / 50 AS fc_velo, 88 + v / 50 AS si_velo
        FROM (
          SELECT user_id AS player_id, CAST(ts AS DATE) AS game_date,
                 CAST(CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS BIGINT) AS dh,
                 user_id % 10 AS team,
                 CAST(CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS BIGINT) AS season,
                 CASE WHEN user_id % 3 = 0 THEN 'P' WHEN user_id % 7 = 0 THEN NULL ELSE 'SS' END AS pos,
                 count(*) AS n, CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS gs,
                 max(event_id) AS last_event, CAST(sum({_K}) AS BIGINT) AS k, max(value) AS v
          FROM @events GROUP BY user_id, CAST(ts AS DATE), CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END,
                 CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END) e""",
    # contests between the clubs of the player log
    "club_games": """
        SELECT DISTINCT CAST(CAST(date_part('day', game_date) AS BIGINT) * 100 + (team - team % 2) * 10 + dh AS BIGINT) AS game_id,
               game_date, dh, team - team % 2 AS home_team, team - team % 2 + 1 AS away_team
        FROM @player_game""",
    "starters": """
        SELECT game_date, dh, team, min(player_id) AS starter_id FROM @player_game
        WHERE pos = 'P' AND gs = 1 GROUP BY game_date, dh, team""",
    "matchups": """
        SELECT s.game_date, s.dh, s.team, s.opposing_team, a.starter_id AS team_starter_id, b.starter_id AS opposing_starter_id
        FROM (SELECT game_date, dh, home_team AS team, away_team AS opposing_team FROM @club_games
              UNION ALL SELECT game_date, dh, away_team, home_team FROM @club_games) s
        LEFT JOIN @starters a ON s.game_date = a.game_date AND s.dh = a.dh AND s.team = a.team
        LEFT JOIN @starters b ON s.game_date = b.game_date AND s.dh = b.dh AND s.opposing_team = b.team""",
    # odd teams did not report their own starter
    "gap_matchups": """
        SELECT game_date, dh, team, opposing_team,
               CASE WHEN team % 2 = 1 THEN NULL ELSE team_starter_id END AS team_starter_id, opposing_starter_id
        FROM @matchups""",
    # roster snapshots of pitchers; days without one are holes
    "rosters": """
        SELECT DISTINCT CAST(ts AS DATE) AS game_date, user_id % 10 AS team, user_id AS player_id
        FROM @events WHERE event_type = 'signup' AND user_id % 3 = 0""",
    "lineups": """
        SELECT game_date, dh, team, CASE WHEN team % 2 = 0 THEN team + 1 ELSE team - 1 END AS opposing_team,
               player_id, pos AS position, CAST(1 + last_event % 9 AS BIGINT) AS batting_order
        FROM @player_game WHERE NOT (coalesce(pos, '') = 'P' AND player_id <> 19755)""",
    "position_log": """
        SELECT * FROM @player_game WHERE NOT (coalesce(pos, '') = 'P' AND player_id <> 19755)""",
    "fielding": """
        SELECT user_id + 1000 AS player_id, CAST(month(CAST(ts AS DATE)) AS BIGINT) AS month,
               CAST(count(*) AS DOUBLE) AS frv, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS DOUBLE) AS total_innings
        FROM @events WHERE event_type <> 'error' GROUP BY user_id, month(CAST(ts AS DATE))""",
    # long supplier histories
    "supplier_log": """
        SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS game_date, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
               max(l_quantity) AS value, CAST(max(l_linenumber) % 4 AS BIGINT) AS weight
        FROM @lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE), l_orderkey, l_linenumber""",
    "pred_wide": """
        SELECT game_id, game_date, season, is_winner_home AS y, is_winner_home, home_score, away_score, venue_id,
               (CAST(200 + home_score * 40 + (game_id * 91) % 200 AS DOUBLE) + 0.5) / 1000 AS p_mkt,
               (CAST(150 + home_score * 50 + (game_id * 37) % 200 AS DOUBLE) + 0.5) / 1000 AS p_m1,
               (CAST((game_id * 53) % 1000 AS DOUBLE) + 0.5) / 1000 AS p_m2,
               CASE WHEN season <= 1999 THEN 'train' WHEN season = 2000 THEN 'val' ELSE 'test' END AS split
        FROM @games""",
    "preds": """
        SELECT 'market' AS model, split, game_id, y, p_mkt AS p, p_mkt FROM @pred_wide
        UNION ALL SELECT 'm1', split, game_id, y, p_m1, p_mkt FROM @pred_wide
        UNION ALL SELECT 'm2', split, game_id, y, p_m2, p_mkt FROM @pred_wide""",
    "run_log": """
        SELECT l_suppkey AS run_id, CAST((year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS BIGINT) AS epoch,
               sum(l_quantity) / count(*) AS val_loss
        FROM @lineitem GROUP BY l_suppkey, CAST((year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS BIGINT)""",
}


def expand(text: str, base: Callable[[str], str]) -> str:
    """Replace every ``@name`` by a base table or the nested view text."""

    def put(match: re.Match) -> str:
        name = match.group(1)
        if name in VIEWS:
            return "(" + expand(VIEWS[name], base) + ")"
        if name in TABLES:
            return base(name)
        raise KeyError(name)

    return re.sub(r"@(\w+)", put, text)


def oracle(text: str) -> str:
    return expand(text, lambda name: name)


class Views:
    """DataFrames of the base tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.dir = sf_dir.rstrip("/")

    def _base(self, name: str) -> str:
        return f"parquet.`{self.dir}/{name}.parquet`"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.spark.sql(expand(VIEWS[name], self._base))
