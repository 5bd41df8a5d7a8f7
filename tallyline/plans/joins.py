"""Queries of families C, F and G: joins, de-duplication, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions.context import season_month
from tallyline.functions.market import add_market_probabilities
from tallyline.operators import asof, backtest, dedupe, history, lineups, prepare, quotes, reserve, sides
from tallyline.operators.history import Metric
from tallyline.operators.priors import league_priors
from tallyline.plans.expressions import _all_diffs, side_sql, wide_sides
from tallyline.plans.histories import _season_prior_sql, sql_rolling
from tallyline.plans.registry import query, r, tidy
from tallyline.session import bucketed, pin

PG = ["player_id", "game_date", "dh"]
_TEAM_STATS = "(SELECT game_date, dh, team, max(woba) AS woba, max(fip) AS fip FROM @player_game p WHERE pos = 'P' GROUP BY game_date, dh, team)"


@query(
    "c1_two_sided_join",
    f"""SELECT c.game_id, {r('h.woba')} AS home_woba, {r('h.fip')} AS home_starter_fip, {r('a.woba')} AS away_woba, {r('a.fip')} AS away_starter_fip FROM @club_games c
        LEFT JOIN {_TEAM_STATS} h ON c.game_date = h.game_date AND c.dh = h.dh AND c.home_team = h.team
        LEFT JOIN {_TEAM_STATS} a ON c.game_date = a.game_date AND c.dh = a.dh AND c.away_team = a.team""",
)
def c1(v):
    st = v.player_game.where("pos = 'P'").groupBy("game_date", "dh", "team").agg(F.max("woba").alias("team_woba"), F.max("fip").alias("team_starter_fip"))
    st = st.withColumn("opposing_team", F.when(F.col("team") % 2 == 0, F.col("team") + 1).otherwise(F.col("team") - 1))
    out = sides.attach_both_sides(v.club_games, st, ["team_woba", "team_starter_fip"])
    return tidy(out.drop("game_date", "dh", "home_team", "away_team"))


_SIDES = """(SELECT game_id, game_date, dh, 'away' AS side, away_team AS team FROM @club_games c UNION ALL SELECT game_id, game_date, dh, 'home', home_team FROM @club_games c)"""


@query(
    "c2_lineup_stats_join",
    f"""SELECT s.game_id, s.side, l.player_id, l.batting_order, {r('p.woba')} AS woba FROM {_SIDES} s
        LEFT JOIN @lineups l ON s.game_date = l.game_date AND s.dh = l.dh AND s.team = l.team
        LEFT JOIN (SELECT * FROM @position_log z WHERE pa > 0) p ON p.game_date = l.game_date AND p.dh = l.dh AND p.player_id = l.player_id""",
)
def c2(v):
    out = lineups.lineup_players(v.club_games, v.lineups, v.position_log.where("pa > 0"), ["woba"])
    return tidy(out.select("game_id", "side", "player_id", "batting_order", "woba"))


@query(
    "c3_monthly_attribute",
    f"""SELECT p.player_id, p.game_date, p.dh, coalesce(CASE WHEN f.total_innings = 0 THEN NULL ELSE {r('f.frv / f.total_innings * 9.0')} END, 0) AS frv_per_9 FROM @position_log p
        LEFT JOIN @fielding f ON p.mlb_id = f.player_id AND CASE WHEN month(p.game_date) = 3 THEN 4 WHEN month(p.game_date) = 10 THEN 9 ELSE month(p.game_date) END = f.month""",
)
def c3(v):
    return tidy(monthly_rate(v.position_log, v.fielding).select(*PG, "frv_per_9"))


def monthly_rate(log, fielding):
    """Player rows with the month's fielding rate, 0 where unknown. One row per player and month."""
    rate = F.try_divide(F.col("frv"), F.col("total_innings")) * 9.0
    right = fielding.select(F.col("player_id").alias("mlb_id"), F.col("month").cast("int").alias("month"), rate.alias("frv_per_9"))
    joined = log.withColumn("month", season_month("game_date")).join(right, ["mlb_id", "month"], "left")
    return joined.select(*log.columns, F.coalesce("frv_per_9", F.lit(0.0)).alias("frv_per_9"))


@query(
    "c4_own_and_opposing_starter",
    f"""SELECT m.game_date, m.dh, m.team, m.opposing_team, {r('a.fip')} AS team_starter_fip, {r('a.era')} AS team_starter_era, {r('b.fip')} AS opposing_team_starter_fip FROM @matchups m
        LEFT JOIN (SELECT * FROM @player_game x WHERE gs = 1) a ON m.game_date = a.game_date AND m.dh = a.dh AND m.team_starter_id = a.player_id
        LEFT JOIN (SELECT * FROM @player_game x WHERE gs = 1) b ON m.game_date = b.game_date AND m.dh = b.dh AND m.opposing_starter_id = b.player_id AND m.opposing_team = b.team""",
)
def c4(v):
    return tidy(starter_pair(v.matchups, v.player_game.where("gs = 1"), ["fip", "era"]).drop("opposing_team_starter_era", "team_starter_id", "opposing_starter_id"))


def starter_pair(matchups, stats, cols):
    """Own and opposing starter stats of each match-up."""
    own = stats.select("game_date", "dh", F.col("player_id").alias("team_starter_id"), *[F.col(c).alias(f"team_starter_{c}") for c in cols])
    opp = stats.select(
        "game_date", "dh", F.col("player_id").alias("opposing_starter_id"), F.col("team").alias("opposing_team"),
        *[F.col(c).alias(f"opposing_team_starter_{c}") for c in cols],
    )
    return matchups.join(own, ["game_date", "dh", "team_starter_id"], "left").join(
        opp, ["game_date", "dh", "opposing_starter_id", "opposing_team"], "left"
    )


@query(
    "c5_mirror_fill",
    """SELECT a.game_date, a.dh, a.team, coalesce(a.team_starter_id, b.opposing_starter_id) AS team_starter_id FROM @gap_matchups a
       LEFT JOIN (SELECT * FROM @gap_matchups g WHERE team_starter_id IS NOT NULL) b ON a.game_date = b.game_date AND a.dh = b.dh AND a.team = b.opposing_team""",
)
def c5(v):
    return asof.mirror_fill(v.gap_matchups).select("game_date", "dh", "team", "team_starter_id")


@query(
    "c6_appearance_roles",
    """SELECT p.player_id, p.game_date, p.dh, CASE WHEN m.team_starter_id = p.player_id THEN 1 ELSE 0 END AS is_starter,
         CASE WHEN m.team_starter_id = p.player_id AND o.share < 0.25 THEN 1 ELSE 0 END AS is_opener FROM @matchups m
       JOIN (SELECT * FROM @player_game z WHERE pos = 'P') p ON m.game_date = p.game_date AND m.dh = p.dh AND m.team = p.team
       JOIN (SELECT player_id, sum(gs) / CAST(sum(games) AS DOUBLE) AS share FROM @player_game z WHERE pos = 'P' GROUP BY player_id) o ON o.player_id = p.player_id""",
)
def c6(v):
    rows = reserve.classify_appearances(v.matchups, v.player_game.where("pos = 'P'"))
    return tidy(reserve.classify_openers(rows).select(*PG, "is_starter", "is_opener"))


_ASOF = """(SELECT r.game_date, r.team, r.player_id, s.dh AS last_dh, s.game_date AS stat_date, s.fip FROM {left} r
   LEFT JOIN LATERAL (SELECT * FROM @player_game z WHERE z.player_id = r.player_id AND z.game_date < r.game_date ORDER BY z.game_date DESC, z.dh DESC LIMIT 1) s ON TRUE)"""


@query(
    "c7_strict_asof_join",
    f"SELECT game_date, team, player_id, last_dh, stat_date, {r('fip')} AS fip FROM {_ASOF.format(left='@rosters')} x",
)
def c7(v):
    stats = v.player_game.select("player_id", "game_date", F.col("dh").alias("last_dh"), F.col("game_date").alias("stat_date"), "fip")
    return tidy(asof.asof_before(v.rosters, stats, ["player_id"], "game_date", ["last_dh", "stat_date", "fip"], ["last_dh"]))


_WANT = "(SELECT DISTINCT game_date, team, team_starter_id FROM @matchups m)"
_FILL = f"""(SELECT w.game_date, w.team, w.team_starter_id, r.player_id FROM
    (SELECT w.*, (SELECT max(game_date) FROM @rosters r WHERE r.team = w.team AND r.game_date < w.game_date) AS src FROM {_WANT} w
     WHERE NOT EXISTS (SELECT 1 FROM @rosters r WHERE r.team = w.team AND r.game_date = w.game_date)) w JOIN @rosters r ON r.team = w.team AND r.game_date = w.src)"""


@query("c8_roster_forward_fill", f"SELECT * FROM {_FILL} f")
def c8(v):
    want = v.matchups.select("game_date", "team", "team_starter_id").distinct()
    return asof.forward_fill_groups(v.rosters, want, ["team"], "game_date", ["team_starter_id"])


@query(
    "c9_reserve_exclusion",
    f"SELECT r.game_date, r.team, r.player_id FROM @rosters r LEFT JOIN {_WANT} w ON r.game_date = w.game_date AND r.team = w.team WHERE coalesce(r.player_id <> w.team_starter_id, TRUE)",
)
def c9(v):
    want = v.matchups.select("game_date", "team", "team_starter_id").distinct()
    return reserve.exclude_starter(v.rosters.join(want, ["game_date", "team"], "left")).select("game_date", "team", "player_id")


_ON4 = "g.game_date = q.game_date AND g.game_datetime = q.game_datetime AND g.away_team = q.away_team AND g.home_team = q.home_team"
_ON3 = "g.game_date = q.game_date AND g.away_team = q.away_team AND g.home_team = q.home_team"


@query("c10_exact_quote_match", f"SELECT g.game_id, g.dh, q.sportsbook, q.quote_id FROM @games g JOIN @quotes q ON {_ON4}")
def c10(v):
    return quotes.exact_matches(v.games, v.quotes).select("game_id", "dh", "sportsbook", "quote_id")


@query("c11_unmatched_quotes", f"SELECT q.true_game_id, q.sportsbook, q.quote_id FROM @quotes q WHERE NOT EXISTS (SELECT 1 FROM @games g WHERE {_ON4})")
def c11(v):
    return quotes.unmatched(v.quotes, quotes.exact_matches(v.games, v.quotes)).select("true_game_id", "sportsbook", "quote_id")


_NEAR = f"""(SELECT q.*, g.game_id, g.dh, g.game_datetime = q.game_datetime AS exact FROM (SELECT *, row_number() OVER () AS rid FROM @quotes q0) q JOIN @games g ON {_ON3}
   QUALIFY row_number() OVER (PARTITION BY q.rid ORDER BY abs(epoch(g.game_datetime) - epoch(q.game_datetime)), g.dh, g.game_id) = 1)"""


@query(
    "c12_nearest_in_time",
    f"SELECT true_game_id, sportsbook, quote_id, game_id, dh FROM {_NEAR} n WHERE NOT exact",
)
def c12(v):
    # asked for its times and for its rows: stored, the quotes are read and joined once
    late = pin(quotes.unmatched(v.quotes, v.games).select("true_game_id", "sportsbook", "quote_id", *quotes.QUOTE_KEY), "late-quotes")
    offers = v.games.select("game_date", "away_team", "home_team", "game_datetime", "dh", "game_id")
    out = asof.nearest_in_time(late, offers, ["game_date", "away_team", "home_team"], "game_datetime", ["game_id", "dh"], "dh")
    return out.select("true_game_id", "sportsbook", "quote_id", "game_id", "dh")


_LONG = f"""(SELECT * FROM {_NEAR} n QUALIFY row_number() OVER (PARTITION BY game_date, away_team, home_team, sportsbook
     ORDER BY exact DESC, game_datetime, game_id, quote_id) = 1)"""
_BOOKS = """(SELECT game_date, game_datetime, away_team, home_team, count(*) AS num_books, median(home_opening_prob_nv) AS med,
     coalesce(stddev_samp(ln(greatest(least(home_opening_prob_nv, 1 - 1e-6), 1e-16) / (1 - greatest(least(home_opening_prob_nv, 1 - 1e-6), 1e-16)))), 0) AS disp,
     arg_min(vig_open, struct_pack(a := sportsbook, b := vig_open)) AS vig FROM @quote_probs q GROUP BY ALL)"""


@query(
    "c13_reconciliation",
    f"""SELECT f.game_id, f.dh, b.num_books, {r('b.med')} AS p_open_home_median_nv, {r('b.disp')} AS logit_prob_home_std_nv, {r('b.vig')} AS vig_open
        FROM (SELECT * FROM {_LONG} l QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY exact DESC, sportsbook, quote_id) = 1) f
        JOIN {_BOOKS} b ON f.game_date = b.game_date AND f.game_datetime = b.game_datetime AND f.away_team = b.away_team AND f.home_team = b.home_team""",
)
def c13(v):
    wide, _ = quotes.reconcile(v.games, add_market_probabilities(v.quotes))
    return tidy(wide.select("game_id", "dh", "num_books", "p_open_home_median_nv", "logit_prob_home_std_nv", "vig_open"))


@query("c13_long_quotes", f"SELECT game_id, dh, sportsbook, quote_id FROM {_LONG} l")
def c13b(v):
    _, long = quotes.reconcile(v.games, add_market_probabilities(v.quotes), long_columns=["game_id", "dh", "sportsbook", "quote_id"])
    return long


@query(
    "c14_column_agreement",
    """WITH j AS (SELECT g.season AS a1, q.season AS b1, g.home_team AS a2, q.home_team AS b2, g.game_date AS a3, q.game_date AS b3 FROM @quotes q JOIN @games g ON q.true_game_id = g.game_id)
       SELECT 'season' AS column_name, count(*) FILTER (a1 IS DISTINCT FROM b1) AS mismatches, count(*) AS n_rows FROM j
       UNION ALL SELECT 'home_team', count(*) FILTER (a2 IS DISTINCT FROM b2), count(*) FROM j
       UNION ALL SELECT 'game_date', count(*) FILTER (a3 IS DISTINCT FROM b3), count(*) FROM j""",
)
def c14(v):
    g = v.games.select(F.col("game_id").alias("true_game_id"), "season", "home_team", "game_date")
    q = v.quotes.select("true_game_id", *[F.col(c).alias(f"q_{c}") for c in ("season", "home_team", "game_date")])
    return quotes.agreement_report(q.join(g, "true_game_id"), [(c, f"q_{c}") for c in ("season", "home_team", "game_date")])


@query(
    "c15_match_summary",
    f"""WITH s AS (SELECT DISTINCT game_date, away_team, home_team FROM @games g), q AS (SELECT DISTINCT game_date, away_team, home_team FROM @quotes z),
        m AS (SELECT q.* FROM q SEMI JOIN s USING (game_date, away_team, home_team))
      SELECT (SELECT count(*) FROM s) AS schedule_games, (SELECT count(*) FROM q) AS quoted_games, (SELECT count(*) FROM m) AS matched_games,
        {r('(SELECT count(*) FROM m) * 100.0 / (SELECT count(*) FROM q)')} AS match_rate""",
)
def c15(v):
    return tidy(quotes.match_summary(v.games, v.quotes, quotes.match_quote_times(v.games, v.quotes)))


@query(
    "c16_dimension_default",
    "SELECT w.game_id, coalesce(p.park_factor, 100) AS park_factor FROM @weather w LEFT JOIN @parks p ON w.venue_id = p.venue_id",
)
def c16(v):
    return park_lookup(v.weather, v.parks).select("game_id", "park_factor")


def park_lookup(games, parks):
    """Park factor of the venue, 100 where unknown.

    No hint: the planner broadcasts the venues while they are small and sorts both sides beyond.
    """
    return games.join(parks.select("venue_id", "park_factor"), "venue_id", "left").withColumn(
        "park_factor", F.coalesce("park_factor", F.lit(100))
    )


_C17 = f"""SELECT c.game_id, c.home_team, t.fip AS home_fip_max, o.n AS players, x.n AS quotes FROM @club_games c
        LEFT JOIN (SELECT game_date, dh, team, {r('max(fip)')} AS fip FROM @player_game p GROUP BY 1, 2, 3) t ON c.game_date = t.game_date AND c.dh = t.dh AND c.home_team = t.team
        LEFT JOIN (SELECT game_date, dh, count(*) AS n FROM @player_game p GROUP BY 1, 2) o ON c.game_date = o.game_date AND c.dh = o.dh
        LEFT JOIN (SELECT game_date, dh, team, count(*) AS n FROM @lineups l GROUP BY 1, 2, 3) x ON c.game_date = x.game_date AND c.dh = x.dh AND c.home_team = x.team"""


@query("c17_keyed_multi_join", _C17)
def c17(v):
    """Feature blocks are aggregated to the game key first and then joined on it."""
    fip = v.player_game.groupBy("game_date", "dh", F.col("team").alias("home_team")).agg(F.max("fip").alias("home_fip_max"))
    players = v.player_game.groupBy("game_date", "dh").agg(F.count(F.lit(1)).alias("players"))
    listed = v.lineups.groupBy("game_date", "dh", F.col("team").alias("home_team")).agg(F.count(F.lit(1)).alias("quotes"))
    out = v.club_games.join(fip, ["game_date", "dh", "home_team"], "left").join(listed, ["game_date", "dh", "home_team"], "left").join(players, ["game_date", "dh"], "left")
    return tidy(out.select("game_id", "home_team", "home_fip_max", "players", "quotes"))


@query("c17_bucketed_blocks", _C17)
def c17_buckets(v):
    """The same blocks, stored in buckets of the game key; only the one with a shorter key is dealt out anew."""
    key = ["game_date", "dh", "home_team"]
    store = bucketed(key)
    games = store(v.club_games, "games")
    fip = store(v.player_game.groupBy("game_date", "dh", F.col("team").alias("home_team")).agg(F.max("fip").alias("home_fip_max")), "fip")
    listed = store(v.lineups.groupBy("game_date", "dh", F.col("team").alias("home_team")).agg(F.count(F.lit(1)).alias("quotes")), "listed")
    players = v.player_game.groupBy("game_date", "dh").agg(F.count(F.lit(1)).alias("players"))
    out = games.join(fip, key, "left").join(listed, key, "left").join(players, ["game_date", "dh"], "left")
    return tidy(out.select("game_id", "home_team", "home_fip_max", "players", "quotes"))


@query(
    "c18_team_block_single_pass",
    """SELECT season, team, count(*) AS n_rows, CAST(sum(gp) AS BIGINT) AS sum_gp, CAST(sum(rd) AS BIGINT) AS sum_run_diff, CAST(sum(wins) AS BIGINT) AS sum_wins FROM (
         SELECT season, team, row_number() OVER w - 1 AS gp, coalesce(sum(team_score - opposing_team_score) OVER p, 0) AS rd, coalesce(sum(is_winner) OVER p, 0) AS wins FROM @team_log t
         WINDOW w AS (PARTITION BY season, team ORDER BY game_date, dh, game_datetime, game_id),
                p AS (PARTITION BY season, team ORDER BY game_date, dh, game_datetime, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x GROUP BY season, team""",
)
def c18(v):
    """Win, run and games-played state of a team from one window instead of joined blocks."""
    rows = sides.team_rows(v.games)
    out = history.running_state(
        rows, ["season", "team"], ["game_date", "dh", "game_datetime", "game_id"],
        sums={"rd": "team_score - opposing_team_score", "wins": "is_winner"},
    )
    return out.groupBy("season", "team").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("seq").alias("sum_gp"),
        F.coalesce(F.sum("rd"), F.lit(0)).cast("long").alias("sum_run_diff"), F.coalesce(F.sum("wins"), F.lit(0)).cast("long").alias("sum_wins"),
    )


@query(
    "c19_side_repivot",
    """SELECT game_id, max(CASE WHEN is_home = 1 THEN team END) AS home_team, max(CASE WHEN is_home = 0 THEN team END) AS away_team,
         max(CASE WHEN is_home = 1 THEN team_score END) AS home_team_score, max(CASE WHEN is_home = 0 THEN team_score END) AS away_team_score FROM @team_log t GROUP BY game_id""",
)
def c19(v):
    return sides.collapse_sides(sides.team_rows(v.games), ["game_id"], ["team_score"])


def _slot_sql():
    cols = []
    for s in ("away", "home"):
        for n in range(1, 10):
            at = f"side = '{s}' AND batting_order = {n}"
            cols += [f"max(CASE WHEN {at} THEN {c} END) AS {s}_batter_{n}_{c}" for c in ("woba_season", "iso_season")]
            cols.append(f"1 - max(CASE WHEN {at} AND (woba_season IS NOT NULL OR iso_season IS NOT NULL) THEN 1 ELSE 0 END) AS {s}_batter_{n}_is_missing_player")
    return f"""SELECT game_id, {', '.join(cols)} FROM (
       SELECT s.game_id, s.side, l.batting_order, {r('p.woba')} AS woba_season, {r('p.iso')} AS iso_season FROM {_SIDES} s
       LEFT JOIN (SELECT * FROM @lineups z QUALIFY row_number() OVER (PARTITION BY game_date, dh, team, batting_order ORDER BY player_id) = 1) l
         ON s.game_date = l.game_date AND s.dh = l.dh AND s.team = l.team
       LEFT JOIN (SELECT * FROM @position_log z WHERE pa > 1) p ON p.game_date = l.game_date AND p.dh = l.dh AND p.player_id = l.player_id) x GROUP BY game_id"""


@query("c20_slot_pivot", _slot_sql())
def c20(v):
    return tidy(_slots(v).drop("game_date", "dh", "home_team", "away_team"))


def _slots(v):
    stats = v.position_log.where("pa > 1").select(*PG, F.col("woba").alias("woba_season"), F.col("iso").alias("iso_season"))
    rows = lineups.lineup_players(v.club_games, v.lineups, stats, ["woba_season", "iso_season"])
    return lineups.slot_vectors(rows, ["woba_season", "iso_season"])


def _starter_wide(v):
    st = v.player_game.where("gs = 1").groupBy("game_date", "dh", "team").agg(
        F.max("fip").alias("team_starter_fip_season"), F.max("player_id").alias("team_starter_player_id"))
    st = st.withColumn("opposing_team", F.when(F.col("team") % 2 == 0, F.col("team") + 1).otherwise(F.col("team") - 1))
    return sides.attach_both_sides(v.club_games, st, ["team_starter_fip_season", "team_starter_player_id"])


_STARTS = "(SELECT game_date, dh, team, max(fip) AS fip FROM @player_game p WHERE gs = 1 GROUP BY 1, 2, 3)"


@query(
    "c21_starter_vectors",
    f"""SELECT c.game_id, {r('a.fip')} AS away_starter_vec_fip_season, CASE WHEN a.fip IS NULL THEN 1 ELSE 0 END AS away_starter_vec_is_missing_starter,
          {r('h.fip')} AS home_starter_vec_fip_season, CASE WHEN h.fip IS NULL THEN 1 ELSE 0 END AS home_starter_vec_is_missing_starter FROM @club_games c
        LEFT JOIN {_STARTS} h ON c.game_date = h.game_date AND c.dh = h.dh AND c.home_team = h.team
        LEFT JOIN {_STARTS} a ON c.game_date = a.game_date AND c.dh = a.dh AND c.away_team = a.team""",
)
def c21(v):
    return tidy(lineups.starter_vectors(_starter_wide(v)).drop("game_date", "dh", "home_team", "away_team"))


@query(
    "c22_vector_alignment",
    """SELECT game_id, f.focal AS focal_is_home, CASE WHEN f.focal = 1 THEN home_score ELSE away_score END AS home_batter_1_x,
         CASE WHEN f.focal = 1 THEN away_score ELSE home_score END AS away_batter_1_x FROM @games g, (SELECT CAST(unnest([0, 1]) AS BIGINT) AS focal) f""",
)
def c22(v):
    vectors = v.games.select("game_id", F.col("home_score").alias("home_batter_1_x"), F.col("away_score").alias("away_batter_1_x"))
    table = v.games.select("game_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("focal_is_home"))
    return tidy(lineups.align_vectors(table, vectors, ["game_id"]))


@query(
    "c23_prediction_quote_join",
    f"SELECT q.true_game_id AS game_id, q.sportsbook, q.quote_id, {r('p.p_m1')} AS p_home FROM @quotes q LEFT JOIN (SELECT * FROM @pred_wide z WHERE split <> 'train') p ON q.true_game_id = p.game_id",
)
def c23(v):
    pred = v.pred_wide.where("split <> 'train'").select("game_id", F.col("p_m1").alias("p_home"))
    q = v.quotes.select(F.col("true_game_id").alias("game_id"), "sportsbook", "quote_id")
    return tidy(backtest.attach_predictions(q, pred, validate=True).select("game_id", "sportsbook", "quote_id", "p_home"))


@query(
    "c24_index_contract",
    """SELECT coalesce(a.true_game_id, b.game_id) AS game_id, coalesce(a.n, 0) AS n_predicted, CASE WHEN b.game_id IS NULL THEN CAST(0 AS BIGINT) ELSE 1 END AS n_expected
       FROM (SELECT true_game_id, count(*) AS n FROM @quotes q GROUP BY 1) a FULL JOIN @games b ON a.true_game_id = b.game_id WHERE coalesce(a.n, 0) <> 1 OR b.game_id IS NULL""",
)
def c24(v):
    """Quotes are not one per game, so the contract reports the games that break it."""
    return prepare.index_contract(v.quotes.select(F.col("true_game_id").alias("game_id")), v.games.select("game_id"), ["game_id"])


def _c25_sql():
    return f"SELECT s.*, v.* EXCLUDE (game_id) FROM ({_slot_sql()}) s JOIN (SELECT c.game_id, {r('a.fip')} AS away_starter_vec_fip_season, CASE WHEN a.fip IS NULL THEN 1 ELSE 0 END AS away_starter_vec_is_missing_starter, {r('h.fip')} AS home_starter_vec_fip_season, CASE WHEN h.fip IS NULL THEN 1 ELSE 0 END AS home_starter_vec_is_missing_starter FROM @club_games c LEFT JOIN {_STARTS} h ON c.game_date = h.game_date AND c.dh = h.dh AND c.home_team = h.team LEFT JOIN {_STARTS} a ON c.game_date = a.game_date AND c.dh = a.dh AND c.away_team = a.team) v ON s.game_id = v.game_id"


@query("c25_structured_assembly", _c25_sql())
def c25(v):
    out = _slots(v).join(lineups.starter_vectors(_starter_wide(v)), list(sides.GAME_KEY), "left")
    return tidy(out.drop("game_date", "dh", "home_team", "away_team"))


@query(
    "c26_duplicate_matches",
    f"SELECT game_date, away_team, home_team, sportsbook, dh, count(*) AS n_rows FROM {_NEAR} n GROUP BY ALL HAVING count(*) > 1",
)
def c26(v):
    links = quotes.match_quote_times(v.games, v.quotes).select(*quotes.QUOTE_KEY, "dh")
    return dedupe.duplicate_groups(v.quotes.join(links, list(quotes.QUOTE_KEY)), ["game_date", "away_team", "home_team", "sportsbook", "dh"])


@query(
    "f3_keep_first",
    """SELECT game_date, away_team, home_team, sportsbook, quote_id FROM @quotes q
       QUALIFY row_number() OVER (PARTITION BY game_date, away_team, home_team, sportsbook ORDER BY game_datetime, quote_id) = 1""",
)
def f3(v):
    q = v.quotes.select("game_date", "away_team", "home_team", "sportsbook", "game_datetime", "quote_id")
    return dedupe.keep_first(q, ["game_date", "away_team", "home_team", "sportsbook"], ["game_datetime", "quote_id"]).drop("game_datetime")


@query(
    "f4_top_gain",
    f"SELECT feature, {r('gain')} AS gain, {r('gain / total * 100')} AS gain_pct, rank FROM (SELECT feature, gain, sum(gain) OVER () AS total, row_number() OVER (ORDER BY gain DESC, feature) AS rank"
    " FROM (SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS feature, sum(l_quantity) AS gain FROM @lineitem l GROUP BY 1) a) b WHERE rank <= 20",
)
def f4(v):
    from tallyline.operators.evaluate import top_importances

    gains = v.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("feature")).agg(F.sum("l_quantity").alias("gain"))
    return tidy(top_importances(gains, 20))


@query(
    "f5_ordered_output",
    "SELECT split, game_id, row_number() OVER (PARTITION BY split ORDER BY season, game_date, game_id) - 1 AS pos FROM @pred_wide p",
)
def f5(v):
    """Canonical order as explicit positions (a sink would sort by the same key)."""
    from tallyline.operators.ordering import row_positions

    return row_positions(v.pred_wide.select("split", "season", "game_date", "game_id"), "game_date", ["game_id"], ["split"]).select("split", "game_id", "pos")


@query("g1_team_rows", "SELECT game_id, is_home, team, opposing_team, team_score, opposing_team_score, CAST(is_winner AS BIGINT) AS is_winner FROM @team_log t")
def g1(v):
    return tidy(sides.team_rows(v.games).select("game_id", "is_home", "team", "opposing_team", "team_score", "opposing_team_score", "is_winner"))


_G2M = (Metric("woba", "woba", "pa", 100),)


@query(
    "g2_all_seasons",
    sql_rolling(_season_prior_sql("@player_game", _G2M), "player_id, season", "game_date, dh", _G2M, (4,), "player_id, season, game_date, dh", "prior_{m}"),
)
def g2(v):
    """Several seasons in one plan: the season is part of the window key."""
    log = v.player_game
    log = log.join(F.broadcast(league_priors(log, _G2M, ["season"])), "season")
    out = history.rolling_rates(log, ["player_id", "season"], ["game_date", "dh"], _G2M, (4,), keep=["player_id", "season", "game_date", "dh"], date=None)
    return tidy(out.drop("seq"))


@query(
    "g3_matched_union",
    f"""SELECT game_id, sportsbook, quote_id, CASE WHEN exact THEN 1 ELSE 0 END AS exact FROM {_NEAR} n""",
)
def g3(v):
    exact = quotes.exact_matches(v.games, v.quotes).select("game_id", "sportsbook", "quote_id", F.lit(1).alias("exact"))
    late = quotes.unmatched(v.quotes, v.games)
    offers = v.games.select("game_date", "away_team", "home_team", "game_datetime", "dh", "game_id")
    near = asof.nearest_in_time(late, offers, ["game_date", "away_team", "home_team"], "game_datetime", ["game_id", "dh"], "dh")
    return tidy(exact.unionByName(near.select("game_id", "sportsbook", "quote_id").withColumn("exact", F.lit(0)), allowMissingColumns=True))


def _g4_side(flip):
    y = "1 - is_winner_home" if flip else "is_winner_home"
    p = "CAST(game_id % 100 AS DOUBLE) / 128"
    p = f"1 - {p}" if flip else p
    return f"""SELECT game_id, CAST({y} AS BIGINT) AS is_winner_home, home_team, {p} AS p_open_home_median_nv, CAST({0 if flip else 1} AS BIGINT) AS focal_is_home,
       {side_sql('home', 'woba', 'season', flip)} AS home_woba_season, {side_sql('away', 'woba', 'season', flip)} AS away_woba_season,
       CAST(home_score AS DOUBLE) AS homegrown_metric, {_all_diffs(flip)} FROM @games g"""


@query("g4_perspective_duplication", f"{_g4_side(False)} UNION ALL {_g4_side(True)}")
def g4(v):
    out = sides.duplicate_perspective(wide_sides(v), batter=(4,), starter=(3,), reliever=(8,), team=(3,))
    keep = ["game_id", "is_winner_home", "home_team", "p_open_home_median_nv", "focal_is_home", "home_woba_season", "away_woba_season", "homegrown_metric"]
    return tidy(out.select(*keep, *[c for c in out.columns if c.endswith("_diff")]), skip=[c for c in out.columns])


@query(
    "g5_date_difference",
    """SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM @lineitem l WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT game_date FROM @games g)""",
)
def g5(v):
    """Shipping days without a game."""
    wanted = v.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct()
    return wanted.join(v.games.select(F.col("game_date").alias("day")).distinct(), "day", "left_anti")
