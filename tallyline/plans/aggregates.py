"""Queries of family D: weighted means, priors, consensus, league averages, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions.market import add_market_probabilities
from tallyline.functions.numeric import one_row
from tallyline.operators import backtest, boosting, dedupe, evaluate, league, lineups, metrics, prepare, priors, quotes, reserve
from tallyline.operators.history import Metric
from tallyline.operators.selection import medians
from tallyline.plans.registry import query, r, tidy

WOBA = Metric("woba", "woba", "pa", 100)
OPS = Metric("ops", "ops", "pa", 100)
ISO = Metric("iso", "iso", "ab", 100)
FLOORS = {"pa": 20, "ab": 15}


def wmean(val, w, where="TRUE"):
    return (f"sum(CASE WHEN {where} THEN coalesce({val}, 0.0) * coalesce({w}, 0) END) / "
            f"CASE WHEN sum(CASE WHEN {where} THEN coalesce({w}, 0) END) > 0 THEN CAST(sum(CASE WHEN {where} THEN coalesce({w}, 0) END) AS DOUBLE) END")


@query("d1_weighted_mean", f"SELECT team, {r(wmean('woba', 'pa'))} AS woba, {r(wmean('ops', 'pa'))} AS ops FROM @player_game p GROUP BY team")
def d1(v):
    return tidy(v.player_game.groupBy("team").agg(priors.weighted_mean("woba", "pa").alias("woba"), priors.weighted_mean("ops", "pa").alias("ops")))


def floored(val, w, floor, where="TRUE"):
    s = f"sum(CASE WHEN {where} THEN coalesce({w}, 0) END)"
    return f"CASE WHEN {s} >= {floor} AND {s} <> 0 THEN {r(f'sum(CASE WHEN {where} THEN coalesce({val}, 0.0) * coalesce({w}, 0) END) / CAST({s} AS DOUBLE)')} END"


@query(
    "d2_entity_prior",
    f"""SELECT player_id, {floored('woba', 'pa', 20)} AS own_woba, {floored('ops', 'pa', 20)} AS own_ops, {floored('iso', 'ab', 15)} AS own_iso
        FROM @player_game p WHERE season = 1 GROUP BY player_id""",
)
def d2(v):
    return tidy(priors.entity_priors(v.player_game.where("season = 1"), (WOBA, OPS, ISO), FLOORS, ["player_id"]))


_PITCH = (Metric("fip", "fip", "ip", 20), Metric("era", "era", "ip", 30))
_IPF = {"ip": 12}


@query(
    "d3_tiered_priors",
    f"""WITH prev AS (SELECT * FROM @player_game p WHERE season = 1), cur AS (SELECT * FROM @player_game p WHERE season = 2 AND gs = 1),
        own AS (SELECT player_id, {floored('fip', 'ip', 12, 'gs > 0')} AS o_fip, {floored('fip', 'ip', 12)} AS a_fip,
                  {floored('era', 'ip', 12, 'gs > 0')} AS o_era, {floored('era', 'ip', 12)} AS a_era FROM prev GROUP BY player_id),
        lp AS (SELECT {wmean('fip', 'ip', 'gs > 0')} AS l_fip, {wmean('era', 'ip', 'gs > 0')} AS l_era FROM prev),
        lc AS (SELECT {wmean('fip', 'ip')} AS c_fip, {wmean('era', 'ip')} AS c_era FROM cur)
      SELECT cur.player_id, game_date, dh, {r('coalesce(o_fip, a_fip, l_fip, c_fip)')} AS prior_fip, {r('coalesce(o_era, a_era, l_era, c_era)')} AS prior_era
      FROM cur LEFT JOIN own ON cur.player_id = own.player_id, lp, lc""",
)
def d3(v):
    log = v.player_game
    prev, cur = log.where("season = 1"), log.where("season = 2 AND gs = 1")
    own = priors.role_priors(prev, _PITCH, _IPF, ["player_id"], "gs > 0")
    out = priors.resolve_priors(
        cur.select("player_id", "game_date", "dh"), _PITCH, ["player_id"], own,
        one_row(priors.role_or_all(prev, "gs > 0", _PITCH)),
        one_row(priors.league_priors(cur, _PITCH, prefix="league_")), ("own_", "any_"),
    )
    return tidy(out)


@query(
    "d4_role_populations",
    f"""SELECT 'starter' AS role, {r(wmean('fip', 'ip', 'gs > 0'))} AS league_fip, {r(wmean('era', 'ip', 'gs > 0'))} AS league_era FROM @player_game p WHERE season = 1
        UNION ALL SELECT 'reliever', {r(wmean('fip', 'ip', 'gs = 0'))}, {r(wmean('era', 'ip', 'gs = 0'))} FROM @player_game p WHERE season = 1
        UNION ALL SELECT 'nobody', {r(wmean('fip', 'ip'))}, {r(wmean('era', 'ip'))} FROM @player_game p WHERE season = 1""",
)
def d4(v):
    """A role without rows falls back to the whole population."""
    prev = v.player_game.where("season = 1")
    roles = {"starter": "gs > 0", "reliever": "gs = 0", "nobody": "gs > 9"}
    parts = [priors.role_or_all(prev, c, _PITCH).select(F.lit(n).alias("role"), "*") for n, c in roles.items()]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_LC = ["woba", "ops"]


@query(
    "d5_lineup_means",
    f"""WITH st AS (SELECT * FROM @position_log p WHERE pa > 0), med AS (SELECT median(woba) AS mw, median(ops) AS mo FROM st),
      sides AS (SELECT game_id, game_date, dh, home_team, away_team, 'away' AS side, away_team AS team, home_team AS opp FROM @club_games c
        UNION ALL SELECT game_id, game_date, dh, home_team, away_team, 'home', home_team, away_team FROM @club_games c),
      x AS (SELECT s.*, coalesce(st.woba, mw) AS w, coalesce(st.ops, mo) AS o FROM sides s LEFT JOIN @lineups l ON s.game_date = l.game_date AND s.dh = l.dh
        AND s.team = l.team AND s.opp = l.opposing_team LEFT JOIN st ON l.game_date = st.game_date AND l.dh = st.dh AND l.player_id = st.player_id, med)
      SELECT game_id, game_date, dh, home_team, away_team, {r("avg(CASE WHEN side = 'away' THEN w END)")} AS away_woba, {r("avg(CASE WHEN side = 'home' THEN w END)")} AS home_woba,
        {r("avg(CASE WHEN side = 'away' THEN o END)")} AS away_ops, {r("avg(CASE WHEN side = 'home' THEN o END)")} AS home_ops FROM x GROUP BY ALL""",
)
def d5(v):
    stats = v.position_log.where("pa > 0")
    rows = lineups.lineup_players(v.club_games, v.lineups, stats, _LC)
    found = v.spark.createDataFrame([tuple(medians(stats, _LC).values())], ", ".join(f"{c} double" for c in _LC))
    return tidy(lineups.side_means(rows, _LC, one_row(found)))


@query(
    "d6_reserve_means",
    f"SELECT game_date, team, {r('avg(fip)')} AS team_pen_fip, {r('avg(wpa_li)')} AS team_pen_wpa_li FROM @player_game p WHERE gs = 0 GROUP BY game_date, team",
)
def d6(v):
    return tidy(reserve.group_means(v.player_game.where("gs = 0"), ["game_date", "team"], ["fip", "wpa_li"]))


_REST = "coalesce(game_date - last_app_date, 4)"


@query(
    "d7_reserve_availability",
    f"""WITH a AS (SELECT *, lag(game_date) OVER (PARTITION BY player_id ORDER BY game_date, dh) AS last_app_date FROM @player_game p),
        b AS (SELECT *, CAST({_REST} AS DOUBLE) AS rest, greatest(least({_REST}, 3), 0) / 3.0 AS fresh, gmli AS w FROM a WHERE gs = 0),
        c AS (SELECT *, sum(w) OVER (PARTITION BY game_date, team) AS sw, count(*) OVER (PARTITION BY game_date, team) AS n FROM b),
        d AS (SELECT *, CASE WHEN sw > 0 THEN w / sw ELSE 1.0 / n END AS wn FROM c)
      SELECT game_date, team, {r('avg(rest)')} AS team_pen_rest_days_mean, {r('median(rest)')} AS team_pen_rest_days_median, {r('avg(fresh)')} AS team_pen_freshness_mean,
        {r('sum(fresh * wn)')} AS team_pen_freshness_gmliw, {r('sum(CASE WHEN rest >= 1 THEN wn ELSE 0 END)')} AS team_pen_hi_lev_available FROM d GROUP BY game_date, team""",
)
def d7(v):
    from tallyline.operators.history import running_state

    log = running_state(v.player_game, ["player_id"], ["game_date", "dh"], latest={"last_app_date": "game_date"})
    return tidy(reserve.availability(log.where("gs = 0"), ["game_date", "team"], "gmli"))


@query(
    "d8_prior_fill",
    f"""SELECT player_id, game_date, dh, {r('coalesce(ops, m)')} AS team_pen_ops_season, {r('coalesce(wpa_li, 1.5)')} AS team_pen_wpa_li_ewm_h3, CASE WHEN gs = 0 THEN {r('fip')} END AS starter_fip
        FROM @player_game p, (SELECT {wmean('ops', 'pa')} AS m FROM @player_game p) x""",
)
def d8(v):
    df = v.player_game.select(
        "player_id", "game_date", "dh", F.col("ops").alias("team_pen_ops_season"), F.col("wpa_li").alias("team_pen_wpa_li_ewm_h3"),
        F.when(F.col("gs") == 0, F.col("fip")).alias("starter_fip"),
    )
    df = df.withColumn("league_ops", v.player_game.agg(priors.weighted_mean("ops", "pa")).scalar())
    return tidy(reserve.fill_with_priors(df, {"ops": "league_ops", "wpa_li": "1.5D"}).drop("league_ops"))


@query(
    "d9_opener_flags",
    "SELECT player_id, CASE WHEN sum(gs) / CAST(sum(games) AS DOUBLE) < 0.25 THEN 1 ELSE 0 END AS is_opener_flag FROM @player_game p GROUP BY player_id",
)
def d9(v):
    return tidy(reserve.opener_flags(v.player_game))


_NV = "home_opening_prob_nv"
_CLIP = f"greatest(least({_NV}, 1 - 1e-6), 1e-16)"


@query(
    "d10_quote_consensus",
    f"""SELECT game_date, epoch(game_datetime)::BIGINT AS at_second, away_team, home_team, count(*) AS num_books, {r(f'median({_NV})')} AS p_open_home_median_nv,
          {r('median(home_opening_prob_raw)')} AS p_open_home_median, {r('avg(home_opening_prob_raw)')} AS p_open_home_mean,
          {r('coalesce(stddev_samp(home_opening_prob_raw), 0)')} AS p_open_home_std, {r(f'max({_NV})')} AS p_open_home_max_nv, {r(f'min({_NV})')} AS p_open_home_min_nv,
          {r(f'avg({_NV})')} AS p_open_home_mean_nv, {r(f'coalesce(stddev_samp({_NV}), 0)')} AS p_open_home_std_nv FROM @quote_probs q
        GROUP BY game_date, game_datetime, away_team, home_team""",
)
def d10(v):
    out = quotes.consensus(add_market_probabilities(v.quotes), market_only=True)
    at = F.unix_seconds(F.col("game_datetime").cast("timestamp")).alias("at_second")
    return tidy(out.select(*[c for c in out.columns if c not in ("game_datetime", "logit_prob_home_std_nv", "vig_open")], at))


@query(
    "d11_quote_dispersion",
    f"""SELECT game_date, epoch(game_datetime)::BIGINT AS at_second, away_team, home_team, {r(f'coalesce(stddev_samp(ln({_CLIP} / (1 - {_CLIP}))), 0)')} AS logit_prob_home_std_nv
        FROM @quote_probs q GROUP BY game_date, game_datetime, away_team, home_team""",
)
def d11(v):
    out = quotes.consensus(add_market_probabilities(v.quotes))
    at = F.unix_seconds(F.col("game_datetime").cast("timestamp")).alias("at_second")
    return tidy(out.select("game_date", at, "away_team", "home_team", "logit_prob_home_std_nv"))


_LG = {"woba": ("pa", "higher"), "ops": ("pa", "higher"), "iso": ("ab", "higher"), "k_percent": ("pa", "lower")}


def _league_sql(stats, view, dates, minimum=10):
    """As-of averages by correlated ranges: no running sums."""
    cols = []
    for s, (w, _) in stats.items():
        ok = f"x.{s} IS NOT NULL AND x.{w} > 0"
        past = f"{ok} AND x.game_date < d.game_date"
        n = f"count(DISTINCT CASE WHEN {past} THEN x.game_date::VARCHAR || '|' || x.dh || '|' || x.team END)"
        mean = lambda c: f"sum(CASE WHEN {c} THEN x.{s} * x.{w} END) / CAST(sum(CASE WHEN {c} THEN x.{w} END) AS DOUBLE)"
        cols.append(f"CASE WHEN {n} < {minimum} THEN {mean(ok)} ELSE {mean(past)} END AS avg_{s}")
    return f"SELECT d.game_date, {', '.join(cols)} FROM (SELECT DISTINCT game_date FROM {dates} y) d, {view} x GROUP BY d.game_date"


def _rounded(sql, stats):
    return f"SELECT game_date, {', '.join(r(f'avg_{s}') + f' AS avg_{s}' for s in stats)} FROM ({sql}) z"


@query("d12_league_average", _rounded(_league_sql(_LG, "@position_log", "@club_games"), _LG))
def d12(v):
    return tidy(league.league_averages(v.position_log, _LG, v.club_games))


@query(
    "d13_first_non_null",
    """SELECT game_id, sportsbook, min(quote_time) AS first_time FROM (SELECT true_game_id AS game_id, l.sportsbook,
          epoch(game_datetime)::BIGINT AS quote_time FROM @quotes l) q GROUP BY 1, 2
       QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY sportsbook) = 1""",
)
def d13(v):
    """One row per game: its first book and that book's earliest quote time."""
    q = v.quotes.select(F.col("true_game_id").alias("game_id"), "sportsbook", F.unix_seconds(F.col("game_datetime").cast("timestamp")).alias("quote_time"))
    first = F.min(F.struct("sportsbook", "quote_time")).alias("f")
    return q.groupBy("game_id").agg(first).select("game_id", "f.sportsbook", F.col("f.quote_time").alias("first_time"))


@query(
    "d13_first_known",
    """SELECT q.true_game_id, arg_min(q.sportsbook, (q.sportsbook, q.quote_id)) AS sportsbook, arg_min(w.wind, (q.sportsbook, q.quote_id)) FILTER (w.wind IS NOT NULL) AS wind,
         arg_min(h, (q.sportsbook, q.quote_id, h)) FILTER (h IS NOT NULL) AS home_opening_odds
       FROM (SELECT *, CASE WHEN home_opening_odds < 0 THEN NULL ELSE home_opening_odds END AS h FROM @quotes q0) q LEFT JOIN @weather w ON q.true_game_id = w.game_id GROUP BY q.true_game_id""",
)
def d13_known(v):
    """Metadata and prices of a game collapsed to the first that is known; underdog prices only."""
    q = v.quotes.withColumn("home_opening_odds", F.expr("if(home_opening_odds < 0, NULL, home_opening_odds)"))
    rows = q.join(v.weather.select(F.col("game_id").alias("true_game_id"), "wind"), "true_game_id", "left")
    return dedupe.first_known(rows, ["true_game_id"], ["sportsbook", "quote_id"], ["sportsbook", "wind", "home_opening_odds"])


def _wide_team_stats(v):
    st = v.position_log.groupBy("game_date", "dh", "team").agg(*[F.max(s).alias(s) for s in ("woba", "k_percent", "fip")])
    from tallyline.operators.sides import attach_both_sides

    rows = st.select(
        "game_date", "dh", "team",
        F.when(F.col("team") % 2 == 0, F.col("team") + 1).otherwise(F.col("team") - 1).alias("opposing_team"),
        F.col("woba").alias("woba_season"), F.col("k_percent").alias("k_percent_season"), F.col("fip").alias("team_starter_fip_season"),
    )
    return attach_both_sides(v.club_games, rows, ["woba_season", "k_percent_season", "team_starter_fip_season"])


_D14S = """(SELECT game_date, dh, team, max(woba) AS woba, max(k_percent) AS k_percent, max(fip) AS fip FROM @position_log p GROUP BY game_date, dh, team)"""


@query(
    "d14_league_deltas",
    f"""WITH av AS ({_league_sql({k: _LG[k] for k in ('woba', 'k_percent')}, '@position_log', '@club_games')}),
        pv AS ({_league_sql({'fip': ('ip', 'lower')}, "(SELECT * FROM @player_game q WHERE gs = 1)", '@club_games')})
      SELECT c.game_id, {r('h.woba - av.avg_woba')} AS home_woba_season, {r('a.woba - av.avg_woba')} AS away_woba_season,
        {r('av.avg_k_percent - h.k_percent')} AS home_k_percent_season, {r('av.avg_k_percent - a.k_percent')} AS away_k_percent_season,
        {r('pv.avg_fip - h.fip')} AS home_starter_fip_season, {r('pv.avg_fip - a.fip')} AS away_starter_fip_season
      FROM @club_games c LEFT JOIN {_D14S} h ON c.game_date = h.game_date AND c.dh = h.dh AND c.home_team = h.team
      LEFT JOIN {_D14S} a ON c.game_date = a.game_date AND c.dh = a.dh AND c.away_team = a.team
      JOIN av ON c.game_date = av.game_date JOIN pv ON c.game_date = pv.game_date""",
)
def d14(v):
    wide = _wide_team_stats(v)
    bat = league.league_averages(v.position_log, {k: _LG[k] for k in ("woba", "k_percent")}, v.club_games)
    pit = league.league_averages(v.player_game.where("gs = 1"), {"fip": ("ip", "lower")}, v.club_games)
    out = league.apply_league_deltas(wide, bat, {k: _LG[k] for k in ("woba", "k_percent")})
    out = league.apply_league_deltas(out, pit, {"fip": ("ip", "lower")}, role="starter_")
    return tidy(out.select("game_id", *[c for c in out.columns if c.endswith("_season")]))


@query(
    "d15_player_deltas",
    f"""WITH av AS ({_league_sql({'woba': ('pa', 'higher')}, '@position_log', '@position_log')})
      SELECT player_id, p.game_date, dh, {r('woba - avg_woba')} AS woba_season, {r('iso')} AS other FROM @position_log p JOIN av ON p.game_date = av.game_date""",
)
def d15(v):
    log = v.position_log
    stats = {"woba": ("pa", "higher")}
    av = league.league_averages(log, stats, log)
    feats = log.select("player_id", "game_date", "dh", F.col("woba").alias("woba_season"), F.col("iso").alias("other"))
    return tidy(league.apply_league_deltas(feats, av, stats, sides=("",)))


@query(
    "d16_book_pivot",
    """SELECT * FROM (PIVOT (SELECT true_game_id, sportsbook, quote_id, away_opening_odds, home_opening_odds FROM @quotes q) ON sportsbook
         USING arg_min(away_opening_odds, quote_id) AS away_opening_odds, arg_min(home_opening_odds, quote_id) AS home_opening_odds GROUP BY true_game_id)""",
)
def d16(v):
    """A column per book of the table for either price; the first quote of a book by its id."""
    names = ["away_opening_odds", "home_opening_odds"]
    books = quotes.book_list(v.quotes)
    return quotes.pivot_books(v.quotes, ["true_game_id"], books, names, lambda price, book: f"{book}_{price}")


@query(
    "d16_book_prices",
    """SELECT true_game_id, sportsbook, count(*) AS num_quotes, arg_min(away_opening_odds, quote_id) AS away_opening_odds,
         arg_min(home_opening_odds, quote_id) AS home_opening_odds FROM @quotes q GROUP BY true_game_id, sportsbook""",
)
def d16_prices(v):
    """One row per game and book, over all books."""
    return quotes.book_prices(v.quotes, ["true_game_id"], ["away_opening_odds", "home_opening_odds"])


_SC = ("home_score", "venue_id", "p_m2")


@query(
    "d17_standard_scaling",
    "WITH f AS (SELECT " + ", ".join(f"avg(CASE WHEN split = 'train' THEN {c} END) AS m_{c}, stddev_pop(CASE WHEN split = 'train' THEN {c} END) AS s_{c}" for c in _SC)
    + " FROM @pred_wide p) SELECT game_id, split, " + ", ".join(f"{r(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END')} AS {c}" for c in _SC)
    + f", {r('p_mkt')} AS p_mkt FROM @pred_wide p, f",
)
def d17(v):
    out = prepare.standardize(v.pred_wide.select("game_id", "split", *_SC, "p_mkt"), _SC, "split = 'train'")
    return tidy(out)


@query(
    "d18_median_imputation",
    f"""WITH x AS (SELECT game_id, split, CASE WHEN venue_id % 7 = 0 THEN NULL ELSE p_m2 END AS a, CASE WHEN home_score = 3 THEN NULL ELSE CAST(home_score AS DOUBLE) END AS b,
          CASE WHEN venue_id % 7 = 0 THEN NULL WHEN home_score = 3 THEN 1 ELSE 0 END AS miss FROM @pred_wide p),
        m AS (SELECT median(a) FILTER (split = 'train') AS ma, median(b) FILTER (split = 'train') AS mb FROM x)
      SELECT game_id, split, {r('coalesce(a, ma)')} AS a, {r('coalesce(b, mb)')} AS b, coalesce(miss, 1) AS miss FROM x, m""",
)
def d18(v):
    a = F.when(F.col("venue_id") % 7 != 0, F.col("p_m2"))
    b = F.when(F.col("home_score") != 3, F.col("home_score").cast("double"))
    miss = F.when(F.col("venue_id") % 7 != 0, F.when(F.col("home_score") == 3, 1).otherwise(0))
    df = v.pred_wide.select("game_id", "split", a.alias("a"), b.alias("b"), miss.alias("miss"))
    return tidy(prepare.impute_medians(df, ["a", "b"], "split = 'train'", ["miss"]))


_CP = "greatest(least(p, 1 - 1e-6), 1e-6)"
_AUC = f"""(SELECT model, split, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)) AS roc_auc FROM (
   SELECT *, avg(pos) OVER (PARTITION BY model, split, {_CP}) AS rk FROM (
     SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY {_CP}) AS pos FROM @preds z) a) b GROUP BY model, split)"""
_MET = f"""(SELECT model, split, count(*) AS n, avg(-(y * ln({_CP}) + (1 - y) * ln(1 - {_CP}))) AS log_loss, avg(({_CP} - y) * ({_CP} - y)) AS brier,
    avg(p) AS mean_pred, stddev_pop(p) AS std_pred FROM @preds q GROUP BY model, split)"""


@query(
    "d19_probability_metrics",
    f"""SELECT m.model, m.split, n, {r('log_loss')} AS log_loss, {r('brier')} AS brier, {r('mean_pred')} AS mean_pred, {r('std_pred')} AS std_pred, {r('roc_auc')} AS roc_auc
        FROM {_MET} m JOIN {_AUC} a ON m.model = a.model AND m.split = a.split""",
)
def d19(v):
    return tidy(evaluate.probability_metrics(v.preds))


def _bins_sql(edges_cte):
    return f"""{edges_cte}, b AS (SELECT p.model, p.split, y, p, len(list_filter(edges[2:len(edges) - 1], lambda t: t < p)) AS bin, edges
        FROM @preds p JOIN e ON p.model = e.model AND p.split = e.split),
      g AS (SELECT model, split, bin, count(*) AS n, CAST(sum(y) AS DOUBLE) AS sum_y, sum(p) AS sum_p, any_value(edges) AS edges FROM b GROUP BY model, split, bin)"""


_UNI = "WITH e AS (SELECT DISTINCT model, split, [i / 10.0 FOR i IN range(11)] AS edges FROM @preds z)"
_QNT = """WITH q0 AS (SELECT model, split, quantile_cont(p, [i / 25.0 FOR i IN range(26)]) AS q FROM @preds z GROUP BY model, split),
  e AS (SELECT model, split, list_sort(list_distinct(list_concat([0.0, 1.0], q[2:25]))) AS edges FROM q0)"""


@query(
    "d20_calibration_error",
    f"""SELECT model, split, u AS ece_uniform, q AS ece_quantile FROM
     (SELECT model, split, {r('sum(abs(sum_y - sum_p)) / sum(n)')} AS u FROM ({_bins_sql(_UNI)} SELECT * FROM g) x GROUP BY model, split) a
     JOIN (SELECT model, split, {r('sum(abs(sum_y - sum_p)) / sum(n)')} AS q FROM ({_bins_sql(_QNT)} SELECT * FROM g) x GROUP BY model, split) b USING (model, split)""",
)
def d20(v):
    u = evaluate.calibration_error(evaluate.calibration_bins(v.preds, 10, "uniform")).withColumnRenamed("ece", "ece_uniform")
    q = evaluate.calibration_error(evaluate.calibration_bins(v.preds, 25, "quantile")).withColumnRenamed("ece", "ece_quantile")
    return tidy(u.join(q, ["model", "split"]))


_MIN = 400


@query(
    "d21_merged_bins",
    f"""{_bins_sql(_UNI).replace('WITH e', 'WITH RECURSIVE e')},
      f AS (SELECT e.model, e.split, i AS bin, coalesce(n, 0) AS n, coalesce(sum_y, 0) AS sum_y, coalesce(sum_p, 0) AS sum_p, e.edges[i + 2] AS high
            FROM e CROSS JOIN (SELECT unnest(range(10)) AS i) s LEFT JOIN g ON g.model = e.model AND g.split = e.split AND g.bin = i),
      w AS (SELECT model, split, -1 AS bin, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS sum_y, CAST(0 AS DOUBLE) AS sum_p, TRUE AS closed, 0.0 AS high FROM e
            UNION ALL SELECT f.model, f.split, f.bin, CASE WHEN closed THEN f.n ELSE w.n + f.n END, CASE WHEN closed THEN f.sum_y ELSE w.sum_y + f.sum_y END,
              CASE WHEN closed THEN f.sum_p ELSE w.sum_p + f.sum_p END,
              (CASE WHEN closed THEN f.n ELSE w.n + f.n END) >= {_MIN} OR f.bin = 9, f.high
            FROM w JOIN f ON f.model = w.model AND f.split = w.split AND f.bin = w.bin + 1)
      SELECT model, split, row_number() OVER (PARTITION BY model, split ORDER BY bin) - 1 AS bin, n, {r('sum_y')} AS sum_y, {r('sum_p')} AS sum_p,
        {r('high')} AS high FROM w WHERE closed AND bin >= 0""",
)
def d21(v):
    bins = evaluate.calibration_bins(v.preds, 10, "uniform")
    return tidy(evaluate.merge_small_bins(bins, _MIN).drop("low"))


@query(
    "d22_reliability",
    f"SELECT model, split, bin, n, {r('sum_p / n')} AS prob_pred, {r('sum_y / n')} AS prob_true FROM ({_bins_sql(_QNT)} SELECT * FROM g) x",
)
def d22(v):
    return tidy(evaluate.reliability(evaluate.calibration_bins(v.preds, 25, "quantile")))


@query(
    "d23_distribution_summary",
    "SELECT model, split, " + ", ".join(f"{r(f'q[{i + 1}]')} AS p{x}" for i, x in enumerate((1, 5, 25, 50, 75, 95, 99)))
    + f""", {r('lo * 100')} AS pct_below_30, {r('hi * 100')} AS pct_above_70 FROM (SELECT model, split, quantile_cont(p, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q,
        avg(CASE WHEN p < 0.30 THEN 1.0 ELSE 0.0 END) AS lo, avg(CASE WHEN p > 0.70 THEN 1.0 ELSE 0.0 END) AS hi FROM @preds z GROUP BY model, split) x""",
)
def d23(v):
    return tidy(evaluate.distribution_summary(v.preds))


_DL = f"(SELECT *, ln({_CP} / (1 - {_CP})) - ln({_CP.replace('p,', 'p_mkt,')} / (1 - {_CP.replace('p,', 'p_mkt,')})) AS delta FROM @preds z)"


@query(
    "d24_logit_delta_summary",
    f"""SELECT model, split, {r('avg(delta)')} AS mean_delta, {r('stddev_pop(delta)')} AS std_delta, {r('quantile_cont(delta, 0.05)')} AS p5, {r('quantile_cont(delta, 0.95)')} AS p95
        FROM {_DL} d GROUP BY model, split""",
)
def d24(v):
    return tidy(evaluate.logit_delta_summary(v.preds))


def _hist_sql(src, value, bins):
    return f"""WITH h AS (SELECT {value} AS x FROM {src} d), s AS (SELECT min(x) AS lo, max(x) AS hi FROM h),
      c AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, count(*) AS n FROM h, s GROUP BY 1)
      SELECT i AS bin, {r(f'lo + (hi - lo) * i / {bins}')} AS low, {r(f'lo + (hi - lo) * (i + 1) / {bins}')} AS high, coalesce(n, 0) AS n
      FROM (SELECT unnest(range({bins})) AS i) g LEFT JOIN c ON c.bin = i, s"""


@query("d24_logit_delta_histogram", _hist_sql(_DL, "delta", 50))
def d24b(v):
    return tidy(evaluate.histogram(evaluate.logit_delta(v.preds), "delta", 50))


@query(
    "d25_roc_points",
    f"""SELECT model, split, {r(_CP)} AS threshold, {r('CAST(sum(neg) OVER w AS DOUBLE) / N')} AS fpr, {r('CAST(sum(pos) OVER w AS DOUBLE) / P')} AS tpr FROM (
          SELECT *, sum(pos) OVER (PARTITION BY model, split) AS P, sum(neg) OVER (PARTITION BY model, split) AS N FROM (
            SELECT model, split, {_CP} AS p, sum(y) AS pos, sum(1 - y) AS neg FROM @preds z GROUP BY 1, 2, 3) a) b
        WINDOW w AS (PARTITION BY model, split ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""".replace("P,", "tot_p,").replace("AS P", "AS tot_p").replace("AS N ", "AS tot_n ").replace("/ N", "/ tot_n").replace("/ P", "/ tot_p"),
)
def d25(v):
    return tidy(evaluate.roc_points(v.preds))


@query("d26_importance_share")
def d26(v):
    """Gain shares of boosted trees (rows depend on the trained model, so no oracle)."""
    cols = ["home_score", "away_score", "venue_id", "p_m2"]
    model = boosting.fit(v.pred_wide, cols, boosting.Settings(rounds=15, patience=4, depth=3, rate=0.2), "split = 'train'", "split = 'val'")
    return tidy(evaluate.top_importances(boosting.gains(model, v.spark), 20))


@query(
    "d27_model_comparison",
    f"""WITH m AS (SELECT m.*, roc_auc FROM {_MET} m JOIN {_AUC} a ON m.model = a.model AND m.split = a.split)
      SELECT m.model, m.split, m.n, {r('m.log_loss')} AS log_loss, {r('m.brier')} AS brier, {r('m.mean_pred')} AS mean_pred, {r('m.std_pred')} AS std_pred, {r('m.roc_auc')} AS roc_auc,
        {r('m.log_loss - b.log_loss')} AS delta_log_loss_vs_market, {r('m.brier - b.brier')} AS delta_brier_vs_market FROM m JOIN m b ON b.model = 'market' AND b.split = m.split""",
)
def d27(v):
    return tidy(evaluate.compare_models(v.preds))


# ---- bets ---------------------------------------------------------------------------------


def best_of_games(v):
    pred = v.pred_wide.select("game_id", F.col("p_m1").alias("p_home"), "is_winner_home")
    q = add_market_probabilities(v.quotes).withColumnRenamed("true_game_id", "game_id")
    return backtest.best_quotes(backtest.quote_values(backtest.attach_predictions(q, pred)))


BEST_SQL = """(SELECT *, greatest(ev_home, ev_away) AS max_ev, CASE WHEN ev_home >= ev_away THEN 'home' ELSE 'away' END AS side FROM (
    SELECT q.true_game_id AS game_id, q.sportsbook, q.quote_id, home_opening_prob_raw AS hr, away_opening_prob_raw AS ar, y,
      p_m1 / home_opening_prob_raw - 1 AS ev_home, (1 - p_m1) / away_opening_prob_raw - 1 AS ev_away
    FROM @quote_probs q JOIN @pred_wide p ON q.true_game_id = p.game_id) e
  QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY greatest(ev_home, ev_away) DESC, sportsbook, quote_id) = 1)"""


@query(
    "d28_value_summary",
    f"SELECT {r('avg(max_ev)')} AS mean_ev, {r('min(max_ev)')} AS min_ev, {r('max(max_ev)')} AS max_ev, {r('stddev_samp(max_ev)')} AS std_ev FROM {BEST_SQL} b",
)
def d28(v):
    return tidy(backtest.value_summary(best_of_games(v)))


_PROFIT = "CASE WHEN side = 'home' THEN y * (1 / hr - 1) - (1 - y) ELSE (1 - y) * (1 / ar - 1) - y END"


@query(
    "d29_return_on_investment",
    f"SELECT count(*) AS n_bets, {r(f'sum({_PROFIT})')} AS profit, {r(f'sum({_PROFIT}) / count(*)')} AS roi FROM {BEST_SQL} b WHERE max_ev > 0",
)
def d29(v):
    return tidy(backtest.roi(backtest.bets(best_of_games(v))))


@query("d30_value_histogram", _hist_sql(BEST_SQL, "max_ev", 30))
def d30(v):
    return tidy(evaluate.histogram(best_of_games(v), "max_ev", 30))


@query("f1_best_quote", f"SELECT game_id, sportsbook, quote_id, side AS max_ev_side, {r('max_ev')} AS max_ev FROM {BEST_SQL} b")
def f1(v):
    return tidy(best_of_games(v).select("game_id", "sportsbook", "quote_id", "max_ev_side", "max_ev"))


@query("f2_bet_policy", f"SELECT game_id, side AS max_ev_side, {r(_PROFIT)} AS profit FROM {BEST_SQL} b WHERE max_ev > 0")
def f2(v):
    return tidy(backtest.bets(best_of_games(v)).select("game_id", "max_ev_side", "profit"))
