"""Queries of family B: projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions import context, market, numeric, text
from tallyline.functions.aliases import QUOTE_ALIASES, TEAM_ALIASES
from tallyline.operators import prepare, sides
from tallyline.plans.registry import half_up, query, r, tidy
from tallyline.session import scratch_path
from tallyline.sources import sinks

QID = ["true_game_id", "sportsbook", "quote_id"]
QS = ", ".join(QID)


@query("b1_implied_probability", f"SELECT {QS}, {r('hr')} AS home_prob, {r('ar')} AS away_prob FROM @quote_probs q")
def b1(v):
    return tidy(v.quotes.select(
        *QID, market.implied_probability("home_opening_odds").alias("home_prob"),
        market.implied_probability("away_opening_odds").alias("away_prob"),
    ))


@query(
    "b2_margin_removal",
    f"SELECT {QS}, {r('home_opening_prob_nv')} AS home_nv, {r('away_opening_prob_nv')} AS away_nv, {r('vig_open')} AS vig FROM @quote_probs q",
)
def b2(v):
    q = market.add_market_probabilities(v.quotes)
    return tidy(q.select(*QID, F.col("home_opening_prob_nv").alias("home_nv"), F.col("away_opening_prob_nv").alias("away_nv"), F.col("vig_open").alias("vig")))


_EDGE = "CASE game_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE p_m1 END"


def _lg(low, high):
    c = f"greatest(least(CAST({_EDGE} AS DOUBLE), {high}), {low})"
    return f"ln({c} / (1 - {c}))"


@query(
    "b3_clipped_logit",
    f"""SELECT game_id, {r(_lg('1e-16', '1 - 1e-6'))} AS consensus, {r(_lg('1e-6', '1 - 1e-6'))} AS model,
          {r(_lg('1e-15', '1 - 1e-15'), 4)} AS calibration, {r('1 / (1 + exp(-' + _lg('1e-6', '1 - 1e-6') + '))')} AS back FROM @pred_wide p""",
)
def b3(v):
    p = F.expr(_EDGE).cast("double")
    out = v.pred_wide.select(
        "game_id",
        numeric.logit(p, numeric.CONSENSUS_CLIP).alias("consensus"),
        numeric.logit(p, numeric.MODEL_CLIP).alias("model"),
        half_up(numeric.logit(p, numeric.CALIBRATION_CLIP), 4).alias("calibration"),
        numeric.sigmoid(numeric.logit(p)).alias("back"),
    )
    return tidy(out, skip=("calibration",))


@query("b4_far_rescheduled", "SELECT game_id, game_date FROM @raw_schedule s WHERE game_datetime <= game_date + INTERVAL '2' DAY")
def b4(v):
    kept = F.col("game_datetime") <= F.col("game_date").cast("timestamp_ntz") + F.expr("INTERVAL '2' DAY")
    return v.raw_schedule.where(kept).select("game_id", "game_date")


@query(
    "b5_completed_games",
    "SELECT game_id, CASE WHEN winning_team = home_team THEN 1 ELSE 0 END AS is_winner_home FROM @raw_schedule s WHERE winning_team IS NOT NULL",
)
def b5(v):
    done = v.raw_schedule.where(F.col("winning_team").isNotNull())
    return tidy(done.select("game_id", (F.col("winning_team") == F.col("home_team")).alias("is_winner_home")))


@query(
    "b6_role_filter",
    "SELECT player_id, game_date, dh, pos FROM @player_game p WHERE NOT (coalesce(pos, '') LIKE 'P%' AND player_id <> 42)",
)
def b6(v):
    return v.player_game.where(context.is_position_player("pos", "player_id", exempt=42)).select("player_id", "game_date", "dh", "pos")


@query("b7_day_night", "SELECT game_id, CASE WHEN day_night_game = 'day' THEN 1 ELSE 0 END AS is_day FROM @weather w")
def b7(v):
    return tidy(v.weather.select("game_id", context.is_day_game("day_night_game").alias("is_day")))


@query(
    "b8_wind_text",
    """SELECT game_id, coalesce(CAST(regexp_extract(wind, '^(\\d+)', 1) AS BIGINT), 0) AS wind_magnitude,
         coalesce(trim(split_part(wind, ',', 2)), 'None') AS wind_direction FROM (SELECT game_id, wind FROM @weather w) x""",
)
def b8(v):
    return tidy(v.weather.select(
        "game_id", context.wind_magnitude("wind").alias("wind_magnitude"), context.wind_direction("wind").alias("wind_direction")
    ))


def _hot(expr, words, prefix):
    return ", ".join(f"CASE WHEN {expr} = '{w}' THEN 1 ELSE 0 END AS {prefix}_{w.replace(' ', '_')}" for w in words)


@query(
    "b9_one_hot",
    f"""SELECT game_id, {_hot("coalesce(trim(split_part(wind, ',', 2)), 'None')", context.WIND_DIRECTIONS, 'wind_direction')},
          {_hot("coalesce(condition, 'Unknown')", context.CONDITIONS, 'condition')} FROM @weather w""",
)
def b9(v):
    return tidy(v.weather.select(
        "game_id",
        *context.one_hot(context.wind_direction("wind"), context.WIND_DIRECTIONS, "wind_direction"),
        *context.one_hot(F.coalesce("condition", F.lit("Unknown")), context.CONDITIONS, "condition"),
    ))


@query("b10_season_month", "SELECT game_id, CASE WHEN month(game_date) = 3 THEN 4 WHEN month(game_date) = 10 THEN 9 ELSE month(game_date) END AS month FROM @games g")
def b10(v):
    return tidy(v.games.select("game_id", context.season_month("game_date").alias("month")))


@query(
    "b11_rate_per_nine",
    f"SELECT player_id, month, CASE WHEN total_innings = 0 THEN NULL ELSE {r('frv / total_innings * 9.0')} END AS frv_per_9 FROM @fielding f",
)
def b11(v):
    return tidy(v.fielding.select("player_id", "month", context.rate_per_nine("frv", "total_innings").alias("frv_per_9")))


@query(
    "b12_derived_pitching",
    f"""SELECT player_id, game_date, dh, {r('k_percent - bb_percent')} AS k_bb_percent,
          CASE WHEN gmli = 0 THEN NULL ELSE {r('wpa / gmli')} END AS wpa_li, CAST(1 AS BIGINT) AS apps FROM @player_game p""",
)
def b12(v):
    return tidy(derived_pitching(v.player_game.drop("k_bb_percent", "wpa_li", "apps")).select("player_id", "game_date", "dh", "k_bb_percent", "wpa_li", "apps"))


def derived_pitching(df):
    return df.select(
        "*",
        (F.col("k_percent") - F.col("bb_percent")).alias("k_bb_percent"),
        numeric.ratio(F.col("wpa"), F.col("gmli")).alias("wpa_li"),
        F.lit(1).alias("apps"),
    )


_DH = "CASE o_orderpriority WHEN '1-URGENT' THEN 'N' WHEN '2-HIGH' THEN 'Y' WHEN '3-MEDIUM' THEN 'S' ELSE 'Q' END"


@query(
    "b13_doubleheader_code",
    f"""SELECT o_orderkey, CASE WHEN d = 'N' THEN CAST(0 AS BIGINT) WHEN d IN ('Y', 'S') THEN CASE WHEN o_custkey % 2 = 1 THEN 1 ELSE 2 END END AS dh
        FROM (SELECT *, {_DH} AS d FROM @orders o) x""",
)
def b13(v):
    return tidy(v.orders.select("o_orderkey", context.doubleheader_code(F.expr(_DH), F.col("o_custkey") % 2).alias("dh")))


@query(
    "b14_winner",
    """SELECT game_id, CASE WHEN a AND NOT h THEN away_team WHEN h AND NOT a THEN home_team END AS by_flags,
         CASE WHEN away_score > home_score THEN away_team ELSE home_team END AS by_score
       FROM (SELECT *, home_score > 3 AS h, away_score > 3 AS a FROM @games g) x""",
)
def b14(v):
    return v.games.select(
        "game_id",
        context.winner_by_flags(F.col("away_score") > 3, F.col("home_score") > 3, "away_team", "home_team").alias("by_flags"),
        context.winner_by_score("away_score", "home_score", "away_team", "home_team").alias("by_score"),
    )


_NAME = """CASE c_nationkey % 5 WHEN 0 THEN 'New York Yankees' WHEN 1 THEN 'OAK' WHEN 2 THEN 'Rays' WHEN 3 THEN 'KC' ELSE c_mktsegment END"""


@query(
    "b15_alias_canonical",
    """SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'NYY' WHEN 1 THEN 'ATH' WHEN 2 THEN 'TBR' WHEN 3 THEN 'KC' ELSE c_mktsegment END AS team,
         CASE c_nationkey % 5 WHEN 0 THEN 'New York Yankees' WHEN 1 THEN 'ATH' WHEN 2 THEN 'Rays' WHEN 3 THEN 'KCR' ELSE c_mktsegment END AS quote_team
       FROM @customer c""",
)
def b15(v):
    name = F.expr(_NAME)
    return v.customer.select(
        "c_custkey", text.canonical(name, TEAM_ALIASES).alias("team"), text.canonical(name, QUOTE_ALIASES).alias("quote_team")
    )


@query(
    "b16_name_normalisation",
    r"""WITH a AS (SELECT conv_id, turn, role, lower(strip_accents(text)) AS t FROM @conversations c),
      b AS (SELECT *, string_split(t, ',') AS h FROM a),
      c AS (SELECT *, CASE WHEN len(h) = 2 THEN regexp_replace(h[2], '^\s+|\s+$', '', 'g') || ' ' || regexp_replace(h[1], '^\s+|\s+$', '', 'g') ELSE t END AS s FROM b),
      d AS (SELECT *, trim(regexp_replace(regexp_replace(s, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS n FROM c),
      e AS (SELECT *, string_split(n, ' ') AS w FROM d),
      f AS (SELECT *, list_filter(['jr','sr','ii','iii','iv','v'], lambda x: list_contains(w, x) AND w[-1] <> x) AS found FROM e)
      SELECT conv_id, turn, role, CASE WHEN len(w) > 2 AND len(found) > 0
        THEN array_to_string(list_concat(list_concat(w[1:list_position(w, found[1]) - 1], w[list_position(w, found[1]) + 1:]), [found[1]]), ' ')
        ELSE n END AS normalized FROM f""",
)
def b16(v):
    return v.conversations.select("conv_id", "turn", "role", text.normalize_name("text").alias("normalized"))


_VARIANT = """CASE event_id % 4 WHEN 0 THEN t || 'Z' WHEN 1 THEN replace(t, ' ', 'T') || '+00:00' WHEN 2 THEN t || '.250' ELSE t END"""


@query(
    "b17_timestamp_text",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS clean FROM @events e",
)
def b17(v):
    raw = v.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return raw.select("event_id", text.clean_timestamp_text(F.expr(_VARIANT)).alias("clean"))


def wide_sides(v):
    """Two metrics of two horizons per side, taken from the scores of a game."""
    return v.games.select(
        "game_id", "is_winner_home", "home_team", "away_team",
        *[
            (F.col(f"{s}_score") * a + F.col(f"{s}_team") * b).cast("double").alias(f"{s}_{m}_{h}")
            for s in ("home", "away")
            for m, a in (("win_pct", 1), ("run_diff", 2), ("starter_fip", 3), ("woba", 4))
            for h, b in (("season", 1), ("ewm_h3", 2), ("ewm_h4", 3))
        ],
        ((F.col("game_id") % 100).cast("double") / 128).alias("p_open_home_median_nv"),
        F.col("home_score").cast("double").alias("homegrown_metric"),
        F.col("away_score").cast("double").alias("awayness_metric"),
    )


_A = {"win_pct": 1, "run_diff": 2, "starter_fip": 3, "woba": 4}
_B = {"season": 1, "ewm_h3": 2, "ewm_h4": 3}


def side_sql(side, m, h, flip=False):
    s = {"home": "away", "away": "home"}[side] if flip else side
    return f"CAST({s}_score * {_A[m]} + {s}_team * {_B[h]} AS DOUBLE)"


def _diff(m1, m2, h1, h2, flip=False):
    return f"{side_sql('home', m1, h1, flip)} - {side_sql('away', m2, h2, flip)}"


_SAME = ", ".join(f"{_diff(m, m, h, h)} AS home_away_{m}_{h}_diff" for m in ("win_pct", "run_diff") for h in ("season", "ewm_h3"))


@query("b18_same_metric_diffs", f"SELECT game_id, {_SAME} FROM @games g")
def b18(v):
    return wide_sides(v).selectExpr("game_id", *sides.same_metric_diffs(["win_pct", "run_diff"], ["season", "ewm_h3"]))


_CROSS = ", ".join(
    f"{_diff('starter_fip', 'woba', a, b)} AS home_away_starter_fip_woba_{a}_diff" for a, b in (("season", "season"), ("ewm_h3", "ewm_h4"))
)


@query("b19_cross_metric_diffs", f"SELECT game_id, {_CROSS} FROM @games g")
def b19(v):
    return wide_sides(v).selectExpr("game_id", *sides.cross_metric_diffs([("starter_fip", "woba")], ["season", "ewm_h3"], ["season", "ewm_h4"]))


def _all_diffs(flip=False):
    team = [f"{_diff(m, m, h, h, flip)} AS home_away_{m}_{h}_diff" for m in ("win_pct", "run_diff") for h in ("season", "ewm_h3")]
    start = [f"{_diff('starter_fip', 'starter_fip', h, h, flip)} AS home_away_starter_fip_{h}_diff" for h in ("season", "ewm_h3")]
    bat = [f"{_diff('woba', 'woba', h, h, flip)} AS home_away_woba_{h}_diff" for h in ("season", "ewm_h4")]
    cross = [f"{_diff('starter_fip', 'woba', a, b, flip)} AS home_away_starter_fip_woba_{a}_diff" for a, b in (("season", "season"), ("ewm_h3", "ewm_h4"))]
    return ", ".join(team + start + bat + cross)


@query("b21_matchup_recompute", f"SELECT game_id, {_all_diffs()} FROM @games g")
def b21(v):
    df = wide_sides(v).withColumn("home_away_win_pct_season_diff", F.lit(-1.0))
    out = sides.recompute_diffs(df, (4,), (3,), (8,), (3,))
    return out.select("game_id", *[c for c in out.columns if c.endswith("_diff")])


@query(
    "b22_paired_swap",
    f"""SELECT game_id, away_team AS home_team, home_team AS away_team, {side_sql('away', 'woba', 'season')} AS home_woba_season,
          {side_sql('home', 'woba', 'season')} AS away_woba_season, CAST(home_score AS DOUBLE) AS homegrown_metric FROM @games g""",
)
def b22(v):
    df = wide_sides(v)
    return df.selectExpr(*sides.swapped_sides(df.columns)).select("game_id", "home_team", "away_team", "home_woba_season", "away_woba_season", "homegrown_metric")


@query("b23_expected_value", f"SELECT game_id, {r('p_m1 / p_mkt - 1')} AS ev FROM @pred_wide p")
def b23(v):
    return tidy(v.pred_wide.select("game_id", market.expected_value("p_m1", "p_mkt").alias("ev")))


@query("b24_bet_settlement", f"SELECT game_id, {r('y * (1.0 / p_mkt - 1) - (1 - y)')} AS profit FROM @pred_wide p")
def b24(v):
    return tidy(v.pred_wide.select("game_id", market.settle("y", "p_mkt").alias("profit")))


@query(
    "b25_feature_columns",
    f"SELECT game_id, game_date, season, venue_id_x, p_open_home_median_nv, home_woba_season FROM (SELECT *, venue_id AS venue_id_x, {r('p_mkt')} AS p_open_home_median_nv, CAST(home_score AS DOUBLE) AS home_woba_season FROM @pred_wide p) x",
)
def b25(v):
    df = v.pred_wide.select(
        "game_id", "game_date", "season", "home_score", "away_score", "venue_id", F.col("venue_id").alias("venue_id_x"),
        F.col("p_mkt").alias("p_open_home_median_nv"), F.col("home_score").cast("double").alias("home_woba_season"),
    )
    return tidy(prepare.feature_columns(df))


@query(
    "b26_market_pruning",
    f"SELECT game_id, {r('p_mkt')} AS p_open_home_median_nv FROM @pred_wide p",
)
def b26(v):
    df = v.pred_wide.select(
        "game_id", F.col("p_mkt").alias("p_open_home_median_nv"), F.lit(3).alias("num_books"),
        F.lit(1.05).alias("vig_open"), F.col("p_m1").alias("logit_prob_home_std_nv"),
    )
    return tidy(prepare.drop_market_extras(df))


_B28 = "SELECT split, CASE WHEN venue_id % 7 = 0 THEN NULL ELSE p_m1 END AS a, CASE WHEN home_score = 3 THEN NULL ELSE home_score END AS b FROM @pred_wide p"


def _holes(v):
    return v.pred_wide.select(
        "split", F.when(F.col("venue_id") % 7 != 0, F.col("p_m1")).alias("a"), F.when(F.col("home_score") != 3, F.col("home_score")).alias("b")
    )


@query(
    "b28_null_audit",
    f"SELECT split, count(*) AS n_rows, CAST(sum(CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_rows FROM ({_B28}) x GROUP BY split",
)
def b28(v):
    return prepare.null_audit(_holes(v))


@query("b28_null_drop", f"SELECT split, b, count(*) AS n FROM ({_B28}) x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY split, b")
def b28b(v):
    return _holes(v).na.drop("any").groupBy("split", "b").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b28_audit_in_write",
    """SELECT split, count(*) AS n_rows, CAST(sum(CASE WHEN venue_id % 7 = 0 OR home_score = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_null_rows,
         CAST(sum(CASE WHEN p_mkt * 2 > 1 AND venue_id <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_out_of_range, CAST(sum(CASE WHEN venue_id = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_not_finite,
         (SELECT count(*) FILTER (home_score <> away_score + 1) FROM @pred_wide q) AS n_apart, (SELECT count(*) FROM @pred_wide q2) AS n_stored FROM @pred_wide p GROUP BY split""",
)
def b28_in_write(v):
    """Null, probability and agreement audits of a table, counted by the pass that stores it."""
    p = F.when(F.col("venue_id") == 3, float("nan")).otherwise(F.col("p_mkt") * 2)
    df = v.pred_wide.select("split", F.when(F.col("venue_id") % 7 != 0, F.col("p_m1")).alias("a"), F.when(F.col("home_score") != 3, F.col("home_score")).alias("b"), p.alias("p"), "home_score", "away_score")
    splits = ("train", "val", "test")
    audits = prepare.audit_texts(["a", "b"], "p", splits) | {"n_apart": "count_if(home_score <> away_score + 1)"}
    stored, seen = sinks.write_audited(df, scratch_path(v.spark, "audited"), audits)
    names = ("n_rows", "n_null_rows", "n_out_of_range", "n_not_finite")
    rows = [(s, *[seen[f"{s}__{n}"] for n in names], seen["n_apart"]) for s in splits if seen[f"{s}__n_rows"]]
    found = v.spark.createDataFrame(rows, f"split string, {', '.join(f'{n} long' for n in names)}, n_apart long")
    return found.withColumn("n_stored", F.lit(stored.count()).cast("long"))


@query(
    "b29_typed_partition",
    f"SELECT game_id, venue_id, CASE WHEN home_score > 5 THEN 1 ELSE 0 END AS high, {r('p_mkt')} AS p_open_home_median_nv FROM @pred_wide p",
)
def b29(v):
    df = v.pred_wide.select("game_id", "venue_id", (F.col("home_score") > 5).alias("high"), "split", "game_date", F.col("p_mkt").alias("p_open_home_median_nv"))
    return tidy(prepare.typed_partition(df, keys=("game_id",)))


@query(
    "b30_probability_audit",
    """SELECT split, CAST(sum(CASE WHEN p_mkt * 2 > 1 AND venue_id <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_out_of_range,
         CAST(sum(CASE WHEN venue_id = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_not_finite FROM @pred_wide p GROUP BY split""",
)
def b30(v):
    p = F.when(F.col("venue_id") == 3, float("nan")).otherwise(F.col("p_mkt") * 2)
    return prepare.probability_audit(v.pred_wide.select("split", p.alias("p")), "p")
