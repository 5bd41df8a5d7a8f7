"""Queries of family H: splits, models, calibration, back-test."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tallyline.functions.market import MARKET_PROBABILITY, add_market_probabilities
from tallyline.functions.numeric import logit
from tallyline.operators import backtest, boosting, calibrate, models, prepare
from tallyline.plans.registry import query, r, tidy
from tallyline.session import pin, scratch_path

_CUT = """(SELECT game_date FROM (SELECT game_date, row_number() OVER (ORDER BY game_date, game_id) - 1 AS i, count(*) OVER () AS n FROM @games g
    WHERE season = (SELECT max(season) FROM @games g2)) x WHERE i = n // 2)"""


@query(
    "h1_season_split",
    f"""SELECT game_id, season, CASE WHEN season < (SELECT max(season) FROM @games g3) THEN 'train' WHEN game_date <= {_CUT} THEN 'val' ELSE 'test' END AS split FROM @games g""",
)
def h1(v):
    return prepare.season_split(v.games).select("game_id", "season", "split")


@query(
    "h2_ordered_halves",
    """SELECT game_id, CASE WHEN i < n // 2 THEN 'stopping' ELSE 'calibration' END AS part FROM (
         SELECT game_id, row_number() OVER (ORDER BY game_date, game_id) - 1 AS i, count(*) OVER () AS n FROM @pred_wide p WHERE split = 'val') x""",
)
def h2(v):
    return prepare.ordered_halves(v.pred_wide.where("split = 'val'"), "game_date", ["game_id"]).select("game_id", "part")


@query(
    "h3_expanding_folds",
    """SELECT game_id, CASE WHEN i < n - 4 * (n // 5) THEN -1 ELSE (i - (n - 4 * (n // 5))) // (n // 5) END AS fold FROM (
         SELECT game_id, row_number() OVER (ORDER BY game_date, game_id) - 1 AS i, count(*) OVER () AS n FROM @games p) x""",
)
def h3(v):
    return tidy(prepare.expanding_folds(v.games, "game_date", ["game_id"]).select("game_id", "fold"))


def model_frame(v):
    """Scores of past-looking predictors stand in for features; y is the outcome."""
    return v.pred_wide.select(
        "game_id", "game_date", "season", "split", "y",
        (F.col("venue_id") / 40).alias("x_venue"), (F.col("home_score") / 11 - 0.5).alias("x_form"), F.col("p_m2").alias("x_noise"),
        F.col("p_mkt").alias(MARKET_PROBABILITY),
    )


FEATURES = ["x_venue", "x_form", "x_noise"]


@query("h4_market_baseline", f"SELECT game_id, split, {r('greatest(least(p_mkt, 1 - 1e-6), 1e-6)')} AS p FROM @pred_wide p")
def h4(v):
    return tidy(models.market_baseline(model_frame(v)).select("game_id", "split", "p"))


# settings of the registered fits; the operators' defaults are 200 rounds with a patience of 40
TREES = boosting.Settings(rounds=15, patience=4, depth=3, rate=0.2)


def staged(df):
    """``part``: train, the halves of the validation rows (stopping, calibration), test."""
    halves = prepare.ordered_halves(df.where("split = 'val'"), "game_date", ["game_id"])
    return df.where("split <> 'val'").withColumn("part", F.col("split")).unionByName(halves)


@query("h5_residual_model")
def h5(v):
    """Boosted trees from the market logit on, stopped early on the first half of the validation rows."""
    df = model_frame(v)
    model = models.fit_residual_trees(staged(df), FEATURES, TREES, "part = 'train'", "part = 'stopping'")
    return tidy(models.predict_residual_trees(model, df).select("game_id", "split", "p"))


@query("h5_residual_linear")
def h5_linear(v):
    """Offset logistic fit on the training seasons, predictions for every game."""
    df = model_frame(v)
    model = models.fit_residual(df.where("split = 'train'"), FEATURES)
    return tidy(models.predict_residual(model, df, FEATURES).select("game_id", "split", "p"))


_BINS = 16
_X = {"x_venue": "venue_id / 40.0", "x_form": "home_score / 11.0 - 0.5", "x_noise": "p_m2"}
_TRAIN = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _X.items()) + ", y, 1 / (1 + exp(-ln(p_mkt / (1 - p_mkt)))) AS p FROM @pred_wide w WHERE split = 'train'"
_ROOT = f"""t AS ({_TRAIN}), long AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, p - y AS g, p * (1 - p) AS h FROM t" for c in _X)}),
    qs AS (SELECT feature, quantile_cont(x, [{", ".join(f"{k / _BINS}" for k in range(1, _BINS))}]) AS q FROM long GROUP BY feature),
    cuts AS (SELECT DISTINCT feature, unnest(q) AS cut FROM qs),
    sides AS (SELECT long.feature, cut, sum(g) FILTER (WHERE x < cut) AS gl, sum(h) FILTER (WHERE x < cut) AS hl, sum(g) AS gt, sum(h) AS ht FROM long JOIN cuts ON long.feature = cuts.feature GROUP BY 1, 2),
    scored AS (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM sides WHERE hl >= 1 AND ht - hl >= 1),
    root AS (SELECT * FROM scored WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(gain, 12) DESC, cut) = 1)"""


@query("h5_first_splits", f"WITH {_ROOT} SELECT feature, {r('cut')} AS threshold, {r('gain')} AS gain, {r('hl')} AS left_weight, {r('ht - hl')} AS right_weight FROM root")
def h5_first(v):
    """The best split of the root on every feature, by gradients at the market's probabilities."""
    train = model_frame(v).where("split = 'train'")
    return tidy(boosting.root_splits(train, FEATURES, margin=logit(MARKET_PROBABILITY), bins=_BINS))


@query(
    "h5_one_stump",
    f"""WITH {_ROOT}, best AS (SELECT * FROM root ORDER BY round(gain, 12) DESC, list_position(['x_venue', 'x_form', 'x_noise'], feature) LIMIT 1),
      rows AS (SELECT game_id, split, ln(p_mkt / (1 - p_mkt)) AS z, {", ".join(f"{e} AS {c}" for c, e in _X.items())} FROM @pred_wide w)
      SELECT game_id, split, {r("1 / (1 + exp(-(z + 0.3 * CASE WHEN CASE feature WHEN 'x_venue' THEN x_venue WHEN 'x_form' THEN x_form ELSE x_noise END < cut THEN -gl / (hl + 1) ELSE -(gt - gl) / (ht - hl + 1) END)))")} AS p
      FROM rows, best""",
)
def h5_stump(v):
    """One round of depth one: the market's logit plus one step."""
    df = model_frame(v)
    model = boosting.fit(df, FEATURES, boosting.Settings(rounds=1, depth=1), "split = 'train'", margin=logit(MARKET_PROBABILITY), bins=_BINS)
    return tidy(models.predict_residual_trees(model, df).select("game_id", "split", "p"))


@query("h6_market_free_model")
def h6(v):
    """Boosted trees that never see the market."""
    df = model_frame(v)
    model = boosting.fit(staged(df), FEATURES, TREES, "part = 'train'", "part = 'stopping'")
    return tidy(models.predict_market_free(model, df, FEATURES).select("game_id", "split", "p"))


@query("h6_market_free_linear")
def h6_linear(v):
    df = model_frame(v)
    model = models.fit_market_free(df.where("split = 'train'"), FEATURES)
    return tidy(models.predict_market_free(model, df, FEATURES).select("game_id", "split", "p"))


KEYS = ["game_id", "game_date", "season", "split", "y"]


def _stacked(v):
    """Pretrained on the earlier half of the seasons (split anew among themselves); its logit joins the later rows."""
    df = model_frame(v)
    border = models.pretraining_border(df)
    early = prepare.season_split(df.where(F.col("season") <= border).drop("split"))
    free = boosting.fit(staged(early), FEATURES, TREES, "part = 'train'", "part = 'stopping'")
    return models.stack_logit(df.where(F.col("season") > border), free, FEATURES, KEYS)


@query("h7_two_stage_stack")
def h7(v):
    """Pretrained on early seasons; its logit joins the features of the later ones."""
    return tidy(_stacked(v).select("game_id", "split", models.STACKED_LOGIT))


@query("h8_final_refit")
def h8(v):
    """Rounds found by early stopping, then a refit on train and validation rows; predictions for the test split."""
    df = pin(_stacked(v), "stacked")
    cols = [*FEATURES, models.STACKED_LOGIT]
    stopped = models.fit_residual_trees(staged(df), cols, TREES, "part = 'train'", "part = 'stopping'")
    final = models.fit_residual_trees(df, cols, replace(TREES, rounds=len(stopped["trees"])), "split <> 'test'")
    return tidy(models.predict_residual_trees(final, df.where("split = 'test'")).select("game_id", "p"))


_Z = lambda c: f"ln({c} / (1 - {c}))"
_CAL = f"(SELECT y, {_Z('p_mkt')} AS z, {_Z('p_m1')} - {_Z('p_mkt')} AS r FROM @pred_wide p WHERE split = 'val')"
_LOSS = "avg(greatest(m, 0) + ln(1 + exp(-abs(m))) - y * m)"


def _cal(v):
    return v.pred_wide.where("split = 'val'").select("y", F.col("p_m1").alias("p"), "p_mkt")


@query(
    "h9_platt_grid",
    f"""SELECT cell, {r('a')} AS a, {r('b')} AS b, {r(_LOSS)} AS log_loss FROM (
          SELECT i * 61 + j AS cell, 0.6 + 0.02 * i AS a, -0.15 + 0.005 * j AS b, y, z + (0.6 + 0.02 * i) * r + (-0.15 + 0.005 * j) AS m
          FROM {_CAL} c, (SELECT unnest(range(41)) AS i) gi, (SELECT unnest(range(61)) AS j) gj) x GROUP BY cell, a, b""",
)
def h9(v):
    return tidy(calibrate.platt_grid(_cal(v)))


@query("h9_platt_fit", f"""SELECT 'platt' AS kind, {r('a')} AS a, {r('b')} AS b FROM (SELECT i, j, 0.6 + 0.02 * i AS a, -0.15 + 0.005 * j AS b, avg(greatest(m, 0) + ln(1 + exp(-abs(m))) - y * m) AS loss
    FROM (SELECT i, j, y, z + (0.6 + 0.02 * i) * r + (-0.15 + 0.005 * j) AS m FROM {_CAL} c, (SELECT unnest(range(41)) AS i) gi, (SELECT unnest(range(61)) AS j) gj) x GROUP BY i, j ORDER BY loss, i, j LIMIT 1) z""")
def h9b(v):
    best = calibrate.platt_grid(_cal(v)).orderBy("log_loss", "cell").limit(1)
    return tidy(best.select(F.lit("platt").alias("kind"), "a", "b"))


@query(
    "h10_temperature_grid",
    f"""SELECT cell, {r(_LOSS)} AS log_loss FROM (SELECT cell, y, z + r / exp(ln(0.01) + (ln(20) - ln(0.01)) * cell / 32) AS m
          FROM {_CAL} c, (SELECT unnest(range(33)) AS cell) g) x GROUP BY cell""",
)
def h10(v):
    import math

    low, high = (math.log(t) for t in calibrate.TEMPERATURES)
    cells = [(math.exp(-(low + (high - low) * i / 32)), 0.0) for i in range(33)]
    return tidy(calibrate.grid_losses(calibrate.residual_frame(_cal(v)), cells).select("cell", "log_loss"))


def _newton(steps: int) -> str:
    """The oracle's Newton steps on u = 1 / T from u = 1, one common table each."""
    p = "1 / (1 + exp(-(z + u * r)))"
    parts = [f"c AS {_CAL}", "u0 AS (SELECT CAST(1 AS DOUBLE) AS u)"]
    parts += [f"u{k + 1} AS (SELECT least(greatest(max(u) - avg(r * ({p} - y)) / avg(r * r * ({p}) * (1 - {p})), 0.05), 100.0) AS u FROM c, u{k})" for k in range(steps)]
    return "WITH " + ", ".join(parts)


@query(
    "h10_temperature_fit",
    f"{_newton(12)} SELECT p_m1 AS p, p_mkt, {r('1 / (1 + exp(-(' + _Z('p_mkt') + ' + u * (' + _Z('p_m1') + ' - ' + _Z('p_mkt') + '))))')} AS p_cal FROM @pred_wide w, u12 WHERE split = 'val'".replace("SELECT p_m1 AS p, p_mkt", f"SELECT {r('p_m1')} AS p, {r('p_mkt')} AS p_mkt"),
)
def h10b(v):
    params = calibrate.fit_temperature(_cal(v))
    return tidy(_cal(v).select("p", "p_mkt", calibrate.calibrated(params).alias("p_cal")))


@query(
    "h11_isotonic_fit",
    f"""WITH s AS (SELECT p_m1 AS p, sum(y) AS sy, count(*) AS n, row_number() OVER (ORDER BY p_m1) AS i FROM @pred_wide w WHERE split = 'val' GROUP BY p_m1),
        c AS (SELECT i, p, sum(sy) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn, sy, n FROM s),
        pr AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.sy) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM c a JOIN c b ON b.i >= a.i),
        mn AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM pr),
        fit AS (SELECT i, max(m) AS f FROM mn GROUP BY i)
      SELECT {r('p')} AS p, {r('f')} AS p_cal FROM fit JOIN c ON fit.i = c.i""",
)
def h11(v):
    """Monotone fit; the oracle is the max-min formula over all score intervals."""
    params = calibrate.fit_isotonic(_cal(v))
    return tidy(calibrate.calibrate(_cal(v).select("p").distinct(), params))


@query("h12_calibrator_selection")
def h12(v):
    test = v.pred_wide.where("split = 'test'").select("y", F.col("p_m1").alias("p"), "p_mkt")
    best, metrics = calibrate.select_calibrator(_cal(v), test, methods=("platt", "isotonic", "temperature"))
    return tidy(metrics.withColumn("chosen", (F.col("model") == best["kind"]).cast("int")))


@query(
    "h13_apply_calibrator",
    f"SELECT game_id, {r('1 / (1 + exp(-(' + _Z('p_mkt') + ' + 1.1 * (' + _Z('p_m1') + ' - ' + _Z('p_mkt') + ') - 0.02)))')} AS p_cal FROM @pred_wide p",
)
def h13(v):
    """Parameters go through their stored JSON form."""
    path = scratch_path(v.spark, "calibrator")
    calibrate.save_calibrator(v.spark, {"kind": "platt", "a": 1.1, "b": -0.02}, path)
    params = calibrate.load_calibrator(v.spark, path)
    return tidy(v.pred_wide.select("game_id", calibrate.calibrated(params, "p_m1").alias("p_cal")))


@query("h14_grid_search")
def h14(v):
    """Twenty random candidates on four expanding folds, eighty models of up to 100 rounds grown by the same jobs."""
    folded = pin(prepare.expanding_folds(model_frame(v), "game_date", ["game_id"]), "folds")
    losses = models.search_trees(folded, FEATURES, models.random_candidates(20))
    return tidy(models.best_candidates(losses))


@query("h14_linear_grid")
def h14_linear(v):
    folded = pin(prepare.expanding_folds(model_frame(v), "game_date", ["game_id"]), "folds")
    return tidy(models.best_parameters(models.grid_search(folded, FEATURES, (0.0, 0.1))))


_QB = "(SELECT * FROM @quote_probs q WHERE game_date >= (SELECT game_date FROM (SELECT game_date, row_number() OVER (ORDER BY game_date, game_id) - 1 AS i, count(*) OVER () AS n FROM @pred_wide w WHERE split <> 'train') x WHERE i = n // 2))"
_PROFIT = "CASE WHEN ev_home >= ev_away THEN y * (1 / hr2 - 1) - (1 - y) ELSE (1 - y) * (1 / ar2 - 1) - y END"


@query(
    "h15_back_test",
    f"""SELECT count(*) AS n_bets, {r(f'sum({_PROFIT})')} AS profit, {r(f'sum({_PROFIT}) / count(*)')} AS roi FROM (
          SELECT q.home_opening_prob_raw AS hr2, q.away_opening_prob_raw AS ar2, y, p_m1 / q.home_opening_prob_raw - 1 AS ev_home, (1 - p_m1) / q.away_opening_prob_raw - 1 AS ev_away
          FROM {_QB} q JOIN (SELECT * FROM @pred_wide w WHERE split <> 'train') p ON q.true_game_id = p.game_id
          QUALIFY row_number() OVER (PARTITION BY q.true_game_id ORDER BY greatest(p_m1 / q.home_opening_prob_raw - 1, (1 - p_m1) / q.away_opening_prob_raw - 1) DESC, q.sportsbook, q.quote_id) = 1) b
        WHERE greatest(ev_home, ev_away) > 0""",
)
def h15(v):
    pred = v.pred_wide.where("split <> 'train'").select("game_id", "game_date", F.col("p_m1").alias("p_home"), "is_winner_home")
    q = add_market_probabilities(v.quotes).withColumnRenamed("true_game_id", "game_id")
    return tidy(backtest.back_test(pred, q))


@query(
    "h16_bounded_combination",
    f"SELECT game_id, {r('1 / (1 + exp(-(' + _Z('p_mkt') + ' + 0.7 * 0.5 * tanh(home_score * 0.2 - 1.0))))')} AS p FROM @pred_wide p",
)
def h16(v):
    score = models.linear_score(["home_score"], [0.2], -1.0)
    return tidy(v.pred_wide.select("game_id", models.bounded_combination(score, "p_mkt").alias("p")))
