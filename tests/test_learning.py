import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyline.operators import calibrate, evaluate, league, models, prepare, priors, sides
from tallyline.operators.history import Metric


def preds(spark, y, p, model="m", split="s"):
    return spark.createDataFrame([(model, split, int(a), float(b)) for a, b in zip(y, p)], "model string, split string, y int, p double")


def test_metrics_of_two_rows(spark):
    r = evaluate.probability_metrics(preds(spark, [0, 1], [0.25, 0.75])).first()
    assert r["log_loss"] == pytest.approx(-math.log(0.75)) and r["brier"] == pytest.approx(0.0625) and r["roc_auc"] == 1.0


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert evaluate.roc_auc(preds(spark, y, p)).first()["roc_auc"] == pytest.approx(want)
    assert evaluate.roc_auc(preds(spark, [1, 1], [0.2, 0.3])).first()["roc_auc"] is None


def test_calibration_error_and_merged_bins(spark):
    rng = np.random.default_rng(2)
    p = rng.random(400)
    y = (rng.random(400) < p).astype(int)
    edges = np.quantile(p, np.linspace(0, 1, 8))
    edges[0], edges[-1] = 0, 1
    idx = np.digitize(p, edges[1:-1], right=True)
    want = sum(abs(y[idx == b].mean() - p[idx == b].mean()) * (idx == b).sum() for b in range(7)) / 400
    bins = evaluate.calibration_bins(preds(spark, y, p), 7, "quantile")
    assert evaluate.calibration_error(bins).first()["ece"] == pytest.approx(want)
    merged = evaluate.merge_small_bins(bins, 100).orderBy("bin").toPandas()
    assert merged["n"].sum() == 400 and (merged["n"][:-1] >= 100).all()


def test_stability_score(spark):
    losses = [0.70, 0.68, 0.67, 0.69, 0.72, 0.74]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(losses)], "run_id int, epoch int, val_loss double")
    smooth = [np.mean(losses[i : i + 5]) for i in range(2)]
    want = min(smooth) + 0.25 * (np.mean(losses[-5:]) - 0.67)
    assert evaluate.stability_score(df).first()["stability"] == pytest.approx(want)


@pytest.fixture(scope="module")
def residuals(spark):
    rng = np.random.default_rng(5)
    z, r = rng.normal(0, 0.6, 600), rng.normal(0, 0.8, 600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(z + 0.8 * r + 0.05)))).astype(int)
    sig = lambda t: 1 / (1 + np.exp(-t))
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(y, sig(z + r), sig(z))]
    return z, r, y, spark.createDataFrame(rows, "y int, p double, p_mkt double")


def test_platt_against_brute_force(residuals):
    z, r, y, df = residuals
    loss = lambda a, b: np.mean(np.logaddexp(0, z + a * r + b) - y * (z + a * r + b))
    want = min(((loss(a, b), i) for i, (a, b) in enumerate((a, b) for a in calibrate.SLOPES for b in calibrate.OFFSETS)))
    got = calibrate.fit_platt(df)
    i = want[1]
    assert (got["a"], got["b"]) == (calibrate.SLOPES[i // 61], calibrate.OFFSETS[i % 61])


def test_temperature_near_the_optimum(residuals):
    z, r, y, df = residuals
    grid = np.linspace(0.3, 6, 6000)
    loss = [np.mean(np.logaddexp(0, z + r / t) - y * (z + r / t)) for t in grid]
    assert calibrate.fit_temperature(df)["T"] == pytest.approx(grid[int(np.argmin(loss))], rel=2e-3)


def test_temperature_at_the_bounds(spark):
    rows = lambda y: spark.createDataFrame([(y, 0.9, 0.5), (y, 0.8, 0.5)], "y int, p double, p_mkt double")
    assert calibrate.fit_temperature(rows(1))["T"] == pytest.approx(0.01) and calibrate.fit_temperature(rows(0))["T"] == pytest.approx(20.0)
    assert calibrate.fit_temperature(rows(1).limit(0))["T"] == 1.0
    assert calibrate.fit_temperature(rows(1).withColumn("p", F.col("p_mkt")))["T"] == 1.0


def test_calibrators_round_trip_and_need_the_market(spark, residuals, tmp_path):
    df = residuals[3]
    params = calibrate.fit_isotonic(df)
    stored = calibrate.save_calibrator(spark, params, str(tmp_path / "c"))
    assert calibrate.load_calibrator(spark, str(tmp_path / "c")) == stored and stored["thresholds"].startswith(str(tmp_path))
    out = calibrate.calibrate(df, stored).orderBy("p").toPandas()
    assert (np.diff(out["p_cal"]) >= -1e-12).all() and out["p_cal"].between(0, 1).all()
    with pytest.raises(ValueError):
        calibrate.calibrated({"kind": "platt", "a": 1, "b": 0}, "p", None)


def test_selection_takes_the_least_error(residuals):
    best, metrics = calibrate.select_calibrator(residuals[3], methods=("platt", "temperature"), metric="logloss")
    table = {r["model"]: r["logloss"] for r in metrics.collect()}
    assert table[best["kind"]] == min(table.values())


def test_offset_model_solves_the_score_equations(spark):
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=800), rng.normal(size=800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(z + 0.7 * x - 0.2)))).astype(int)
    p = 1 / (1 + np.exp(-z))
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(x, y, p)], "x double, y int, p_open_home_median_nv double")
    model = models.fit_residual(df, ["x"])
    out = models.predict_residual(model, df, ["x"]).toPandas()
    gap = out["y"] - out["p"]
    assert abs(gap.sum()) < 1e-3 and abs((gap * out["x"]).sum()) < 1e-3
    assert model.coefficients[0] == pytest.approx(0.7, abs=0.25)


def test_stack_checks_the_signature(spark):
    df = spark.createDataFrame([(1.0, 0, 0.4), (2.0, 1, 0.6), (3.0, 0, 0.5)], "x double, y int, p_open_home_median_nv double")
    free = models.fit_market_free(df, ["x"])
    out = models.stack_logit(df, free, ["x"], keys=["y"])
    assert models.STACKED_LOGIT in out.columns
    with pytest.raises(ValueError, match="signatures differ"):
        models.stack_logit(df.withColumn("extra", F.lit(1.0)), free, ["x"], keys=["y"])


def test_prior_tiers(spark):
    rows = [(1, 1, 3.2, 25.0, 1), (2, 1, 2.4, 25.0, 0), (3, 1, 1.5, 10.0, 1), (4, 1, 4.5, 30.0, 1)]
    prev = spark.createDataFrame(rows, "player_id int, season int, fip double, ip double, gs int")
    cur = spark.createDataFrame([(i, 2, 9.0, 1.0, 1) for i in (1, 2, 3, 9)], "player_id int, season int, fip double, ip double, gs int")
    metric = (Metric("fip", "fip", "ip", 20),)
    got = {r["player_id"]: r["prior_fip"] for r in priors.with_season_priors(cur, prev, metric, {"ip": 20}, role="gs > 0").collect()}
    league_mean = (3.2 * 25 + 1.5 * 10 + 4.5 * 30) / 65
    assert got[1] == pytest.approx(3.2) and got[2] == pytest.approx(2.4)  # own role, then any role
    assert got[3] == pytest.approx(league_mean) and got[9] == pytest.approx(league_mean)  # below the floor, unknown


def test_league_average_warm_up_counts_buckets(spark):
    rows = [(d, 0, t, 0.1 * t + 0.01 * d, 4.0) for d in range(1, 6) for t in range(1, 5)] * 3
    df = spark.createDataFrame(rows, "day int, dh int, team int, woba double, pa double").selectExpr("make_date(2024, 4, day) AS game_date", "dh", "team", "woba", "pa")
    got = {r["game_date"].day: r["avg_woba"] for r in league.league_averages(df, {"woba": ("pa", "higher")}, df).collect()}
    v = lambda days: np.mean([0.1 * t + 0.01 * d for d in days for t in range(1, 5)])
    full = v(range(1, 6))
    # 4 and 8 buckets before days 2 and 3: full season; 12 before day 4: the past only
    assert got == pytest.approx({1: full, 2: full, 3: full, 4: v(range(1, 4)), 5: v(range(1, 5))})


def test_perspective_flip_twice_is_the_identity(spark):
    rows = [(1, 1, 0.6, 2.0, 5.0, 1.0, 7.0, 3.0)]
    df = spark.createDataFrame(rows, "game_id int, is_winner_home int, p_open_home_median_nv double, home_win_pct_season double, away_win_pct_season double, home_woba_season double, away_woba_season double, homegrown_metric double")
    both = sides.duplicate_perspective(df, batter=(), starter=(), reliever=(), team=())
    flipped = both.where("NOT focal_is_home").drop("focal_is_home")
    r = flipped.first()
    assert r["is_winner_home"] == 0 and r["p_open_home_median_nv"] == pytest.approx(0.4)
    assert r["home_win_pct_season"] == 5.0 and r["home_away_win_pct_season_diff"] == 3.0 and r["homegrown_metric"] == 3.0
    again = sides.duplicate_perspective(flipped, batter=(), starter=(), reliever=(), team=()).where("NOT focal_is_home").first()
    assert again["home_woba_season"] == 1.0 and again["is_winner_home"] == 1 and again["home_away_woba_season_diff"] == -6.0


def test_season_split_and_folds(spark):
    rows = [(s, f"{s}-05-{d:02d}", i) for s in (2022, 2023) for d in range(1, 11) for i in (s * 100 + d,)]
    df = spark.createDataFrame(rows, "season int, d string, id int").selectExpr("season", "to_date(d) AS game_date", "id")
    got = prepare.season_split(df).groupBy("split").count().toPandas().set_index("split")["count"].to_dict()
    assert got == {"train": 10, "val": 6, "test": 4}
    folds = prepare.expanding_folds(df, "game_date", ["id"]).groupBy("fold").count().toPandas().set_index("fold")["count"].to_dict()
    assert folds == {-1: 4, 0: 4, 1: 4, 2: 4, 3: 4}


def test_scaler_uses_population_std_and_training_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "train"), (9.0, 5.0, "test")], "a double, b double, split string")
    got = [(r["a"], r["b"]) for r in prepare.standardize(df, ["a", "b"], "split = 'train'").collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0), (7.0, 0.0)]


def test_bad_probabilities_are_reported(spark):
    df = spark.createDataFrame([("s", 0.4), ("s", 1.2)], "split string, p double")
    with pytest.raises(ValueError, match="bad probabilities"):
        prepare.require_probabilities(df, "p")


def test_market_free_scores_need_no_model_in_the_plan(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-a)))) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    model = models.fit_market_free(df, ["a", "b"])
    out = models.predict_market_free(model, df, ["a", "b"])
    assert "UDF" not in out._jdf.queryExecution().toString()
    expected = model.transform(models.assemble(df, ["a", "b"])).select(vector_to_array("probability")[1].alias("p"))
    assert np.allclose([r.p for r in out.collect()], [r.p for r in expected.collect()], atol=1e-12)
    with pytest.raises(Exception, match="NULL or NaN"):
        models.predict_market_free(model, spark.createDataFrame([(None, 1.0, 1)], "a double, b double, y int"), ["a", "b"]).collect()


def test_bins_neither_sort_nor_deal_the_predictions(spark):
    df = preds(spark, [0, 1, 1, 0], [0.05, 0.1, 0.55, 0.95])
    uniform = evaluate.calibration_bins(df, 10, "uniform")
    plan = uniform._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan
    assert sorted((r.bin, r.n, r.sum_y, len(r.edges)) for r in uniform.collect()) == [(0, 2, 1.0, 11), (5, 1, 1.0, 11), (9, 1, 0.0, 11)]
    quantile = evaluate.calibration_bins(df, 2, "quantile")
    assert "SortAggregate" not in quantile._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.bin, r.n, len(r.edges)) for r in quantile.collect()) == [(0, 2, 3), (1, 2, 3)]


def test_the_search_has_its_whole_rounds_and_patience(spark, monkeypatch):
    from tallyline.plans import catalog

    asked = []

    def search(folded, features, candidates, *rest):
        asked.extend(candidates)
        return spark.createDataFrame([(0, 0, 1, 0.5)], "candidate int, fold int, rounds int, log_loss double")

    monkeypatch.setattr(models, "search_trees", search)
    assert catalog.QUERIES["h14_grid_search"](spark, "/root/testdata/sf0.001").count() == 1
    assert len(asked) == 20 and {(c.rounds, c.patience) for c in asked} == {(100, 20)}
    assert {c.depth for c in asked} == set(range(2, 9))
