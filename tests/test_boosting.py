import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyline.functions.numeric import logit
from tallyline.operators import boosting
from tallyline.operators.boosting import Settings, Task

FEATURES = ["a", "b", "c"]


def frame(n=500, seed=0, missing=0.1):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "c": rng.random(n)})
    z = rng.normal(0, 0.7, n)
    true = z + 0.9 * (x.a > 0.3) - 0.7 * (x.b == 2) + 0.2 * x.c
    x["y"] = (rng.random(n) < 1 / (1 + np.exp(-true))).astype(int)
    x["p_mkt"] = 1 / (1 + np.exp(-z))
    for c in FEATURES[:2]:
        x.loc[rng.random(n) < missing, c] = np.nan
    x["part"] = np.where(np.arange(n) < n * 0.7, "train", "stop")
    return x


def table(spark, x):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else (v.item() if hasattr(v, "item") else v) for v in r) for r in x.itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, p_mkt double, part string")


def brute(x, s, margin, bins=64):
    """Plain loops: every threshold of every feature, both sides for missing values."""
    train, stop = x[x.part == "train"], x[x.part == "stop"]
    cuts = {f: sorted(set(np.nanquantile(train[f], np.arange(1, bins) / bins))) for f in FEATURES}
    base = logit_np(x.p_mkt) if margin else np.full(len(x), logit_np(train.y.mean()))
    m = pd.Series(np.array(base), index=x.index)
    t = lambda g: max(abs(g) - s.reg_alpha, 0) ** 2
    w = lambda g, h: -math.copysign(max(abs(g) - s.reg_alpha, 0), g) / (h + s.reg_lambda) * s.rate
    loss = lambda rows: float(np.mean(np.logaddexp(0, m[rows.index]) - rows.y * m[rows.index]))
    history, staged = [loss(stop)], [m.copy()]

    def grow(rows, everyone, depth):
        p = 1 / (1 + np.exp(-m[rows.index]))
        g, h = (p - rows.y), p * (1 - p)
        best = None
        if depth < s.depth:
            for k, f in enumerate(FEATURES):
                for c in [*cuts[f], np.inf]:
                    for left_missing in (False, True):
                        left = (rows[f] < c) | (rows[f].isna() & left_missing)
                        if left_missing and not rows[f].isna().any():
                            continue
                        gl, hl, gt, ht = g[left].sum(), h[left].sum(), g.sum(), h.sum()
                        if min(hl, ht - hl) < s.min_child_weight or left.all() or not left.any():
                            continue
                        gain = t(gl) / (hl + s.reg_lambda) + t(gt - gl) / (ht - hl + s.reg_lambda) - t(gt) / (ht + s.reg_lambda)
                        if gain > max(s.gamma, 1e-6) and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, c, left_missing)
        if best is None:
            step[everyone.index] = w(g.sum(), h.sum())
            return
        _, f, c, left_missing = best
        side = lambda r: (r[f] < c) | (r[f].isna() & left_missing)
        for keep in (True, False):
            grow(rows[side(rows) == keep], everyone[side(everyone) == keep], depth + 1)

    for _ in range(s.rounds):
        step = pd.Series(0.0, index=x.index)
        grow(train, x, 0)
        m = m + step
        history.append(loss(stop))
        staged.append(m.copy())
        done = len(history) - 1
        kept = 1 + int(np.argmin(history[1:]))
        if done - kept >= s.patience:
            break
    return 1 / (1 + np.exp(-staged[1 + int(np.argmin(history[1:]))])), history


def logit_np(p):
    return np.log(p / (1 - p))


def got(spark, x, model, margin):
    keyed = table(spark, x).withColumn("i", F.monotonically_increasing_id())
    return np.array([r.p for r in boosting.predict(model, keyed, margin).orderBy("i").collect()])


@pytest.mark.parametrize("settings,margin", [
    (Settings(rounds=6, depth=3, rate=0.3), True),
    (Settings(rounds=4, depth=2, rate=0.5, reg_alpha=0.4, reg_lambda=2.0, gamma=0.5, min_child_weight=6), False),
    (Settings(rounds=14, patience=3, depth=4, rate=0.8), True),
])
def test_against_numpy(spark, monkeypatch, settings, margin):
    monkeypatch.setattr(boosting, "PIN_ROUNDS", 3)
    x = frame()
    base = logit("p_mkt") if margin else None
    model = boosting.fit(table(spark, x).repartition(3), FEATURES, settings, "part = 'train'", "part = 'stop'", margin=base)
    want, history = brute(x, settings, margin)
    assert [e["stopping"] for e in model["losses"]] == pytest.approx(history, abs=1e-9)
    assert got(spark, x, model, base) == pytest.approx(want.to_numpy(), abs=1e-9)
    if settings.patience == 3:
        assert model["grown"] < 14 and len(model["trees"]) == model["grown"] - 3


def test_no_trees_is_the_market(spark):
    x = frame(100)
    model = boosting.fit(table(spark, x), FEATURES, Settings(rounds=0), "part = 'train'", margin=logit("p_mkt"))
    assert model["trees"] == [] and got(spark, x, model, logit("p_mkt")) == pytest.approx(x.p_mkt.to_numpy())
    with pytest.raises(ValueError, match="margin"):
        boosting.predict(model, table(spark, x))


def test_many_models_equal_single_fits(spark):
    x = frame(300, 3)
    df = table(spark, x).withColumn("fold", F.when(F.col("part") == "stop", 1).otherwise(0))
    tasks = [
        Task(Settings(rounds=5, patience=2, depth=2, rate=0.6, subsample=0.6, colsample=0.7, seed=1), "part = 'train'", "part = 'stop'"),
        Task(Settings(rounds=3, depth=4, rate=0.2, reg_lambda=3.0), "fold < 1", "fold = 1"),
        Task(Settings(rounds=4, depth=1), "part = 'train' AND b < 3", "part = 'stop'"),
    ]
    together = boosting.fit_many(df, FEATURES, tasks, margin=logit("p_mkt"))
    for task, many in zip(tasks[:2], together):
        one = boosting.fit(df, FEATURES, task.settings, task.train, task.stopping, margin=logit("p_mkt"))
        flat = lambda m: [(n["feature"], n["bin"], round(n["value"], 9)) for t in m["trees"] for n in t]
        assert flat(one) == flat(many) and one["grown"] == many["grown"]
    assert all(len(t) <= 3 for t in together[2]["trees"])


def test_gains_and_round_trip(spark, tmp_path):
    x = frame()
    model = boosting.fit(table(spark, x), FEATURES, Settings(rounds=5, depth=3), "part = 'train'", "part = 'stop'", margin=logit("p_mkt"))
    gains = {r.feature: r.gain for r in boosting.gains(model, spark).collect()}
    assert gains["b"] > 0 and gains["a"] > gains.get("c", 0)
    boosting.save(model, spark, str(tmp_path / "m"))
    back = boosting.load(spark, str(tmp_path / "m"))
    assert back == model and got(spark, x, back, logit("p_mkt")) == pytest.approx(got(spark, x, model, logit("p_mkt")))


def test_edges(spark):
    x = frame(60)
    df = table(spark, x).withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(1.0)).withColumn("y", F.lit(1))
    model = boosting.fit(df, FEATURES, Settings(rounds=2, depth=2), "part = 'train'", margin=logit("p_mkt"))
    assert len(model["trees"]) == 2 and boosting.predict(model, df, logit("p_mkt")).where("p > p_mkt").count() == 60
    nobody = boosting.fit(df.where("y = 7"), FEATURES, Settings(rounds=2), margin=logit("p_mkt"))
    assert boosting.predict(nobody, df, logit("p_mkt")).where("abs(p - p_mkt) > 1e-9").count() == 0


def test_candidates_on_a_fold_share_roles_and_the_margin(spark):
    tasks = [Task(Settings(depth=d), f"part = '{a}'", f"part = '{b}'") for d in (1, 2, 3, 4) for a, b in (("train", "stop"), ("stop", "train"))]
    rows = boosting.binned(table(spark, frame(50)), FEATURES, [[0.0]] * 3, "y", logit("p_mkt"), tasks)
    sizes = rows.selectExpr("length(codes) AS c", "length(roles) AS r", "length(margins) AS m").distinct().collect()
    assert [tuple(r) for r in sizes] == [(3, 2, 8)]


def test_walk_equals_a_plain_descent():
    rng = np.random.default_rng(1)
    nodes = [{"feature": 0, "bin": 2, "missing_left": True, "left": 1, "right": 2, "value": 0.0}, {"feature": -1, "bin": 0, "missing_left": False, "left": -1, "right": -1, "value": 1.0},
             {"feature": 1, "bin": 1, "missing_left": False, "left": 3, "right": 4, "value": 0.0}, *[{"feature": -1, "bin": 0, "missing_left": False, "left": -1, "right": -1, "value": v} for v in (2.0, 3.0)]]
    codes = rng.integers(0, 5, (200, 2)).astype(np.uint8)
    plain = []
    for row in codes:
        n = 0
        while nodes[n]["feature"] >= 0:
            c = row[nodes[n]["feature"]]
            n = nodes[n]["left"] if (nodes[n]["missing_left"] if c == 0 else c <= nodes[n]["bin"]) else nodes[n]["right"]
        plain.append(n)
    walk = boosting._Walk(boosting._arrays(nodes), 2, 5)
    assert walk.leaves(codes.ravel(), np.arange(200) * 2).tolist() == plain


@pytest.mark.parametrize("width", [4, 66])
def test_splits_at_the_driver_equal_those_of_the_exchange(spark, width):
    rng = np.random.default_rng(5)
    settings = [Settings(), Settings(reg_alpha=0.3, reg_lambda=2.0, gamma=0.4, min_child_weight=3), Settings(min_child_weight=1e9)]
    rows = [(k, n, f, int(b), float(rng.integers(-4, 5)) / 2, float(rng.integers(1, 5)) / 4) for k in range(3) for n in (0, 3, 4) for f in ((0, 2) if n == 3 else (0, 1, 2)) for b in rng.choice(width, width) for _ in range(2)]
    rows += [(k, n, 0, 0, 5.0 + k, 9.0 * k) for k in range(3) for n in (-1, -2)]
    sums = spark.createDataFrame(rows, "model int, node int, feature int, bin int, g double, h double")
    whole = sums.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    want = {(r.model, r.node): (r.gt, r.ht, r.best and (r.best.feature, r.best.bin, r.best.missing_left, r.best.gl, r.best.hl, pytest.approx(r.best.gain))) for r in boosting.best_splits(whole, settings).collect()}
    found = boosting._splits(sums.toArrow(), settings, 3, width)
    assert {k: (b.gt, b.ht, b.best and tuple(b.best)) for k, b in found.items()} == want
    assert sum(b.best is not None for b in found.values()) > 1


def test_small_levels_take_no_exchange(spark, monkeypatch):
    x, wholes, level = frame(), [], boosting._level
    df = table(spark, x).repartition(3)
    monkeypatch.setattr(boosting, "_level", lambda *a: wholes.append(a[-1] if len(a) > 6 else True) or level(*a))
    tasks = [Task(Settings(rounds=3, depth=d, rate=0.5), "part = 'train'", "part = 'stop'") for d in (2, 4)]
    here = boosting.fit_many(df, FEATURES, tasks, margin=logit("p_mkt"))
    assert wholes and not any(wholes)
    monkeypatch.setattr(boosting, "DRIVER_CELLS", 0)
    there = boosting.fit_many(df, FEATURES, tasks, margin=logit("p_mkt"))
    assert wholes[-1] is True
    for a, b in zip(here, there):
        assert [e["stopping"] for e in a["losses"]] == pytest.approx([e["stopping"] for e in b["losses"]], abs=1e-12)
        assert [[(n["feature"], n["bin"], n["missing_left"]) for n in t] for t in a["trees"]] == [[(n["feature"], n["bin"], n["missing_left"]) for n in t] for t in b["trees"]]


def test_levels_read_blocks_of_rows(spark, monkeypatch):
    records, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda rows, *rest: records.append(rows.count()) or level(rows, *rest))
    model = boosting.fit(table(spark, frame(2000)).coalesce(1), FEATURES, Settings(rounds=1, depth=1), "part = 'train'", "part = 'stop'", margin=logit("p_mkt"))
    assert len(model["trees"]) == 1 and 0 < max(records) <= 2000 / 50


@pytest.mark.parametrize("features", [0, 3])
def test_blocks_hold_every_row_once(monkeypatch, features):
    monkeypatch.setattr(boosting, "PIECE", 7)
    rng = np.random.default_rng(2)
    rows = {"codes": rng.integers(0, 9, (23, features)).astype(np.uint8), "y": rng.random((23, 1)), "roles": rng.integers(0, 3, (23, 2)).astype(np.uint8), "margins": rng.random((23, 2)), "draw": rng.integers(0, 99, (23, 1))}
    batch = boosting._blocks(rows, 200)  # 34 or 37 bytes a row: 5 rows a block
    assert batch.num_rows == 5 and boosting._blocks(rows, 0).num_rows == 23
    found = list(boosting._pieces([batch.slice(0, 2), batch.slice(0, 0), batch.slice(2)], features, 2, 2))
    assert [len(p["y"]) for p in found] == [7, 3, 7, 6]
    for c, m in rows.items():
        assert (np.concatenate([p[c] for p in found]) == m).all()


def test_moved_margins_stay_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(boosting, "PIN_ROUNDS", 1)
    records, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda rows, *rest: records.append(rows.count()) or level(rows, *rest))
    model = boosting.fit(table(spark, frame(2000)).coalesce(1), FEATURES, Settings(rounds=2, depth=1), "part = 'train'", "part = 'stop'")
    assert model["grown"] == 2 and len(records) == 3 and 0 < min(records) and max(records) <= 2000 / 50


def test_fit_reads_its_input_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    x = frame(200)
    df = table(spark, x)
    tasks = [Task(Settings(rounds=0), "part = 'train'", "part = 'stop'"), Task(Settings(rounds=0), "b = 2"), Task(Settings(rounds=0), "b = 7")]
    starts = [m["start"] for m in boosting.fit_many(df.mapInArrow(seen, df.schema), FEATURES, tasks)]
    assert starts == pytest.approx([logit_np(x.y[x.part == "train"].mean()), logit_np(x.y[x.b == 2].mean()), 0.0])
    assert read.value == 2 * 200  # for the thresholds and to be binned


def test_predictions_read_only_what_is_asked_for(spark, tmp_path):
    x = frame(60)
    model = boosting.fit(table(spark, x), FEATURES, Settings(rounds=1, depth=1), "part = 'train'")
    table(spark, x).withColumn("note", F.lit("n")).write.parquet(str(tmp_path / "x"))
    scored = boosting.predict(model, spark.read.parquet(str(tmp_path / "x")))
    assert scored.columns == [*x.columns, "note", "p"]
    plan = scored.select("part", "p")._jdf.queryExecution().executedPlan().toString()
    assert "part:string" in plan and "note" not in plan and "p_mkt" not in plan


@pytest.mark.parametrize("features,exchanges", [(3, 1), (100, 2)])
def test_small_nodes_meet_in_one_exchange(spark, features, exchanges):
    names = [f"x{i}" for i in range(features)]
    df = spark.range(40).select(*[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(names)], (F.col("id") % 2).alias("y"))
    model = boosting._Grown(Task(Settings()), features)
    model.start_tree()
    sums = boosting._level(boosting.binned(df, names, [[0.5]] * features, "y", None, [Task(Settings())]), [model], 0, False, features, 66)
    best = boosting.best_splits(sums, [Settings()])
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == exchanges
    assert [(r.model, r.node, r.ht) for r in best.collect()] == [(0, 0, 10.0)]
