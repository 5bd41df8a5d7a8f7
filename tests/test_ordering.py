import numpy as np
import pytest

from tallyline.operators import evaluate
from tallyline.operators.ordering import exact_medians, exact_quantiles, ordered_cumsum, row_positions

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(3)
    heavy = np.exp(rng.normal(0, 4, 700))
    hot = np.where(rng.random(500) < 0.4, 7.0, rng.normal(7, 1e-6, 500))
    return {"heavy": heavy, "hot": hot, "one": np.array([3.5])}


def test_exact_quantiles(spark, samples):
    rows = [(k, float(x)) for k, xs in samples.items() for x in xs] + [("heavy", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["x"], PROBS, ["k"]).collect()}
    for k, xs in samples.items():
        np.testing.assert_allclose(got[k], np.quantile(xs, PROBS), rtol=1e-12)


def test_medians_of_several_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (10.0, None)], "a double, b double")
    row = exact_medians(df, ["a", "b"], default=0.0).first()
    assert (row["a"], row["b"]) == (2.0, 0.0)


def test_ordered_cumsum(spark, samples):
    xs = np.unique(samples["heavy"])
    df = spark.createDataFrame([("g", float(x), i + 1) for i, x in enumerate(xs)], "g string, x double, n long")
    got = ordered_cumsum(df, ["g"], "x", ["n"]).orderBy("x").toPandas()
    want = np.concatenate([[0], np.cumsum(np.arange(1, len(xs) + 1))[:-1]])
    assert list(got["before_n"]) == list(want)


def test_row_positions(spark):
    rows = [(d, i) for d in (3, 1, 2) for i in range(4)]
    df = spark.createDataFrame(rows, "day long, id long")
    got = row_positions(df, "day", ["id"]).orderBy("day", "id").toPandas()
    assert list(got["pos"]) == list(range(12))


def test_more_than_ten_thousand_groups(spark):
    df = spark.range(30_003).selectExpr("id % 10001 AS k", "cast(id DIV 10001 AS double) AS x", "cast(id % 2 AS int) AS y", "(1 + id DIV 10001) / 10D AS p")
    q = exact_quantiles(df, ["x"], [0.5, 1.0], ["k"])
    assert q.count() == 10_001 and q.where("q[0] <> 1 OR q[1] <> 2").count() == 0
    auc = evaluate.roc_auc(df, ["k"])
    assert auc.count() == 10_001
    assert "SinglePartition" not in auc._jdf.queryExecution().executedPlan().toString()
