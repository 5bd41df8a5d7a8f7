import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import isotonic


def brute(p, y, at):
    """One pass over the sorted scores, then linear interpolation between the ends of the blocks."""
    blocks = []
    for x in np.unique(p):
        blocks.append([x, x, y[p == x].sum(), (p == x).sum()])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] > blocks[-1][2] / blocks[-1][3]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    xs = [x for lo, hi, *_ in blocks for x in (lo, hi)]
    return np.interp(at, xs, [s / n for *_, s, n in blocks for _ in (0, 1)])


def fitted(spark, p, y, at, range_rows):
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    table, cuts = isotonic.fit(df, range_rows=range_rows)
    asked = spark.createDataFrame([(i, float(a)) for i, a in enumerate(at)], "i int, p double")
    got = isotonic.apply(asked, table, cuts).orderBy("i").collect()
    return np.array([r.p_cal for r in got]), cuts


@pytest.mark.parametrize("seed,range_rows", [(0, 10**6), (0, 40), (1, 15), (2, 7)])
def test_ranges_give_the_fit_of_one_pass(spark, seed, range_rows):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(500), 3)
    y = (rng.random(500) < np.clip(p + 0.3 * np.sin(9 * p), 0, 1)).astype(int)
    at = np.concatenate([rng.random(80) * 1.4 - 0.2, p[:40]])
    got, cuts = fitted(spark, p, y, at, range_rows)
    assert got == pytest.approx(brute(p, y, at), abs=1e-12) and (bool(cuts) or range_rows > 40)


def test_falling_and_rising_scores(spark):
    """Everything pools into one block over all ranges; nothing pools at all."""
    p = np.arange(200) / 200
    for y in ((p < 0.5).astype(int), (p >= 0.5).astype(int), np.ones(200, int)):
        got, _ = fitted(spark, p, y, p, 9)
        assert got == pytest.approx(brute(p, y, p), abs=1e-12)


def test_a_million_distinct_scores(spark):
    """No list of thresholds reaches the driver: the table has one row per block, the cuts one number per range."""
    df = spark.range(1_000_000).selectExpr("(id + 0.5) / 1e6 AS p", "cast(pmod(xxhash64(id), 1000) < id / 1000 as int) AS y")
    table, cuts = isotonic.fit(df, range_rows=100_000)
    out = isotonic.apply(df, table, cuts)
    stats = out.agg(F.count("p_cal").alias("n"), F.avg(F.abs(F.col("p_cal") - F.col("p"))).alias("gap"), F.sum("p_cal").alias("s"), F.sum("y").alias("y")).first()
    assert stats.n == 1_000_000 and stats.gap < 0.02 and stats.s == pytest.approx(stats.y, rel=1e-6)
    falls = out.selectExpr("p", "p_cal", "floor(p * 100) AS k").groupBy("k").agg(F.min("p_cal").alias("a"), F.max("p_cal").alias("b")).orderBy("k").collect()
    assert all(x.b <= y.a + 1e-12 for x, y in zip(falls, falls[1:])) and len(cuts) < 10


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(0.2, 1), (None, 1), (float("nan"), 0), (0.4, None), (0.4, 0)], "p double, y int")
    table, cuts = isotonic.fit(df)
    assert [r.p_cal for r in isotonic.apply(df, table, cuts).collect() if r.p is not None and r.p == r.p] == [0.5, 0.5, 0.5]
    table, cuts = isotonic.fit(df.limit(0))
    assert {r.p_cal for r in isotonic.apply(df, table, cuts).collect()} == {None}
