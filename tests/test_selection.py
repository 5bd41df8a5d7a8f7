import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import prepare
from tallyline.operators.ordering import exact_medians
from tallyline.operators.selection import from_ordered, group_medians, medians, ordered_bits, radix_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf, np.nan])
    bits = ordered_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5]
    assert [from_ordered(int(b)) for b in bits[:-1]] == x[:-1].tolist()


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    cols = {"heavy": np.exp(rng.normal(0, 40, 701)) * rng.choice([-1, 1], 701), "ties": rng.integers(-3, 3, 701).astype(float), "near": rng.normal(7, 1e-12, 701), "hole": rng.normal(size=701)}
    gone = rng.random(701) < 0.3
    rows = [tuple(None if c == "hole" and gone[i] else float(v[i]) for c, v in cols.items()) + (None,) for i in range(701)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "empty"])).repartition(5)
    got = radix_quantiles(df, [*cols, "empty"], PROBS)
    for c, v in cols.items():
        np.testing.assert_allclose(got[c], np.quantile(v[~gone] if c == "hole" else v, PROBS), rtol=1e-13)
    assert got["empty"] == [None] * len(PROBS) and medians(df, ["empty", "ties"], 0.0) == {"empty": 0.0, "ties": np.median(cols["ties"])}
    assert radix_quantiles(df.limit(0), ["ties"], [0.5]) == {"ties": [None]}


def test_many_columns(spark):
    """Three hundred columns in six passes; medians fill the holes."""
    n, names = 40, [f"x{i}" for i in range(300)]
    df = spark.range(n).select("id", *[F.when((F.col("id") + i) % 3 != 0, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 7).alias(c) for i, c in enumerate(names)])
    frame = df.toPandas()
    got = prepare.impute_medians(df, names, "id < 30").toPandas()
    want = frame[names].fillna(frame[frame.id < 30][names].median())
    np.testing.assert_allclose(got[names].to_numpy(), want.to_numpy(), rtol=1e-12)


def test_exchange_does_not_follow_the_rows(spark):
    """Twenty times the rows in the same number of tasks send no more counters than buckets."""
    from tallyline.operators.selection import _counts

    for n in (5_000, 100_000):
        rows = spark.range(0, n, 1, 2).selectExpr("cast(pmod(xxhash64(id), 1000) as double) AS c0")
        assert _counts(rows, ["c0"], {0: [0]}, 0, 11).count() <= 40


def test_medians_of_seasons_side_by_side(spark):
    rng = np.random.default_rng(5)
    rows = [(None if s == 3 else s, float(x) if x > -1.5 else None, None if s == 1 else -float(x)) for s in (1, 2, 3) for x in rng.normal(size=101 + s)]
    df = spark.createDataFrame(rows, "season int, a double, b double").repartition(5)
    found = {r["season"]: (r["a"], r["b"]) for r in group_medians(df, ["a", "b"], "season").collect()}
    assert set(found) == {1, 2, None}
    for season, got in found.items():
        for place, value in enumerate(got, 1):
            own = [r[place] for r in rows if r[0] == season and r[place] is not None]
            assert value is None if not own else abs(value - np.median(own)) < 1e-15
    by_counts = {r["season"]: (r["a"], r["b"]) for r in exact_medians(df.where("season IS NOT NULL"), ["a", "b"], keys=["season"]).collect()}
    assert all(found[s] == q for s, q in by_counts.items())
    assert group_medians(df.limit(0), ["a"], "season").count() == 0
