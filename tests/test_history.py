"""Running state against pandas, in all three physical shapes."""

import numpy as np
import pandas as pd
import pytest

from tallyline.operators import history
from tallyline.operators.history import HistorySize, Metric, measure, rolling_rates, running_state

HALFLIVES = (2, 5)


@pytest.fixture(scope="module")
def log():
    rng = np.random.default_rng(7)
    rows = []
    for e, n in (("hot", 900), ("b", 60), ("c", 1), ("d", 25)):
        days = np.sort(rng.integers(0, 40, n))
        for i in range(n):
            v = None if rng.random() < 0.1 else float(np.round(rng.normal(0, 10), 3))
            rows.append((e, int(days[i]), i, v, float(rng.integers(0, 4))))
    return pd.DataFrame(rows, columns=["entity", "day", "i", "v", "w"])


def expected(log):
    out = log.sort_values(["entity", "day", "i"]).copy()
    g = out["entity"]
    v, w = out["v"].fillna(0), out["w"].fillna(0)
    out["seq"] = out.groupby("entity").cumcount()
    out["s"] = v.groupby(g).cumsum().groupby(g).shift(1)
    for h in HALFLIVES:
        for n, x in (("x", v * w), ("y", w)):
            e = x.groupby(g).transform(lambda t: t.ewm(halflife=h, adjust=False).mean())
            out[f"{n}{h}"] = e.groupby(g).shift(1)
    out["last"] = out.groupby("entity")["day"].shift(1)
    return out.reset_index(drop=True)


def actual(spark, log, **options):
    df = spark.createDataFrame(log.astype(object).where(log.notna(), None), "entity string, day long, i long, v double, w double")
    ewms = {f"x{h}": ("coalesce(v, 0) * w", h) for h in HALFLIVES} | {f"y{h}": ("w", h) for h in HALFLIVES}
    out = running_state(
        df, ["entity"], ["day", "i"], sums={"s": "v"}, ewms=ewms, latest={"last": "day"}, clock="day", **options
    )
    return out.toPandas().sort_values(["entity", "day", "i"]).reset_index(drop=True)


@pytest.mark.parametrize(
    "options",
    [
        {"block_factor": 10_000},  # one window
        {"block_factor": 30},  # blocks of 60 and 150 rows
        {"block_factor": 30, "segment_rows": 100},  # the hot entity is cut by days
        {"block_factor": 30, "segment_rows": 20},
    ],
)
def test_running_state(spark, log, options):
    want, got = expected(log), actual(spark, log, **options)
    assert list(got["seq"]) == list(want["seq"])
    tolerance = 1e-9 if options["block_factor"] > 100 else 2.0 ** -28
    for c in ["s", "last"]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, equal_nan=True)
    for h in HALFLIVES:
        for n in ("x", "y"):
            np.testing.assert_allclose(
                got[f"{n}{h}"].astype(float), want[f"{n}{h}"].astype(float), rtol=1e-9, atol=20 * tolerance, equal_nan=True
            )


@pytest.mark.parametrize("options", [{}, {"segment_rows": 500}])
def test_a_long_gap_keeps_the_rate(spark, options):
    """Weight on the first ten rows only: after 960 half-lives the rate is still that of the recursion."""
    df = spark.range(2_900).selectExpr("'p' AS entity", "id AS day", "if(id < 10, double(id), 99D) AS v", "if(id < 10, 1D, 0D) AS w")
    out = running_state(df, ["entity"], ["day"], ewms={"n": ("v * w", 3), "d": ("w", 3)}, clock="day", **options)
    rates = [r.rate for r in out.orderBy("day").selectExpr("try_divide(n, d) AS rate").collect()]
    a, n, d = 0.5 ** (1 / 3), 0.0, 0.0
    for i in range(10):
        n, d = (float(i), 1.0) if i == 0 else (a * n + (1 - a) * i, a * d + (1 - a))
    np.testing.assert_allclose(rates[10:], n / d, rtol=1e-9)


def test_segments_bound_the_rows_of_a_window(spark, log):
    from tallyline.operators.history import hot_entities

    df = spark.createDataFrame(log[["entity", "day"]], "entity string, day long")
    hot = hot_entities(df, ["entity"], "day", 100).toPandas()
    assert list(hot["entity"]) == ["hot"]
    width, first = int(hot["__width"][0]), int(hot["__first"][0])
    rows = log[log.entity == "hot"]
    assert rows.groupby((rows.day - first) // width).size().max() <= 100


def test_measure(spark, log):
    df = spark.createDataFrame(log[["entity"]], "entity string")
    assert measure(df, ["entity"]) == HistorySize(986, 900)


def test_leakage_later_rows_do_not_matter(spark):
    """Changing a row leaves it and everything before it as it was."""
    base = [("p", d, float(d), 1.0, 10.0) for d in range(8)]
    changed = [(e, d, 99.0 if d >= 5 else v, w, p) for e, d, v, w, p in base]
    metric = (Metric("v", "v", "w", 3),)

    def run(rows):
        df = spark.createDataFrame(rows, "entity string, day long, v double, w double, prior_v double")
        out = rolling_rates(df, ["entity"], ["day"], metric, (2,), date=None, clock="day")
        return out.orderBy("day").select("v_season", "v_ewm_h2").collect()

    assert run(base)[:6] == run(changed)[:6]
    assert run(base)[6:] != run(changed)[6:]


def test_first_row_is_the_prior_and_zero_weight_keeps_it(spark):
    rows = [("p", 1, 5.0, 0.0, 7.0), ("p", 2, 4.0, 2.0, 7.0), ("p", 3, 1.0, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "entity string, day long, v double, w double, prior_v double")
    out = rolling_rates(df, ["entity"], ["day"], (Metric("v", "v", "w", 2),), (4,), date=None, clock="day")
    got = [tuple(r) for r in out.orderBy("day").select("v_season", "v_ewm_h4").collect()]
    assert got[0] == (7.0, 7.0) and got[1] == (7.0, 7.0)
    assert got[2] == pytest.approx((0.5 * 4 + 0.5 * 7, 0.5 * 4 + 0.5 * 7))


def test_a_task_holds_a_bounded_number_of_rows(spark, monkeypatch):
    assert history.HistorySize(18_000_000, 86_000).segment_rows == 25_000
    df = spark.range(2000).selectExpr("id % 8 AS e", "id AS t", "double(id % 7) AS x")
    plain = history.running_state(df, ["e"], ["t"], sums={"s": "x"}, ewms={"w": ("x", 2)}, clock="t")
    monkeypatch.setattr(history, "TASK_ROWS", 100)
    cut = history.running_state(df, ["e"], ["t"], sums={"s": "x"}, ewms={"w": ("x", 2)}, clock="t", segment_rows=50)
    assert history.dealt(df, ["e"], history.measure(df, ["e"])).rdd.getNumPartitions() == 20
    key = lambda r: r.t
    for a, b in zip(sorted(plain.collect(), key=key), sorted(cut.collect(), key=key)):
        assert (a.t, a.seq, a.s) == (b.t, b.seq, b.s) and (a.w == b.w or a.w == pytest.approx(b.w))
