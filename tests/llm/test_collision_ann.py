import numpy as np

from tallyline.llm import collision_ann


def run(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collision_ann.nearest(table, table.where("vec_id % 20 = 0")).collect()
    out = {}
    for r in got:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


def brute(rows, neighbours=20):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    return {q: sorted(((-float(ok[q] @ x), i) for i, x in ok.items() if i != q))[:neighbours] for q in ok if q % 20 == 0}


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collision_ann, "SHARD_ROWS", 300)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8)) * rng.lognormal(0, 0.4, (900, 1))
    x[100:140] = x[99]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 8, 1), (2040, [None] + [1.0] * 7, 1), (2060, [float("nan")] + [1.0] * 7, 1), (2080, [1.0], 1), (None, [1.0] * 8, 1), (2100, [], 1),
             (2120, [float("inf")] * 8, 1)]
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert [r for r, *_ in got[q]] == list(range(1, 21))
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])
        exact = {i: -s for s, i in brute(rows, 10**6)[q]}
        assert all(abs(exact[i] - s) < 1e-9 for _, i, s in got[q])
        hits += len({i for _, i, _ in got[q]} & {i for _, i in best})
    assert hits / (20 * len(want)) >= 0.9


def test_few_and_none(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 0.0], 1)]) == {}
    assert run(spark, [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.5, 9.0], 1)])[0] == [(1, 1, 0.5), (2, 2, 0.5)]


def test_repeated_rows(spark):
    """A row that stands twice is one candidate and one query; another vector under the same id is another query."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(rng.normal(size=(60, 8)))]
    table = spark.createDataFrame(rows + rows[:30] + [(20, [1.0] * 8, 1)], "vec_id long, embedding array<float>, rank int")
    got = collision_ann.nearest(table, table.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(rows)
    assert sorted(len(v) for v in by.values()) == [20, 20, 40]
    for q in (0, 40):
        assert sorted(r for r, _ in by[q]) == list(range(1, 21)) and len({i for _, i in by[q] if i != 20}) >= 18
        assert len({i for _, i in by[q]} & {i for _, i in want[q]}) >= 18
