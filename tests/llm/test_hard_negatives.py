import math
from collections import Counter

import numpy as np
import pytest

from tallyline.llm import hard_negatives


def run(spark, rows, anchors="id % 10 = 0", extra=""):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank int, id string, q int, aid int" if extra else "vec_id long, embedding array<double>, label int")
    return sorted(map(tuple, hard_negatives.mine_negatives(table, anchors).collect()))


def brute(rows, every=10):
    """Plain loops over Python integers."""
    finite = {(i, lab, tuple(math.floor(256 * c) for c in v)) for i, v, lab in rows
              if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and sum((256.0 * c) ** 2 for c in v) <= 2.0**61}
    lengths = Counter(len(v) for i, v, lab in rows if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and sum((256.0 * c) ** 2 for c in v) <= 2.0**61)
    dim = min(lengths, key=lambda d: (-lengths[d], d), default=0)
    ok, out = [r for r in finite if len(r[2]) == dim], []
    for i, own, v in ok:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, lab) for j, lab, w in ok if j != i)
        for p, j in [(-s, j) for s, j, lab in scored if lab == own][:5]:
            inside = [(-s, k) for s, k, lab in scored if lab != own and 80 * p <= 100 * -s <= 100 * p][:5]
            out += [(i, j, r, k, p, n) for r, (n, k) in enumerate(inside, 1)]
    return sorted(out)


def vectors(seed, n=400, dim=8, kinds=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] * rng.lognormal(0, 0.5, (n, 1)) + rng.normal(size=(n, dim)) * 0.3
    return [(i, [float(c) for c in v], int(rng.integers(0, kinds))) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "CHUNK_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "PACK_BLOCKS", 5)
    rows = vectors(seed)
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 500


def test_copies_ties_and_rows_without_part(spark):
    rows = vectors(2, 120)
    rows = [(i, rows[7][1], lab) if i % 3 == 0 else (i, v, lab) for i, v, lab in rows]  # a third of all rows share a vector
    rows += rows[:15]  # repeated rows
    rows += [(200, None, 1), (210, [1.0] * 8, None), (None, [1.0] * 8, 1), (220, [None] + [1.0] * 7, 1), (230, [float("nan")] * 8, 1), (240, [math.inf] * 8, 1),
             (250, [1.0], 1), (260, [], 1), (270, [0.0] * 8, 1), (280, [0.0] * 8, 1), (281, [0.0] * 8, 2), (290, [-1.0] * 8, 3), (300, [1e30] * 8, 3)]
    got = run(spark, rows)
    assert got == brute(rows) and {270, 280} <= {r[0] for r in got}


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.integers(-(2**20), 2**20, 4)], i % 3) for i in range(60)]
    rows += [(i, [float(c) for c in rng.integers(-(2**21), 2**21, 4)], i % 3) for i in range(60, 120)]
    assert run(spark, rows) == brute(rows)


def test_few_and_none_and_clashing_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(0, [0.0], 1), (1, [0.0], 1)]) == []
    rows = vectors(5, 60)
    assert run(spark, [r + (1, "x", 2, 3) for r in rows], extra="yes") == brute(rows)


def test_bounds_hold():
    """The interval from the angles holds every integer score."""
    rng = np.random.default_rng(6)
    q = np.floor(256 * rng.normal(size=(300, 6)) * rng.lognormal(0, 2, (300, 1)))
    axes = rng.normal(size=(3, 6))
    axes /= np.sqrt((axes**2).sum(1))[:, None]
    norm = np.sqrt((q**2).sum(1))
    a = np.arccos(np.clip(q @ axes.T / norm[:, None], -1, 1)).astype(np.float32)
    near = np.abs(a[:, None] - a[None]).max(-1)
    both = a[:, None] + a[None]
    far = np.minimum(both, 2 * np.pi - both).min(-1)
    low, high = hard_negatives.score_bounds(near, far, norm[:, None], (norm[None], norm[None]))
    score = q @ q.T
    assert (low <= score).all() and (score <= high).all() and (high < norm[:, None] * norm * 0.9).any()
