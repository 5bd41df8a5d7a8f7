import random
import zlib

import pytest

from tallyline.llm import kd_shards

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n=3000, seed=0):
    rng = random.Random(seed)
    rows = [(i, "ä" * rng.randint(0, 300), rng.choice("abc"), rng.choice(["hot"] * 5 + list("xyz"))) for i in range(n)]
    return rows + [(n + k, "y" * 60_000, "a", "hot") for k in range(2)]


def run(spark, rows, schema=SCHEMA, **settings):
    return kd_shards.shard_documents(spark.createDataFrame(rows, schema), **settings).toPandas()


def check(got, rows, shards):
    """Everything that holds for any input: the rows, sizes, checksums and slots."""
    size = lambda t: len((t or "").encode()) + 16
    want = sorted((-1 if i is None else i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted(map(tuple, got[["doc_id", "size", "text_crc32"]].fillna(-1).astype("int64").values.tolist())) == want
    assert set(got.law) <= {"bytes"} and got.grown_shard.isna().all() and set(got.shard) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    return got.groupby("shard")["size"].sum()


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_equal_bytes(spark, monkeypatch, shards):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 30)
    rows = corpus()
    per = check(run(spark, rows, shards=shards), rows, shards)
    small = per[per < 60_000] if shards == 40 else per  # a document larger than a shard has one for itself
    assert len(per) == shards and small.max() <= 1.03 * small.min()


def test_copies_are_cut_like_other_rows(spark):
    """A third of all rows are equal in every column."""
    rows = corpus(2000)[:2000]
    rows += [rows[3]] * 1000
    per = check(run(spark, rows, shards=16), rows, 16)
    assert per.max() <= 1.03 * per.min()


def test_shards_hold_neighbours(spark):
    """Cuts follow the metadata: with as many sources as shards, most shards hold few of them."""
    rows = [(i, "x" * 50, "a", f"s{i % 8}") for i in range(4000)]
    got = kd_shards.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=8, dimensions=("crc32(source)",), carry=("source",)).toPandas()
    assert got.groupby("shard").source.nunique().max() <= 2


def test_quantile_is_exact(spark):
    """Every cut is the position of equal weights of the sorted keys."""
    rng = random.Random(4)
    keys = [(n, rng.getrandbits(62), rng.randint(1, 9)) for n in (0, 1, 2) for _ in range(500)]
    total = {n: sum(w for m, _, w in keys if m == n) for n in (0, 1, 2)}
    goals = {0: total[0] * 0.5, 1: total[1] * 0.2, 2: float(total[2])}
    got = kd_shards.cuts(spark.createDataFrame(keys, "node int, k long, size long"), goals, 0)
    for n, goal in goals.items():
        below = sum(w for m, k, w in keys if m == n and k < got[n])
        after = min((k for m, k, _ in keys if m == n and k >= got[n]), default=None)
        assert abs(below - goal) <= 5 and (after is None or below + 9 >= goal)


def test_rooms():
    assert kd_shards.rooms([0, 0, 0], 9) == {0: 3, 1: 3, 2: 3}
    assert kd_shards.rooms([10, 0, 2], 4) == {1: 3, 2: 1}
    assert kd_shards.rooms([10, 0, 2], 1) == {1: 1}


def test_edges(spark, tmp_path):
    assert len(run(spark, [])) == 0
    rows = [(1, None, None, None), (None, "", None, "s"), (2, "é" * 100_000, "a", "s"), (2, "é" * 100_000, "a", "s"), (3, "same", "a", None), (4, "same", "a", None)]
    check(run(spark, rows, shards=4), rows, 4)
    more = [r + (1, 2, "n") for r in rows]
    check(run(spark, more, SCHEMA + ", size int, shard int, slot string", shards=4), rows, 4)
    rows = corpus(300)[:300]
    placed = kd_shards.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=5, carry=("text",))
    kd_shards.write_shards(placed, str(tmp_path / "out"), file_rows=20)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t) for i, t, *_ in rows)
