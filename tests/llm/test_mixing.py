import math
import random

import duckdb
import pandas as pd
import pytest

from oracle_check import compare
from tallyline.llm import mixing


def skewed(n=900, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a"] * 12 + ["b", "b", "c", None])) for i in range(n)]
    return rows + rows[:20] + [(None, "x y", "b"), (None, None, "a"), (7, "", "none")]


@pytest.mark.parametrize("settings", [{}, {"entropy": 0.8, "block_rows": 50}, {"entropy": 1.0, "repeats": 2.5, "block_rows": 40, "budget": 1.3}, {"budget": 0.2}])
def test_against_sql(spark, settings):
    rows = skewed()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, **settings).toPandas()
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con.register("documents", frame)
    assert compare(got, con.execute(mixing.oracle(**settings)).df()) is None


def test_budgets_entropy_and_repeats(spark):
    docs = spark.createDataFrame(skewed(), "doc_id long, text string, source string")
    total = sum(len((t or "").split()) for _, t, _ in skewed())
    got = mixing.mix_sources(docs, entropy=0.95, repeats=50, block_rows=30).toPandas()
    taken = got.groupby("source").tokens.sum()
    assert abs(taken.sum() - total) < 40 * len(taken)
    w = taken[taken > 0] / taken.sum()
    assert -sum(x * math.log(x) for x in w) >= 0.94 * math.log(len(w))
    limited = mixing.mix_sources(docs, entropy=1.0, repeats=1.5, block_rows=30).toPandas()
    assert limited.epoch.max() <= 1


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).count() == 0
