import re

import pytest
from pyspark.sql import functions as F

from tallyline.plans.features import KEY, join_blocks
from tallyline.session import bucketed, pin


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def blocks(spark, n=500):
    base = spark.range(n).selectExpr(*[f"id % {7 + i} AS {c}" for i, c in enumerate(KEY)], "id").dropDuplicates(KEY)
    return base, [base.where(f"id % {k} = 0").select(*KEY, F.col("id").alias(f"x{k}")) for k in (2, 3, 5)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_blocks_meet_without_an_exchange(spark, no_broadcast):
    base, parts = blocks(spark)
    store = bucketed(KEY)
    kept, held = store(base, "base"), [store(p, "block") for p in parts]
    out = join_blocks(kept, held)
    assert "SortMergeJoin" in plan(out) and "Exchange" not in plan(out)
    plain = join_blocks(base, parts)
    assert sorted(map(tuple, out.select(sorted(out.columns)).collect()), key=str) == sorted(map(tuple, plain.select(sorted(plain.columns)).collect()), key=str)


def test_only_the_other_side_is_dealt_out(spark, no_broadcast):
    base, parts = blocks(spark)
    kept = bucketed(KEY)(base, "base")
    out = kept.join(pin(parts[0], "plain"), KEY, "left")
    text = plan(out)
    stored = text[text.index("SortMergeJoin"):].split("Exchange")[0]
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Bucketed: true" in stored


def test_table_without_the_key_is_stored_plainly(spark):
    assert bucketed(KEY)(spark.range(3), "other").count() == 3
