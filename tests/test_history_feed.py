"""Histories moved on batch by batch against one pass over everything."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_history import HALFLIVES, actual, log  # noqa: F401

from tallyline.streaming.histories import HistoryFeed

SCHEMA = "entity string, day long, i long, v double, w double, season long"


def frame(spark, log):
    log = log.assign(season=(log["day"] // 15).astype(int))
    return spark.createDataFrame(log.astype(object).where(log.notna(), None), SCHEMA)


def feed(spark, root, entity=("entity",), part=None):
    ewms = {f"x{h}": ("coalesce(v, 0) * w", h) for h in HALFLIVES} | {f"y{h}": ("w", h) for h in HALFLIVES}
    return HistoryFeed(spark, root, entity, ["day", "i"], sums={"s": "v"}, ewms=ewms, latest={"last": "day"}, clock="day", part=part)


def same(got: pd.DataFrame, want: pd.DataFrame):
    got = got.sort_values(["entity", "day", "i"]).reset_index(drop=True)[list(want.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("borders", [[0, 40], [0, 1, 2, 3, 17, 18, 39, 40]])
def test_batches_give_the_rows_of_one_pass(spark, log, tmp_path, borders):  # noqa: F811
    f, df = feed(spark, str(tmp_path)), frame(spark, log)
    for n, (a, b) in enumerate(zip(borders, borders[1:])):
        f.ingest(df.where(f"day >= {a} AND day < {b}"), n)
    same(f.rows().toPandas(), actual(spark, log))


def test_delivered_twice_and_out_of_order(spark, log, tmp_path):  # noqa: F811
    f, df = feed(spark, str(tmp_path)), frame(spark, log)
    f.ingest(df.where("day < 10"), 0)
    f.ingest(df.where("day BETWEEN 10 AND 19 AND entity <> 'b'"), 1)
    f.ingest(df.where("day BETWEEN 10 AND 19"), 1)  # the batch comes again, whole this time
    f.ingest(df.where("day >= 20"), 2)
    same(f.rows().toPandas(), actual(spark, log))
    with pytest.raises(ValueError, match="earlier batch"):
        f.ingest(df.where("day = 3"), 3)


def test_a_batch_is_read_once_for_its_rows(spark, log, tmp_path):  # noqa: F811
    """Its rows, the check for late ones and the new state come from one pass, beside the count."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def look(x):
        seen.add(1)
        return x

    df = frame(spark, log)
    f = feed(spark, str(tmp_path))
    f.ingest(df.where("day < 20").withColumn("v", look.asNondeterministic()("v")), 0)
    assert seen.value <= 2 * df.where("day < 20").count()


def test_only_touched_parts_are_written(spark, log, tmp_path):  # noqa: F811
    f, df = feed(spark, str(tmp_path), ("entity", "season"), "season"), frame(spark, log)
    for n in range(8):
        f.ingest(df.where(f"day BETWEEN {5 * n} AND {5 * n + 4}"), n)
    versions = {s: f._versions(f"{tmp_path}/state/season={s}") for s in (0, 1, 2)}
    assert versions == {0: [1, 2], 1: [4, 5], 2: [6, 7]}
    whole = feed(spark, str(tmp_path / "whole"), ("entity", "season"), "season").ingest(df, 0)
    want = whole.toPandas().sort_values(["entity", "day", "i"]).reset_index(drop=True)
    same(f.rows().toPandas(), want)


def test_stream(spark, log, tmp_path):  # noqa: F811
    df, source = frame(spark, log), str(tmp_path / "in")
    f = feed(spark, str(tmp_path / "out"))
    for a, b in ((0, 20), (20, 40)):
        df.where(f"day >= {a} AND day < {b}").write.mode("append").parquet(source)
        f.follow(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "offsets")).awaitTermination()
    same(f.rows().toPandas(), actual(spark, log))


def test_entity_column(spark, tmp_path):
    with pytest.raises(ValueError, match="not a column"):
        feed(spark, str(tmp_path), part="season")
