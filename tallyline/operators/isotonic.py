"""Monotone regression pooled range by range.

Scores are reduced to one row per distinct value and cut into ranges. Every range pools its own adjacent violators; the blocks
that are left take the place of the scores, and the ranges are cut anew at other places, until no range ends above the next
one's beginning. Pooling may be done in any order, so the result is that of one long pass. Blocks only get fewer, and once
RANGE_ROWS of them are left one range holds all.

The fit is a table of blocks with the beginning of the block that follows; it is applied by a join on the range and the last
block at or below a value. The driver sees the ends of the ranges only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.operators.asof import asof_before
from tallyline.session import pin

RANGE_ROWS = 1_000_000
BLOCK = "range int, lo double, hi double, s double, n double"
TABLE = "range int, lo double, hi double, value double, next_lo double, next_value double"


def pool(lo: np.ndarray, hi: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of a sorted range, pooled until their means rise strictly or stay equal apart."""
    begin, sums, counts, stack = np.empty(len(lo), np.int64), np.empty(len(lo)), np.empty(len(lo)), 0
    for i, (x, w) in enumerate(zip(s.tolist(), n.tolist())):
        at = i
        while stack and sums[stack - 1] * w > x * counts[stack - 1]:
            stack -= 1
            x, w, at = x + sums[stack], w + counts[stack], begin[stack]
        begin[stack], sums[stack], counts[stack] = at, x, w
        stack += 1
    begin = begin[:stack]
    return lo[begin], hi[np.append(begin[1:], len(lo))[:stack] - 1], sums[:stack], counts[:stack]


def _cut(name: str, cuts: list[float]) -> str:
    inside = ", ".join(f"{c!r}D" for c in cuts)
    return f"size(filter(array({inside}), c -> c <= {name}))" if cuts else "0"


def _ends(blocks: DataFrame) -> list:
    """First and last block of every range: one row per RANGE_ROWS blocks."""
    whole = "struct(lo, hi, s / n AS value)"
    return blocks.groupBy("range").agg(F.expr(f"min_by({whole}, lo) AS first"), F.expr(f"max_by({whole}, lo) AS last")).orderBy("range").collect()


def fit_blocks(df: DataFrame, y: str = "y", p: str = "p", range_rows: int = RANGE_ROWS) -> tuple[DataFrame, list[float], list]:
    """(blocks, cuts between the ranges, ends of the ranges) of the monotone fit of ``y`` on ``p``. NULL and NaN take no part."""
    rows = df.select(F.col(p).cast("double").alias("lo"), F.col(y).cast("double").alias("y")).where("lo IS NOT NULL AND NOT isnan(lo) AND y IS NOT NULL")
    blocks = rows.groupBy("lo").agg(F.sum("y").alias("s"), F.count("*").cast("double").alias("n")).selectExpr("0 AS range", "lo", "lo AS hi", "s", "n")
    blocks, turn = pin(blocks, "scores"), 0

    def pooled(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        got = pool(*[table.column(c).to_numpy() for c in ("lo", "hi", "s", "n")])
        return pa.table([pa.array(np.full(len(got[0]), table.column("range")[0].as_py(), np.int32)), *map(pa.array, got)], ["range", "lo", "hi", "s", "n"])

    while True:
        ranges = max(1, -(-blocks.count() // range_rows))
        cuts: list[float] = []
        if ranges > 1:
            # every other turn the cuts lie half a range further on; quantiles only balance the ranges
            at = [(i + (turn % 2) / 2) / ranges for i in range(0 if turn % 2 else 1, ranges)]
            cuts = sorted(set(blocks.agg(F.percentile_approx("lo", at, 10_000)).first()[0]))
        blocks = pin(blocks.withColumn("range", F.expr(_cut("lo", cuts)).cast("int")).groupBy("range").applyInArrow(pooled, BLOCK), "blocks")
        ends, turn = _ends(blocks), turn + 1
        if all(a.last.value <= b.first.value for a, b in zip(ends, ends[1:])):
            return blocks, cuts, ends


def fit(df: DataFrame, y: str = "y", p: str = "p", range_rows: int = RANGE_ROWS) -> tuple[DataFrame, list[float]]:
    """(thresholds, cuts): the blocks with what follows them, and for every range a row below all of its values."""
    spark = df.sparkSession
    blocks, cuts, ends = fit_blocks(df, y, p, range_rows)
    after = "OVER (PARTITION BY range ORDER BY lo)"
    inner = blocks.selectExpr("range", "lo", "hi", "least(greatest(s / n, 0D), 1D) AS value").selectExpr("*", f"lead(lo) {after} AS next_lo", f"lead(value) {after} AS next_value")
    bound = lambda x: min(max(x, 0.0), 1.0)
    # the end of one range is followed by the beginning of the next that is not empty
    follow = [(a.range, b.first.lo, bound(b.first.value)) for a, b in zip(ends, ends[1:])]
    joined = inner.join(F.broadcast(spark.createDataFrame(follow, "range int, f_lo double, f_value double")), "range", "left").selectExpr(
        "range", "lo", "hi", "value", "coalesce(next_lo, f_lo) AS next_lo", "coalesce(next_value, f_value) AS next_value")
    below = []
    for k in range(len(cuts) + 1):
        before, here = [e for e in ends if e.range < k], [e for e in ends if e.range >= k]
        ahead = (here[0].first.lo, bound(here[0].first.value)) if here else (None, None)
        if before:
            below.append((k, -float("inf"), before[-1].last.hi, bound(before[-1].last.value), *ahead))
        elif here:
            below.append((k, -float("inf"), -float("inf"), ahead[1], *ahead))
    return pin(joined.unionByName(spark.createDataFrame(below, TABLE)), "thresholds"), cuts


def apply(df: DataFrame, thresholds: DataFrame, cuts: list[float], p: str = "p", output: str = "p_cal") -> DataFrame:
    """``df`` with the fitted value: linear between blocks, constant outside. NULL stays NULL."""
    keyed = df.withColumn("__at", F.col(p).cast("double")).withColumn("__range", F.expr(_cut("__at", cuts)).cast("int"))
    known = thresholds.selectExpr("range AS __range", "lo AS __at", "hi", "value", "next_lo", "next_value")
    names = ["hi", "value", "next_lo", "next_value"]
    known = known.withColumnsRenamed({c: f"__{c}" for c in names})
    found = asof_before(keyed, known, ["__range"], "__at", [f"__{c}" for c in names], inclusive=True)
    between = "__value + (__at - __hi) / (__next_lo - __hi) * (__next_value - __value)"
    value = f"CASE WHEN __at IS NULL OR isnan(__at) THEN NULL WHEN __at <= __hi OR __next_lo IS NULL OR __value = __next_value THEN __value ELSE {between} END"
    return found.withColumn(output, F.expr(value)).select(*[c for c in df.columns if c != output], output)


def save(thresholds: DataFrame, path: str) -> None:
    thresholds.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(path)
