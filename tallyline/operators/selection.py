"""Quantiles of many columns by radix selection.

Doubles are ordered by their bits (sign flipped for positive numbers, all bits for negative ones). A pass counts, for every
column and every wanted rank, the next BITS bits of the values that share the rank's leading bits; the bucket that holds the rank
gives the next bits. Six passes fix all 64. What tasks exchange are counters, at most 2^BITS per column, rank and task,
whatever the number of rows; no values travel and nothing is unpivoted. A few groups (seasons) are counted side by side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyline.session import pin

BITS = 11
_TOP = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0.0 equals 0.0, NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def from_ordered(bits: int) -> float:
    raw = np.uint64(bits)
    return float(np.array([raw ^ _TOP if raw & _TOP else ~raw], np.uint64).view(float)[0])


def _counts(rows: DataFrame, names: Sequence[str], prefixes: dict[int, list[int]], done: int, bits: int) -> DataFrame:
    """(col, prefix, bucket, n): values by their next ``bits`` bits, ``prefix`` being a place in the column's list.

    Column ``c`` of group ``g`` (``grp``, if the rows have it) is numbered ``g * len(names) + c``.
    """
    shift = np.uint64(64 - done - bits)
    before = np.uint64(64 - done) if done else None

    def count(batches):
        sums = {(c, i): np.zeros(1 << bits, np.int64) for c, known in prefixes.items() for i in range(len(known))}
        for batch in batches:
            of = batch.column("grp").to_numpy() if "grp" in batch.schema.names else np.zeros(batch.num_rows, np.int64)
            parts = {int(g): batch.filter(pa.array(of == g)) for g in np.unique(of)}
            for c, known in prefixes.items():
                g, place = divmod(c, len(names))
                if g not in parts:
                    continue
                x = ordered_bits(parts[g].column(names[place]).drop_null().to_numpy(zero_copy_only=False))
                for i, p in enumerate(known):
                    own = x if before is None else x[(x >> before) == np.uint64(p)]
                    sums[c, i] += np.bincount(((own >> shift) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        out = [(np.full(len(b), c), np.full(len(b), i), b, s[b]) for (c, i), s in sums.items() if len(b := np.flatnonzero(s))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["col", "prefix", "bucket", "n"])

    found = rows.mapInArrow(count, "col long, prefix long, bucket long, n long")
    return found.groupBy("col", "prefix", "bucket").agg(F.sum("n").alias("n"))


def radix_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles by linear interpolation, NULL left out; None for a column without values."""
    return _radix(df, columns, probs)[0]


def _radix(df: DataFrame, columns: Sequence[str], probs: Sequence[float], groups: int = 1, group: str | None = None, stored: bool = False) -> list[dict[str, list[float | None]]]:
    """The quantiles of the groups 0 .. ``groups`` - 1, which the column ``group`` numbers."""
    spark, names = df.sparkSession, [f"c{i}" for i in range(len(columns))]
    own = [F.col(group).cast("long").alias("grp")] if group else []
    rows = df.select(*own, *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    rows = rows if stored else pin(rows, "quantile-columns")
    # wanted: (column, rank) -> [leading bits, rank among the values that share them]
    wanted: dict[tuple[int, int], list[int]] = {}
    sizes: dict[int, int] = {}
    done = 0
    while done < 64:
        bits = min(BITS, 64 - done)
        if done:
            prefixes: dict[int, list[int]] = {}
            for (c, _), (lead, _) in wanted.items():
                prefixes.setdefault(c, [])
                if lead not in prefixes[c]:
                    prefixes[c].append(lead)
        else:
            prefixes = {c: [0] for c in range(groups * len(names))}
        counts = _counts(rows, names, prefixes, done, bits)
        over = "OVER (PARTITION BY col, prefix ORDER BY bucket)"
        run = counts.selectExpr("col", "prefix", "bucket", f"sum(n) {over} AS upto", f"sum(n) {over} - n AS before")
        if not done:
            run = pin(run, "first-counts")
            sizes = {r.col: r.n for r in run.groupBy("col").agg(F.max("upto").alias("n")).collect()}  # a row per column
            for c, n in sizes.items():
                for p in probs:
                    for rank in (math.floor((n - 1) * p), math.ceil((n - 1) * p)):
                        wanted[c, rank] = [0, rank]
        asked = [(c, rank, prefixes[c].index(lead), at) for (c, rank), (lead, at) in wanted.items()]
        if not asked:
            break
        ranks = spark.createDataFrame(asked, "col long, rank long, prefix long, at long")  # a few rows per column
        for r in run.join(F.broadcast(ranks), ["col", "prefix"]).where("before <= at AND at < upto").collect():
            lead, at = wanted[r.col, r["rank"]]
            wanted[r.col, r["rank"]] = [lead << bits | r.bucket, at - r.before]
        done += bits
    out: list[dict[str, list[float | None]]] = [{} for _ in range(groups)]
    for c in range(groups * len(names)):
        n, values = sizes.get(c), []
        for p in probs:
            if not n:
                values.append(None)
                continue
            h = (n - 1) * p
            low, high = (from_ordered(wanted[c, k][0]) for k in (math.floor(h), math.ceil(h)))
            values.append(low if low == high else low + (high - low) * (h - math.floor(h)))
        out[c // len(names)][columns[c % len(names)]] = values
    return out


def medians(df: DataFrame, columns: Sequence[str], default: float | None = None) -> dict[str, float | None]:
    """The exact median of every column, ``default`` where it has no values."""
    return {c: default if q[0] is None else q[0] for c, q in radix_quantiles(df, columns, [0.5]).items()}


def group_medians(df: DataFrame, columns: Sequence[str], key: str, stored: bool = False) -> DataFrame:
    """One row per value of ``key``: the exact median of every column, NULL where it has no values.

    For few groups, such as seasons: their list comes to the driver and a task keeps counters per group and column. A table that is
    ``stored`` already is not written again for the passes.
    """
    spark, columns = df.sparkSession, list(columns)
    values = sorted((r[0] for r in df.select(key).distinct().collect()), key=lambda v: (v is not None, v))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType)] + [T.StructField(c, T.DoubleType()) for c in columns])
    if not values:
        return spark.createDataFrame([], schema)
    places = spark.createDataFrame(list(zip(values, range(len(values)))), T.StructType([T.StructField("__key", schema[key].dataType), T.StructField("__grp", T.LongType())]))
    numbered = df.join(F.broadcast(places), F.col(key).eqNullSafe(F.col("__key")))
    found = _radix(numbered, columns, [0.5], len(values), "__grp", stored)
    return spark.createDataFrame([(v, *[q[c][0] for c in columns]) for v, q in zip(values, found)], schema)
