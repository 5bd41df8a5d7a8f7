"""Global order without a global sort in one task: running totals, quantiles, row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyline.functions.numeric import one_row
from tallyline.session import pin

KNOTS = 64
SUB_BUCKETS = 4096
RANGES = 1024


def ordered_cumsum(values: DataFrame, keys: Sequence[str], value: str, cols: Sequence[str]) -> DataFrame:
    """Add ``before_{c}``: the total of ``c`` over smaller values of the key's group.

    ``values`` holds one row per (keys, value), already pre-aggregated. Values are cut into at
    most KNOTS x SUB_BUCKETS buckets (approximate quantile knots, then equal widths between
    knots); totals per bucket are accumulated first, then rows inside each bucket. The knots
    only balance the buckets, the sums are exact. Windows are partitioned by group and bucket, and
    the knots are joined by the keys, so groups may be few and large or many and small.
    """
    keys = list(keys)
    probs = [i / KNOTS for i in range(KNOTS + 1)]
    knots = values.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("__knots"))
    if keys:
        cut = values.join(knots, keys)
    else:
        cut = values.withColumn("__knots", knots.scalar())
    v, ks = F.col(value).cast("double"), F.col("__knots")
    cell = F.size(F.filter(ks, lambda k: k <= v))  # 0 .. KNOTS+1
    cut = cut.withColumn("__cell", cell)
    low = F.get(ks, F.col("__cell") - 1).cast("double")
    high = F.get(ks, F.col("__cell")).cast("double")
    sub = F.floor(F.try_divide(v - low, high - low) * SUB_BUCKETS)
    sub = F.least(F.greatest(F.coalesce(sub, F.lit(0)), F.lit(0)), F.lit(SUB_BUCKETS - 1))
    cut = cut.withColumn("__bucket", F.col("__cell") * SUB_BUCKETS + sub).drop("__knots", "__cell")
    group = [*keys, "__bucket"]
    totals = cut.groupBy(*group).agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    # at most KNOTS x SUB_BUCKETS rows per group
    over = W.partitionBy(*keys).orderBy("__bucket") if keys else W.orderBy("__bucket")
    over = over.rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *group, *[F.coalesce(F.sum(f"__t_{c}").over(over), F.lit(0)).alias(f"__b_{c}") for c in cols]
    )
    inside = W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        cut.join(totals, group)
        .select(
            *values.columns,
            *[
                (F.col(f"__b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}")
                for c in cols
            ],
        )
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per (keys, ``name``) with an array ``q``.

    Columns are unpivoted, equal values are counted before any exchange, and the order is
    accumulated by ``ordered_cumsum``; only the rows around the wanted ranks survive. One plan
    serves any number of groups of any size.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("e"),
    ).select(*keys, "e.name", "e.value").where(F.col("value").isNotNull())
    group = [*keys, "name"]
    # read five times below, so written once
    counts = pin(long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    ranked = ordered_cumsum(counts, group, "value", ["n"])
    sizes = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    wanted = sizes.select(
        *group, F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p"), "total"
    ).select(
        *group, "i", ((F.col("total") - 1) * F.col("p")).alias("h")
    )
    # len(probs) wanted ranks per group against the distinct values of that group: the ranks
    # ride on the rows as an array, so no pairs are formed
    ranks = wanted.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("ranks"))
    first, last = F.col("before_n"), F.col("before_n") + F.col("n") - 1
    hit = ranked.join(ranks, group).select(
        *group,
        "value",
        first.alias("first"),
        last.alias("last"),
        F.filter(
            "ranks", lambda r: (F.ceil(r["h"]) >= first) & (F.floor(r["h"]) <= last)
        ).alias("ranks"),
    ).where(F.size("ranks") > 0).select(*group, "value", "first", "last", F.inline("ranks"))
    low, high = F.floor("h"), F.ceil("h")
    at_low = F.max(F.when((low >= F.col("first")) & (low <= F.col("last")), F.col("value")))
    at_high = F.max(F.when((high >= F.col("first")) & (high <= F.col("last")), F.col("value")))
    points = hit.groupBy(*group, "i", "h").agg(at_low.alias("lo"), at_high.alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - low)
    return (
        points.select(*group, "i", value.alias("v"))
        .groupBy(*group)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("q"))
    )


def exact_medians(df: DataFrame, columns: Sequence[str], default: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per ``keys``): the exact median of every column, ``default`` where all NULL."""
    q = exact_quantiles(df, columns, [0.5], keys)
    fallback = f", {float(default)}D" if default is not None else ""
    return q.groupBy(*keys).agg(
        *[F.expr(f"coalesce(max(CASE WHEN name = '{c}' THEN get(q, 0) END){fallback}) AS {c}") for c in columns]
    )


def row_positions(df: DataFrame, tick: str, order: Sequence[str], keys: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """0-based position of every row in the total order (tick, *order) within ``keys``.

    ``tick`` is a coarse leading key (a date). Counts per tick are accumulated, and only the
    rows of one tick meet in one window; where the next order column is a number, a tick is cut
    further into equal ranges of it, so that a busy tick is spread as well.
    """
    keys = list(keys)
    group = [*keys, tick]
    cut = df
    if dict(df.dtypes)[order[0]] in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        span = one_row(df.agg(F.min(order[0]).alias("lo"), F.max(order[0]).alias("hi")))
        cut = df.withColumn("__span", span).selectExpr(
            *df.columns,
            f"coalesce(cast(floor(try_divide(cast({order[0]} as double) - __span.lo, __span.hi - __span.lo) * {RANGES - 1}) as int), 0) AS __range",
        )
        group.append("__range")
    counts = cut.groupBy(*group).agg(F.expr("count(1) AS __n"))
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    lead = ", ".join(group[len(keys):])
    starts = counts.selectExpr(
        *group,
        f"coalesce(sum(__n) OVER ({part}ORDER BY {lead} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS __start",
    )
    inside = f"OVER (PARTITION BY {', '.join(group)} ORDER BY {', '.join(order)})"
    return (
        cut.selectExpr("*", f"row_number() {inside} - 1 AS __r")
        .join(starts, group)
        .selectExpr(*df.columns, f"__start + __r AS {name}")
    )
