"""Keep-one-row-per-key as an aggregate: combined map-side, so a hot key costs one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.numeric import as_col


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key by a total order."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*[as_col(c).alias(f"o{i}") for i, c in enumerate(order)])
    if any(t in kind for c, kind in df.dtypes if c in rest for t in ("map<", "variant")):
        row = F.min_by(F.struct(*rest), ordered)  # values without an order
        place = {c: c for c in rest}
    else:
        # columns of the order travel once, as part of it
        place = {c: f"o{i}" for i, c in enumerate(order) if isinstance(c, str) and c in rest}
        values = {c: f"v{i}" for i, c in enumerate(rest) if c not in place}
        row = F.min(F.struct(*[as_col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(n) for c, n in values.items()]))
        place |= values
    return df.groupBy(*keys).agg(row.alias("__row")).select(
        *[F.col(c) if c in keys else F.col("__row")[place[c]].alias(c) for c in df.columns]
    )


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*[as_col(c).alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(row.alias("__row")).select(
        *[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns]
    )


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def first_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: of every column the first value that is not NULL, in the given order (ties: the smaller value)."""
    at = ", ".join(order)
    return df.groupBy(*keys).agg(*[F.expr(f"min_by({c}, struct({at}, {c})) FILTER (WHERE {c} IS NOT NULL) AS {c}") for c in columns])
