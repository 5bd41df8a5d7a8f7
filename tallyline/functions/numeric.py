"""Small column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(as_col(c).cast("double"), F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = as_col(c)
    inf = float("inf")
    return F.when(F.isnan(c) | c.isin(inf, -inf), None).otherwise(c)


def clip(c: Column | str, low: float, high: float) -> Column:
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


# The three clipping conventions for a logit (fixed values).
CONSENSUS_CLIP = (1e-16, 1 - 1e-6)
MODEL_CLIP = (1e-6, 1 - 1e-6)
CALIBRATION_CLIP = (1e-15, 1 - 1e-15)


def logit(p: Column | str, bounds: tuple[float, float] = MODEL_CLIP) -> Column:
    p = clip(p, *bounds)
    return F.ln(p / (1 - p))


def sigmoid(z: Column | str) -> Column:
    return 1 / (1 + F.exp(-as_col(z)))


def one_row(stats: DataFrame) -> Column:
    """A one-row aggregate as a struct column (an uncorrelated scalar subquery, no join)."""
    return stats.select(F.struct(*stats.columns).alias("row")).scalar()
