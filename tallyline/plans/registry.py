"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.functions.numeric import as_col
from tallyline.plans.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views)``; ``sql`` may use ``@view`` names."""

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            # flags are bigint on both sides
            ORACLES[name] = oracle(sql).replace("THEN 1 ELSE 0 END", "THEN CAST(1 AS BIGINT) ELSE 0 END")
        return fn

    return register


# Two engines add doubles in different orders. Rounding breaks ties a little below one half,
# where sums of short decimals do not land.
TIE = 0.500137


def half_up(c, digits: int = 6):
    scale = float(10**digits)
    return F.floor(as_col(c) * scale + TIE) / scale


def tidy(df: DataFrame, digits: int = 6, skip: Iterable[str] = ()) -> DataFrame:
    """Doubles rounded half up, integers as bigint: stable values for the comparison."""
    scale = float(10**digits)

    def col(c, t):
        if t == "double" and c not in skip:
            return f"floor({c} * {scale}D + {TIE}D) / {scale}D AS {c}"
        if t in ("int", "smallint", "tinyint", "boolean"):
            return f"cast({c} as bigint) AS {c}"
        return c

    return df.selectExpr(*[col(c, t) for c, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL text."""
    scale = float(10**digits)
    return f"(floor(({expr}) * {scale} + {TIE}) / {scale})"
