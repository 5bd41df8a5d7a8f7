"""Additive schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# What a new NOT NULL column holds on old rows.
DEFAULTS = {T.IntegerType: 0, T.LongType: 0, T.DoubleType: 0.0, T.StringType: ""}


def _default(field: T.StructField):
    if field.nullable:
        return F.lit(None).cast(field.dataType)
    return F.lit(DEFAULTS.get(type(field.dataType))).cast(field.dataType)


def align_to_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """Columns of the target that the data lacks are added; columns it has more are kept."""
    have = set(df.columns)
    added = [_default(f).alias(f.name) for f in target.fields if f.name not in have]
    return df.select("*", *added)


def schema_changes(df: DataFrame, target: T.StructType) -> DataFrame:
    """Dry run: one row per column that alignment would add."""
    have = set(df.columns)
    rows = [
        (f.name, f.dataType.simpleString(), not f.nullable, None if f.nullable else str(DEFAULTS.get(type(f.dataType))))
        for f in target.fields
        if f.name not in have
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, type string, required boolean, default_value string")
