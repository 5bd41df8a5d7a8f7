"""Splits, scaling, imputation and audits of a wide feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyline.functions.numeric import one_row
from tallyline.operators.metrics import BATTING
from tallyline.operators.ordering import row_positions
from tallyline.operators.selection import medians

# Columns that never become features.
EXCLUDED = (
    "home_team_score", "away_team_score", "home_score", "winning_team", "losing_team", "winner",
    "away_score", "is_home", "home_starter_normalized_player_name",
    "away_starter_normalized_player_name", "home_starter_name", "away_starter_name",
    "away_starter_normalized", "home_starter_id", "away_starter_id", "mlb_id", "venue_id",
    "status", "venue_name", "venue_timezone", "venue_gametime_offset",
    "home_starter_last_app_date", "away_starter_last_app_date", "home_probable_pitcher",
    "away_probable_pitcher", "away_pitcher_id", "home_pitcher_id",
)
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def half_point(counts: DataFrame, date: str) -> DataFrame:
    """One row: the date of row floor(n/2) (0-based) given one row of counts ``n`` per date."""
    w = W.orderBy(date)
    at = F.floor(F.sum("n").over(W.partitionBy()) / 2)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        counts.select(date, "n", at.alias("__at"), before.alias("__before"))
        .where((F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("n")))
        .agg(F.max(date).alias("cut_date"))
    )


def season_split(df: DataFrame, season: str = "season", date: str = "game_date") -> DataFrame:
    """train = all but the last season; the last one is cut at the date of its middle row."""
    last = df.agg(F.max(season)).scalar()
    counts = df.where(F.col(season) == last).groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    cut = half_point(counts, date).scalar()
    split = F.when(F.col(season) < last, "train").when(F.col(date) <= cut, "val").otherwise("test")
    return df.select("*", split.alias("split"))


def ordered_halves(df: DataFrame, date: str, order: Sequence[str], names=("stopping", "calibration")) -> DataFrame:
    """First floor(n/2) rows in order and the rest, as a column ``part``."""
    n = df.agg(F.count(F.lit(1))).scalar()
    pos = row_positions(df, date, order)
    return pos.select(
        *df.columns, F.when(F.col("pos") < F.floor(n / 2), names[0]).otherwise(names[1]).alias("part")
    )


def expanding_folds(df: DataFrame, date: str, order: Sequence[str], folds: int = 4) -> DataFrame:
    """``fold`` = the fold a row tests (0..folds-1), -1 for the leading rows that only train.

    Fold k trains on every row with ``fold < k``.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    size = F.floor(n / (folds + 1))
    pos = row_positions(df, date, order)
    start = n - size * folds
    fold = F.when(F.col("pos") < start, -1).otherwise(F.floor((F.col("pos") - start) / size))
    return pos.select(*df.columns, fold.cast("int").alias("fold"))


def feature_columns(df: DataFrame, exclude: Sequence[str] = EXCLUDED) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in exclude])


def duplicated_by_vectors(column: str) -> bool:
    """Columns that the slot and starter vectors repeat."""
    stats = [m.name for m in BATTING] + ["frv_per_9"]
    if column.startswith(("home_starter_", "away_starter_", "home_away_starter_")):
        return True
    for side in ("home_away_", "home_", "away_"):
        if column.startswith(side):
            rest = column.removeprefix(side)
            return any(rest.startswith(f"{s}_") or (rest == s and side != "home_away_") for s in stats)
    return False


def drop_market_extras(df: DataFrame, market_only: bool = False) -> DataFrame:
    extra = () if market_only else ("num_books", "vig_open")
    return df.drop(*[c for c in df.columns if "prob_home" in c or c in extra])


def null_audit(df: DataFrame, by: str = "split") -> DataFrame:
    """Rows and rows with any NULL, per split, in one pass."""
    any_null = " OR ".join(f"{c} IS NULL" for c in df.columns if c != by)
    return df.groupBy(by).agg(F.expr("count(1) AS n_rows"), F.expr(f"count_if({any_null}) AS n_null_rows"))


def typed_partition(df: DataFrame, keys: Sequence[str] = (), market: Sequence[str] = ("p_open_home_median_nv",)) -> DataFrame:
    """Numeric columns, booleans as 0/1, market probability as it is; everything else goes."""
    types = [(c, t) for c, t in df.dtypes if c not in keys]
    numeric = [c for c, t in types if t in NUMERIC_TYPES and c not in market]
    flags = [f"cast({c} as int) AS {c}" for c, t in types if t == "boolean"]
    passed = [c for c, _ in types if c in market]
    return df.selectExpr(*keys, *numeric, *flags, *passed)


def probability_audit(df: DataFrame, p: str, by: str = "split") -> DataFrame:
    """Per split: probabilities outside [0, 1] and non-finite ones."""
    bad = (F.col(p) < 0) | (F.col(p) > 1)
    odd = F.col(p).isNull() | F.isnan(p) | F.col(p).isin(float("inf"), float("-inf"))
    return df.groupBy(by).agg(
        F.sum(F.when(bad & ~odd, 1).otherwise(0)).alias("n_out_of_range"),
        F.sum(F.when(odd, 1).otherwise(0)).alias("n_not_finite"),
    )


def require_probabilities(df: DataFrame, p: str, by: str = "split") -> DataFrame:
    wrong = probability_audit(df, p, by).where("n_out_of_range > 0 or n_not_finite > 0").first()
    if wrong:
        raise ValueError(f"{p}: bad probabilities in {wrong.asDict()}")
    return df


def fit_scaler(df: DataFrame, columns: Sequence[str], train: str) -> DataFrame:
    """One row: mean_ and std_ (population, 0 -> 1) of each column over the training rows."""
    rows = f"FILTER (WHERE {train})"
    return df.agg(
        *[F.expr(f"avg({c}) {rows} AS mean_{c}") for c in columns],
        *[F.expr(f"coalesce(nullif(stddev_pop({c}) {rows}, 0D), 1D) AS std_{c}") for c in columns],
    )


def standardize(df: DataFrame, columns: Sequence[str], train: str) -> DataFrame:
    """Scale by the training rows (``train`` is a SQL condition)."""
    fit = one_row(fit_scaler(df, columns, train))
    scaled = set(columns)
    return df.withColumn("__fit", fit).selectExpr(
        *[f"({c} - __fit.mean_{c}) / __fit.std_{c} AS {c}" if c in scaled else c for c in df.columns]
    )


def impute_medians(df: DataFrame, columns: Sequence[str], train: str, indicators: Sequence[str] = ()) -> DataFrame:
    """NULLs take the exact training median (0 when all NULL); missing indicators count as 1."""
    found = medians(df.where(train), columns, default=0.0)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(found[c])) for c in columns}
    filled |= {c: F.coalesce(F.col(c).cast("int"), F.lit(1)) for c in indicators}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def audit_texts(columns: Sequence[str], p: str, splits: Sequence[str], by: str = "split") -> dict[str, str]:
    """The counts of ``null_audit`` and ``probability_audit`` per split as aggregates over all rows (for ``write_audited``)."""
    any_null = " OR ".join(f"{c} IS NULL" for c in columns if c != by)
    odd = f"({p} IS NULL OR isnan({p}) OR abs({p}) = double('infinity'))"
    out = {}
    for s in splits:
        own = f"{by} = '{s}'"
        out |= {
            f"{s}__n_rows": f"count_if({own})", f"{s}__n_null_rows": f"count_if({own} AND ({any_null}))",
            f"{s}__n_out_of_range": f"count_if({own} AND NOT {odd} AND ({p} < 0 OR {p} > 1))", f"{s}__n_not_finite": f"count_if({own} AND {odd})",
        }
    return out


def order_violations(df: DataFrame, by: str = "split", lead: str = "season", date: str = "game_date") -> DataFrame:
    """Ordering contract of an output sorted by (lead, date, ...): dates never fall.

    Dates can only fall where ``lead`` changes, so one minimum and maximum per lead value are
    compared instead of neighbouring rows.
    """
    spans = df.groupBy(by, lead).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    previous = F.max("last").over(W.partitionBy(by).orderBy(lead).rowsBetween(W.unboundedPreceding, -1))
    return spans.select(by, lead, "first", "last", F.coalesce(F.col("first") < previous, F.lit(False)).alias("falls"))


def signature_report(spark, expected: Sequence[str], actual: Sequence[str]) -> DataFrame:
    """Feature-signature contract: missing and extra columns (empty when the sets agree)."""
    rows = [("missing", c) for c in sorted(set(expected) - set(actual))]
    rows += [("extra", c) for c in sorted(set(actual) - set(expected))]
    return spark.createDataFrame(rows, "kind string, column_name string")


def index_contract(predictions: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not exactly once on both sides (empty when the contract holds)."""
    keys = list(keys)
    both = predictions.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(
        expected.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("e"))
    )
    return both.groupBy(*keys).agg(F.sum("p").alias("n_predicted"), F.sum("e").alias("n_expected")).where(
        "n_predicted <> 1 or n_expected <> 1"
    )
