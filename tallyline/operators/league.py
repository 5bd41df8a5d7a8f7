"""League averages that only know the past, and features relative to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

WARM_UP_BUCKETS = 10


def league_averages(
    rows: DataFrame,
    stats: Mapping[str, tuple[str, str]],
    dates: DataFrame,
    date: str = "game_date",
    bucket: Sequence[str] = ("game_date", "dh", "team"),
    season: Sequence[str] = (),
    min_buckets: int = WARM_UP_BUCKETS,
    prefix: str = "avg_",
) -> DataFrame:
    """One row per wanted date: weighted mean of each stat over strictly earlier rows.

    With fewer than ``min_buckets`` distinct buckets before the date the full-season mean is
    used. Rows with a NULL stat or weight, or a weight <= 0, do not count. The rows are summed
    per bucket, then per date; the running sums run over one row per date.
    """
    season = list(season)
    per_bucket, per_date = [], []
    for s, (w, _) in stats.items():
        weight = f"cast({w} as double)" if w in rows.columns else "1D"
        ok = f"FILTER (WHERE {s} IS NOT NULL AND {weight} > 0)"
        per_bucket += [f"sum({s} * {weight}) {ok} AS num_{s}", f"sum({weight}) {ok} AS den_{s}"]
        per_date += [f"sum(num_{s}) AS num_{s}", f"sum(den_{s}) AS den_{s}", f"count(den_{s}) AS cnt_{s}"]
    group = list(dict.fromkeys([*season, date, *[c for c in bucket if c in rows.columns]]))
    by_date = (
        rows.groupBy(*group).agg(*[F.expr(t) for t in per_bucket])
        .groupBy(*season, date).agg(*[F.expr(t) for t in per_date])
    )
    # wanted dates join the time line as rows of their own, so dates without games work too
    line = by_date.withColumn("__wanted", F.lit(0)).unionByName(
        dates.select(*season, date).distinct().withColumn("__wanted", F.lit(1)), allowMissingColumns=True
    )
    line = line.groupBy(*season, date).agg(
        F.max("__wanted").alias("__wanted"),
        *[F.sum(c).alias(c) for c in by_date.columns if c not in (*season, date)],
    )
    part = f"PARTITION BY {', '.join(season)} " if season else ""
    before = f"OVER ({part}ORDER BY {date} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"OVER ({part})"
    out = [
        f"CASE WHEN coalesce(sum(cnt_{s}) {before}, 0) < {min_buckets}"
        f" THEN try_divide(sum(num_{s}) {whole}, sum(den_{s}) {whole})"
        f" ELSE try_divide(sum(num_{s}) {before}, sum(den_{s}) {before}) END AS {prefix}{s}"
        for s in stats
    ]
    return line.selectExpr(*season, date, "__wanted", *out).where("__wanted = 1").drop("__wanted")


def relative_columns(
    columns: Sequence[str], stats: Mapping[str, tuple[str, str]], role: str = "", sides=("home_", "away_"), prefix: str = "avg_"
) -> dict[str, str]:
    """Replacement texts: x - average where higher is better, average - x where lower is.

    Applies to columns starting with side + role + stat + '_'. A NULL average (no league
    rows at all) leaves the column as it is.
    """
    out = {}
    for s, (_, direction) in stats.items():
        starts = tuple(f"{side}{role}{s}_" for side in sides)
        avg = prefix + s
        for c in columns:
            if c.startswith(starts):
                delta = f"{avg} - {c}" if direction == "lower" else f"{c} - {avg}"
                out[c] = f"if({avg} IS NULL, {c}, {delta})"
    return out


def apply_league_deltas(features: DataFrame, averages: DataFrame, stats, role="", sides=("home_", "away_"), on=("game_date",)) -> DataFrame:
    """Features relative to the as-of league average (at most one row per date is joined)."""
    changed = relative_columns(features.columns, stats, role, sides)
    joined = features.join(averages, list(on), "left")
    return joined.selectExpr(*[f"{changed[c]} AS {c}" if c in changed else c for c in features.columns])
