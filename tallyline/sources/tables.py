"""Reading stored tables: season, date-range, as-of, entity and snapshot scans.

Every scan is a filter and a projection over Parquet, so predicates and column lists reach
the files; tables are partitioned by season where they have one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyline.functions.context import tag_side
from tallyline.functions.numeric import finite
from tallyline.operators.asof import before_game
from tallyline.schemas import SCHEMAS


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).option("mergeSchema", "true").parquet(f"{root}/{name}")


def season_scan(df: DataFrame, season: int, columns: Sequence[str] | None = None) -> DataFrame:
    out = df.where(F.col("season") == season)
    return out.select(*columns) if columns else out


def range_scan(df: DataFrame, start, end, team=None, team_col: str = "team", columns=None) -> DataFrame:
    """Dates between start and end, both included; optionally one team."""
    out = df.where(F.col("game_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if team is not None:
        out = out.where(F.col(team_col) == team)
    return out.select(*columns) if columns else out


def history_scan(games: DataFrame, team, day, dh: int = 0, season: int | None = None) -> DataFrame:
    """A team's games strictly before (day, dh), with its side and result tagged."""
    out = games.where(before_game(day, dh)).where((F.col("home_team") == team) | (F.col("away_team") == team))
    if season is not None:
        out = out.where(F.col("season") == season)
    return out.select(
        "*",
        tag_side(team, "home_team", "away_team").alias("team_side"),
        F.when(F.col("winning_team") == team, 1).otherwise(0).alias("team_won"),
    )


def season_games(games: DataFrame, season: int, team=None) -> DataFrame:
    out = games.where(F.col("season") == season)
    if team is not None:
        out = out.where((F.col("home_team") == team) | (F.col("away_team") == team))
    return out


def entity_scan(df: DataFrame, player, season: int | None = None, key: str = "player_id") -> DataFrame:
    out = df.where(F.col(key) == player)
    return out if season is None else out.where(F.col("season") == season)


def snapshot_scan(df: DataFrame, season: int, team=None, day: date | str | None = None) -> DataFrame:
    """Rosters, line-ups or match-ups of a season; the day must lie in the season's year."""
    if day is not None and int(str(day)[:4]) != season:
        raise ValueError(f"day {day} is not in season {season}")
    out = df.where(F.col("season") == season)
    if team is not None:
        out = out.where(F.col("team") == team)
    if day is not None:
        out = out.where(F.col("game_date") == F.lit(str(day)).cast("date"))
    return out


def quote_lookup(quotes: DataFrame, day, away, home, book=None, away_starter=None, home_starter=None) -> DataFrame:
    """All books (or one) of a game, ordered by book."""
    out = quotes.where(
        (F.col("game_date") == F.lit(str(day)).cast("date"))
        & (F.col("away_team") == away) & (F.col("home_team") == home)
    )
    for col, value in (("sportsbook", book), ("away_starter_normalized", away_starter), ("home_starter_normalized", home_starter)):
        if value is not None:
            out = out.where(F.col(col) == value)
    return out.orderBy("sportsbook")


def fielding_scan(df: DataFrame, season: int, player=None) -> DataFrame:
    """Monthly fielding rows of a season (optionally of one player), by month."""
    return entity_scan(season_scan(df, season), player).orderBy("month") if player is not None else season_scan(df, season).orderBy("month")


def park_factor_scan(df: DataFrame, season: int) -> DataFrame:
    return df.where((F.col("season") == season) & F.col("park_factor").isNotNull())


def validate(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Missing columns raise; date columns are cast; infinities and NaN become NULL."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")

    def cleaned(field: T.StructField):
        c = F.col(field.name)
        if "game_datetime" in field.name.lower():
            return c.cast("timestamp_ntz").alias(field.name)
        if "game_date" in field.name.lower():
            return c.cast("date").alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return finite(c).alias(field.name)
        return c

    return df.select(*[cleaned(f) for f in df.schema.fields])


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table (counts are read from the file footers where possible)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Files and bytes per stored table, and of all (``table_name`` NULL), from the files' own metadata."""
    parts = [df.select(F.lit(name).alias("table_name"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct() for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.rollup("table_name").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


def ad_hoc(spark: SparkSession, text: str, args: Sequence = (), **tables: DataFrame) -> DataFrame:
    """SQL text with positional parameters over the given tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=list(args)) if args else spark.sql(text)
