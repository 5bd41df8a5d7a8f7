"""Line-ups: per-side player joins, means with median fill, fixed slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.sides import GAME_KEY

SLOTS = tuple(range(1, 10))
STARTER_EXCLUDED = ("_id", "player_id", "name", "last_app_date")


def lineup_players(
    games: DataFrame, lineups: DataFrame, stats: DataFrame, stat_cols: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per game, side and line-up player with the player's stats of that game.

    A game without a line-up keeps one row per side with NULLs. Both sides go through one
    join: the games are unpivoted first.
    """
    sides = games.select(
        *GAME_KEY,
        *keep,
        F.inline(
            F.array(
                F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team"), F.col("home_team").alias("opposing_team")),
                F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team"), F.col("away_team").alias("opposing_team")),
            )
        ),
    )
    players = lineups.join(stats.select("game_date", "dh", "player_id", *stat_cols), ["game_date", "dh", "player_id"], "left")
    return sides.join(players, ["game_date", "dh", "team", "opposing_team"], "left")


def side_means(rows: DataFrame, stat_cols: Sequence[str], medians: Column | DataFrame) -> DataFrame:
    """Mean per game and side; a player's missing stat counts as the league median.

    ``medians`` is a struct column, or a table with one row per season.
    """
    if isinstance(medians, DataFrame):
        table = medians.select("season", F.struct(*stat_cols).alias("__medians"))
        rows = rows.join(F.broadcast(table), "season", "left")
    else:
        rows = rows.withColumn("__medians", medians)
    return rows.groupBy(*GAME_KEY).agg(
        *[
            F.expr(f"avg(coalesce({c}, __medians.{c})) FILTER (WHERE side = '{side}') AS {side}_{c}")
            for side in ("away", "home")
            for c in stat_cols
        ]
    )


def slot_vectors(rows: DataFrame, stat_cols: Sequence[str], order: Sequence[str] = ("player_id",)) -> DataFrame:
    """Nine batting slots per side in fixed columns, with a missing flag per slot.

    First player of a slot by ``order``. The first player of every game, side and slot is found
    by one aggregate per stat, hashed where ``order`` is one plain column; at most ten rows
    per side are then laid out in columns, so a game never has to be collected.
    """
    cells = [(side, slot) for side in ("away", "home") for slot in SLOTS]
    key = order[0] if len(order) == 1 else f"struct({', '.join(order)})"
    slot = F.expr(f"CASE WHEN player_id IS NOT NULL AND batting_order BETWEEN {SLOTS[0]} AND {SLOTS[-1]} THEN batting_order END")
    named = rows.select(*GAME_KEY, "side", slot.alias("__slot"), F.expr(key).alias("__order"), *stat_cols)
    # rows without a slot keep their game
    first = named.groupBy(*GAME_KEY, "side", "__slot").agg(*[F.expr(f"min_by({c}, __order) AS {c}") for c in stat_cols])
    row = f"struct({', '.join(stat_cols)})"
    wide = first.groupBy(*GAME_KEY).agg(
        *[F.expr(f"any_value({row}) FILTER (WHERE side = '{s}' AND __slot = {n}) AS __{s}_{n}") for s, n in cells]
    )
    out = []
    for s, n in cells:
        cell, name = f"__{s}_{n}", f"{s}_batter_{n}"
        out += [f"{cell}.{c} AS {name}_{c}" for c in stat_cols]
        out.append(" AND ".join(f"{cell}.{c} IS NULL" for c in stat_cols) + f" AS {name}_is_missing_player")
    return wide.selectExpr(*GAME_KEY, *out)


def starter_stat_columns(df: DataFrame, prefix: str) -> list[str]:
    numeric = {"int", "bigint", "double", "float", "boolean", "smallint", "tinyint"}
    return [
        c for c, t in df.dtypes
        if c.startswith(prefix) and not any(x in c for x in STARTER_EXCLUDED) and t in numeric
    ]


def starter_vectors(wide: DataFrame) -> DataFrame:
    """home_starter_* / away_starter_* columns renamed to vectors with a missing flag."""
    out = []
    for side in ("away", "home"):
        prefix, name = f"{side}_starter_", f"{side}_starter_vec"
        cols = starter_stat_columns(wide, prefix)
        out += [f"{c} AS {name}_{c.removeprefix(prefix)}" for c in cols]
        out.append(" AND ".join(f"{c} IS NULL" for c in cols) + f" AS {name}_is_missing_starter")
    return wide.selectExpr(*GAME_KEY, *out)


def align_vectors(table: DataFrame, vectors: DataFrame, keys: Sequence[str], focal: str = "focal_is_home") -> DataFrame:
    """The vector row of every table row; sides are exchanged on away-focal rows."""
    cols = [c for c in vectors.columns if c not in keys]
    have = set(cols)
    out = []
    for c in cols:
        side, _, rest = c.partition("_")
        other = {"home": f"away_{rest}", "away": f"home_{rest}"}.get(side)
        out.append(f"if(cast({focal} as boolean), {c}, {other}) AS {c}" if other in have else c)
    return table.select(*keys, focal).join(vectors, list(keys), "left").selectExpr(*keys, focal, *out)
