"""Strict as-of joins, nearest-in-time matches and forward fill.

Both sides are first reduced to one row per key and time (a map-side combined aggregate), so
a window never holds more rows of a key than there are distinct times; the full rows come
back by an equi join on (key, time), which splits a hot key by time.

A key with more times than a window should hold is cut into stretches of its clock, as long
histories are. Every stretch is searched alone; what the stretches before it (after it) know
last (first) is carried on, one row per stretch, and fills the places where its own rows know
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyline.functions.numeric import as_col
from tallyline.operators.history import HistorySize, hot_entities, measure
from tallyline.session import pin

MIN_STRETCH_ROWS = 1_000_000  # a row of these windows is a key, a time and one value


def before_game(day, dh: int, date_col: str = "game_date", dh_col: str = "dh") -> Column:
    """Rows strictly before a game: the second game of a day also sees the first."""
    d = F.lit(day).cast("date")
    earlier = F.col(date_col) < d
    if dh <= 1:
        return earlier
    return earlier | ((F.col(date_col) == d) & (F.col(dh_col) < dh))


def _clock(df: DataFrame, time: str) -> str:
    """A whole number that never falls along ``time``."""
    kind = dict(df.dtypes)[time]
    if kind == "date":
        return f"cast(unix_date({time}) as bigint)"
    if kind.startswith("timestamp"):
        return f"unix_seconds(cast({time} as timestamp))"
    if kind in ("double", "float"):
        return f"cast(floor(greatest(least({time}, 1e12D), -1e12D) * 1048576) as bigint)"
    return f"cast(floor({time}) as bigint)"


def _segment_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> int | None:
    """Rows that a stretch may have; None where no key has as many, which a plain count tells of small tables."""
    both = left.select(*keys).unionByName(right.select(*keys))
    rows = both.count()
    limit = max(MIN_STRETCH_ROWS, HistorySize(rows, 0).segment_rows)
    return limit if rows > limit and measure(both, keys).longest > limit else None


def _looked_up(
    both: DataFrame, keys: Sequence[str], time: str, known: str, looks: dict[str, tuple[bool, list, int]], segment_rows: int | None
) -> DataFrame:
    """``both`` with a column per look: the last ``known`` value that is not NULL along its order.

    A look is (backwards in time?, order, last row of the frame relative to the current one).
    """
    keys = list(keys)
    if segment_rows is not None:
        both = both.withColumn("__tick", F.expr(_clock(both, time)))
        hot = hot_entities(both, keys, "__tick", segment_rows)
        both = both.join(F.broadcast(hot), keys, "left").selectExpr(
            *[c for c in both.columns if c != "__tick"], "cast(coalesce(floor((__tick - __first) / __width), 0) as bigint) AS __seg")
        keys.append("__seg")
    found = both.select(
        "*", *[F.last(known, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, end)).alias(name) for name, (_, order, end) in looks.items()]
    )
    if segment_rows is None:
        return found
    # one row per stretch: the value it hands on in either direction
    there = both.where(F.col(known).isNotNull()).groupBy(*keys).agg(
        *[(F.min_by if back else F.max_by)(known, time).alias(f"__own_{name}") for name, (back, *_) in looks.items()])
    stretches = both.select(*keys).distinct().join(there, keys, "left")
    along = lambda back: W.partitionBy(*keys[:-1]).orderBy(F.col("__seg").desc() if back else F.col("__seg")).rowsBetween(W.unboundedPreceding, -1)
    carried = stretches.select(*keys, *[F.last(f"__own_{name}", ignorenulls=True).over(along(back)).alias(f"__carried_{name}") for name, (back, *_) in looks.items()])
    filled = [F.coalesce(name, f"__carried_{name}").alias(name) for name in looks]
    return found.join(carried, keys, "left").select(*[c for c in both.columns if c != "__seg"], *filled)


def asof_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    payload: Sequence[str],
    tie_order: Sequence[Column | str] = (),
    segment_rows: int | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Left rows plus the payload of the last right row of the key with an earlier ``time``.

    Equal times match only where ``inclusive``; several right rows at one time -> the last by ``tie_order``.
    """
    keys = list(keys)
    segment_rows = segment_rows or _segment_rows(left, right, keys)
    at = [*keys, time]
    row = F.struct(*payload)
    if tie_order:
        row = F.max_by(row, F.struct(*[as_col(c) for c in tie_order]))
    else:
        row = F.max(row)
    known = right.groupBy(*at).agg(row.alias("__row")).withColumn("__is_left", F.lit(0))
    asked = left.select(*at).distinct().select(
        *at, F.lit(None).cast(known.schema["__row"].dataType).alias("__row"), F.lit(1).alias("__is_left")
    )
    # rows at the same time sort after the question, so they stay invisible to it
    is_left = F.col("__is_left").asc() if inclusive else F.col("__is_left").desc()
    look = {"__found": (False, [F.col(time), is_left], -1)}
    answers = _looked_up(known.unionByName(asked), keys, time, "__row", look, segment_rows).where(F.col("__is_left") == 1).select(*at, "__found")
    return left.join(answers, at, "left").select(
        *left.columns, *[F.col("__found")[c].alias(c) for c in payload]
    )


def forward_fill_groups(
    snapshots: DataFrame, wanted: DataFrame, keys: Sequence[str], time: str, replace: Sequence[str] = (), segment_rows: int | None = None
) -> DataFrame:
    """Snapshot rows for wanted (key, time) pairs that have none: the key's latest earlier
    snapshot, stamped with the wanted time and the wanted row's ``replace`` columns.
    Nothing earlier -> no rows.
    """
    keys = list(keys)
    at = [*keys, time]
    times = snapshots.select(*at).distinct()
    missing = wanted.join(times, at, "left_anti")
    source = asof_before(
        missing, times.withColumn("__source", F.col(time)), keys, time, ["__source"], segment_rows=segment_rows
    ).where(F.col("__source").isNotNull())
    body = [c for c in snapshots.columns if c not in {*at, *replace}]
    old = snapshots.select(*keys, F.col(time).alias("__source"), *body)
    return source.select(*keys, "__source", time, *replace).join(old, [*keys, "__source"]).select(
        *at, *replace, *body
    )


def nearest_in_time(
    asked: DataFrame,
    offers: DataFrame,
    keys: Sequence[str],
    time: str,
    payload: Sequence[str],
    prefer: str,
    segment_rows: int | None = None,
) -> DataFrame:
    """Asked rows plus the payload of the key's offer closest in time (inner).

    Equal distance -> the smallest ``prefer``. Linear: the last offer at or before and the
    first one at or after are looked up, no pairs are formed.
    """
    keys = list(keys)
    at = [*keys, time]
    cols = list(dict.fromkeys([prefer, *payload]))
    best = offers.groupBy(*at).agg(F.min(F.struct(*cols)).alias("__row"))
    best = best.withColumn("__offer", F.struct(F.col(time).alias("t"), F.col("__row").alias("r")))
    known = best.select(*at, "__offer", F.lit(0).alias("__ask"))
    times = asked.select(*at).distinct().select(
        *at, F.lit(None).cast(known.schema["__offer"].dataType).alias("__offer"), F.lit(1).alias("__ask")
    )
    # counted and searched, so written once: the windows hold distinct times, not the asked rows
    both = pin(known.unionByName(times), "times")
    segment_rows = segment_rows or _segment_rows(both, both.limit(0), keys)
    looks = {"__p": (False, [F.col(time), F.col("__ask")], 0), "__f": (True, [F.col(time).desc(), F.col("__ask")], 0)}
    both = _looked_up(both, keys, time, "__offer", looks, segment_rows).where(F.col("__ask") == 1)

    def candidate(c):
        gap = F.abs(F.timestamp_diff("SECOND", F.col(c)["t"], F.col(time)))
        return F.when(F.col(c).isNotNull(), F.struct(gap.alias("gap"), F.col(c)["r"].alias("r")))

    chosen = both.select(*at, F.least(candidate("__p"), candidate("__f")).alias("__best"))
    chosen = chosen.where(F.col("__best").isNotNull())
    return asked.join(chosen, at).select(
        *asked.columns, *[F.col("__best")["r"][c].alias(c) for c in payload]
    )


def mirror_fill(matchups: DataFrame, keys=("game_date", "dh")) -> DataFrame:
    """A missing own starter is read from the opponent's record of the same game."""
    other = (
        matchups.where(F.col("team_starter_id").isNotNull())
        .groupBy(*keys, F.col("opposing_team").alias("team"))
        .agg(F.max("opposing_starter_id").alias("__mirror"))
    )
    return matchups.join(other, [*keys, "team"], "left").select(
        *[
            F.coalesce("team_starter_id", "__mirror").alias(c) if c == "team_starter_id" else F.col(c)
            for c in matchups.columns
        ]
    )
