"""Game-context expressions: weather text, one-hot vocabularies, months, roles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyline.functions.numeric import as_col

# The closed vocabularies of the one-hot columns.
WIND_DIRECTIONS = (
    "None", "Calm", "In From LF", "In From CF", "In From RF", "Out To LF",
    "Out To RF", "Out To CF", "R To L", "L To R", "Varies",
)
CONDITIONS = (
    "Cloudy", "Snow", "Roof Closed", "Sunny", "Partly Cloudy", "Clear",
    "Rain", "Overcast", "Dome", "Drizzle", "Unknown",
)
# Fixed value: the one two-way player who is never dropped as a pitcher.
TWO_WAY_PLAYER = 19755


def wind_magnitude(wind: Column | str) -> Column:
    """'8 mph, Out To CF' -> 8; missing or unreadable -> 0."""
    head = F.try_element_at(F.split(as_col(wind), ",", 2), F.lit(1))
    token = F.try_element_at(F.split(F.trim(head), r"\s+"), F.lit(1))
    return F.coalesce(token.try_cast("double").cast("int"), F.lit(0))


def wind_direction(wind: Column | str) -> Column:
    tail = F.try_element_at(F.split(as_col(wind), ",", 2), F.lit(2))
    return F.trim(F.coalesce(tail, F.lit("None")))


def one_hot(value: Column | str, vocabulary, prefix: str) -> list[Column]:
    """One boolean per word of a closed vocabulary; an unknown value is false everywhere."""
    value = as_col(value)
    return [
        value.eqNullSafe(F.lit(word)).alias(f"{prefix}_{word.replace(' ', '_')}")
        for word in vocabulary
    ]


def is_day_game(flag: Column | str) -> Column:
    return as_col(flag).eqNullSafe(F.lit("day"))


def season_month(day: Column | str) -> Column:
    """Month with the short edge months folded in: March -> April, October -> September."""
    m = F.month(as_col(day))
    return F.when(m == 3, 4).when(m == 10, 9).otherwise(m)


def is_position_player(pos: Column | str, player_id: Column | str, exempt: int = TWO_WAY_PLAYER) -> Column:
    pitcher = F.coalesce(as_col(pos), F.lit("")).startswith("P")
    return ~(pitcher & (as_col(player_id) != exempt))


def rate_per_nine(value: Column | str, innings: Column | str) -> Column:
    return F.try_divide(as_col(value).cast("double"), as_col(innings).cast("double")) * 9.0


def doubleheader_code(status: Column | str, number: Column | str) -> Column:
    """'N' -> 0, 'Y'/'S' -> 1 or 2 by game number, anything else NULL (a reject)."""
    status = as_col(status)
    return F.when(status == "N", 0).when(
        status.isin("Y", "S"), F.when(as_col(number) == 1, 1).otherwise(2)
    )


def winner_by_flags(away_won, home_won, away, home) -> Column:
    """Exactly one flag set, else NULL (a reject)."""
    away_won, home_won = as_col(away_won), as_col(home_won)
    return F.when(away_won & ~home_won, as_col(away)).when(home_won & ~away_won, as_col(home))


def winner_by_score(away_score, home_score, away, home) -> Column:
    return F.when(as_col(away_score) > as_col(home_score), as_col(away)).otherwise(as_col(home))


def tag_side(team, home, away) -> Column:
    team = F.lit(team) if not isinstance(team, Column) else team
    return F.when(as_col(home) == team, "home").when(as_col(away) == team, "away")
