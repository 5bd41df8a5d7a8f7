"""Prices and probabilities of a two-sided market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.numeric import as_col, ratio


def implied_probability(line: Column | str) -> Column:
    """American price to probability; NULL stays NULL."""
    line = as_col(line).cast("double")
    return F.when(line < 0, -line / (-line + 100.0)).otherwise(100.0 / (line + 100.0))


def without_margin(p: Column | str, other: Column | str) -> Column:
    return ratio(as_col(p), as_col(p) + as_col(other))


def add_market_probabilities(quotes: DataFrame) -> DataFrame:
    """Raw and margin-free probabilities of both sides plus the overround, in two projections."""
    raw = quotes.select(
        "*",
        implied_probability("away_opening_odds").alias("away_opening_prob_raw"),
        implied_probability("home_opening_odds").alias("home_opening_prob_raw"),
    )
    home, away = F.col("home_opening_prob_raw"), F.col("away_opening_prob_raw")
    return raw.select(
        "*",
        without_margin(home, away).alias("home_opening_prob_nv"),
        without_margin(away, home).alias("away_opening_prob_nv"),
        (home + away).alias("vig_open"),
    )


def expected_value(p: Column | str, p_market: Column | str) -> Column:
    return ratio(as_col(p), as_col(p_market)) - 1


def settle(won: Column | str, price_probability: Column | str) -> Column:
    """Profit of a one-unit bet at decimal price 1 / probability."""
    y, d = as_col(won), as_col(price_probability)
    return y * (ratio(F.lit(1.0), d) - 1) - (1 - y)


# Names that mark market information in a wide feature table.
MARKET_PROBABILITY = "p_open_home_median_nv"
STACKED_LOGIT = "pretrained_baseball_logit"
MARKET_COLUMNS = ("vig_open", "num_books", "logit_prob_home_std_nv")
MARKET_PREFIXES = (
    "p_open_",
    "home_opening_prob_",
    "away_opening_prob_",
    "home_opening_logit_",
    "away_opening_logit_",
)


def role_of(column: str) -> str:
    """What a column of the wide table is: 'stack' (the stacked logit), 'market' or 'baseball'."""
    if column == STACKED_LOGIT:
        return "stack"
    listed = set(MARKET_COLUMNS) & {column} or [p for p in MARKET_PREFIXES if column.startswith(p)]
    return "market" if listed else "baseball"


def of_role(columns, role: str) -> list[str]:
    return [c for c in columns if role_of(c) == role]
