"""Expected value, best quote per game, bet policy, return on investment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.functions.market import expected_value, settle
from tallyline.operators.dedupe import duplicate_groups, keep_first
from tallyline.operators.prepare import half_point


def attach_predictions(quotes: DataFrame, predictions: DataFrame, key: str = "game_id", validate: bool = True) -> DataFrame:
    """Every quote with the prediction of its game, if any (1:m)."""
    if validate and duplicate_groups(predictions, [key]).first():
        raise ValueError("predictions are not unique per game")
    return predictions.join(quotes, key, "right")


def quote_values(joined: DataFrame) -> DataFrame:
    ev = joined.select(
        "*",
        expected_value("p_home", "home_opening_prob_raw").alias("ev_home"),
        expected_value(1 - F.col("p_home"), "away_opening_prob_raw").alias("ev_away"),
    ).withColumn("max_ev", F.greatest("ev_home", "ev_away"))
    side = F.when(F.col("max_ev") == F.col("ev_home"), "home").otherwise("away")
    return ev.withColumn("max_ev_side", side)


def best_quotes(values: DataFrame, key: str = "game_id") -> DataFrame:
    """Highest value per game; ties by book and quote. A combined aggregate, not a window."""
    worst_last = -F.coalesce(F.col("max_ev"), F.lit(float("-inf")))
    return keep_first(values, [key], [worst_last, "sportsbook", "quote_id"])


def bets(best: DataFrame) -> DataFrame:
    home = F.col("max_ev_side") == "home"
    d = F.when(home, F.col("home_opening_prob_raw")).otherwise(F.col("away_opening_prob_raw"))
    y = F.when(home, F.col("is_winner_home")).otherwise(1 - F.col("is_winner_home"))
    return best.where(F.col("max_ev") > 0).withColumn("profit", settle(y, d))


def value_summary(best: DataFrame) -> DataFrame:
    return best.agg(
        F.avg("max_ev").alias("mean_ev"), F.min("max_ev").alias("min_ev"),
        F.max("max_ev").alias("max_ev"), F.stddev_samp("max_ev").alias("std_ev"),
    )


def roi(placed: DataFrame) -> DataFrame:
    """Profit per bet; NULL without bets."""
    return placed.agg(
        F.count(F.lit(1)).alias("n_bets"),
        F.sum("profit").alias("profit"),
        F.try_divide(F.sum("profit"), F.count(F.lit(1)).cast("double")).alias("roi"),
    )


def back_test(predictions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes from the middle date of the predictions on -> best quote per game -> bets."""
    counts = predictions.groupBy("game_date").agg(F.count(F.lit(1)).alias("n"))
    cut = half_point(counts, "game_date").scalar()
    late = quotes.where(F.col("game_date") >= cut)
    joined = attach_predictions(late, predictions.drop("game_date"))
    return roi(bets(best_quotes(quote_values(joined))))
