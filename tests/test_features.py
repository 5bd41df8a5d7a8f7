"""The composed feature build on the event league: shape, keys, leakage, splits."""

import pytest

from tallyline.plans import club
from tallyline.plans.features import FeatureConfig, model_splits
from tallyline.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark):
    return club.built(Views(spark, SF))


def test_one_row_per_game_with_every_block(built):
    _, wide = built
    rows = wide.select("game_id").toPandas()
    assert len(rows) and rows["game_id"].is_unique
    for c in (
        "p_open_home_median_nv", "home_woba_season", "away_wpa_ewm_h12", "home_frv_per_9", "home_starter_fip_season", "away_starter_velo_diff",
        "home_pen_gmli_ewm_h8", "away_pen_rest_days_mean", "home_pyth_expectation_ewm_h20", "away_team_gp", "park_factor", "wind_direction_Out_To_CF",
        "home_away_starter_fip_woba_season_diff", "home_away_pen_wpa_li_ewm_h3_diff", "home_away_woba_ewm_h12_diff", "home_away_run_diff_season_diff",
    ):
        assert c in wide.columns, c
    assert "num_books" not in wide.columns and "vig_open" not in wide.columns


def test_differences_agree_with_their_sides(built):
    _, wide = built
    off = wide.where("abs(home_away_starter_fip_woba_season_diff - (home_starter_fip_season - away_woba_season)) > 1e-12")
    assert off.count() == 0


def test_splits_are_duplicated_for_training_only(spark, built):
    _, wide = built
    small = wide.select(
        "season", "game_date", "dh", "game_datetime", "home_team", "away_team", "game_id", "is_winner_home", "p_open_home_median_nv",
        "home_win_pct_season", "away_win_pct_season",
    ).withColumn("scraped_at", wide["game_id"].cast("string"))
    out = model_splits(small, FeatureConfig(perspective_duplication=True, scale=False)).toPandas()
    per_game = out.groupby(["split", "game_id"]).size()
    assert (per_game["train"] == 2).all() and (per_game["val"] == 1).all() and (per_game["test"] == 1).all()
    train = out[out.split == "train"].groupby("game_id")
    assert (train["is_winner_home"].sum() == 1).all() and train["p_open_home_median_nv"].sum().round(9).eq(1).all()
