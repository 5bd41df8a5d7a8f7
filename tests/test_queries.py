"""Registered queries against their oracles on the smallest data. ALL_QUERIES=1 runs every one."""

import os

import pytest

from oracle_check import compare, connect
from tallyline.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = (
    "a3_history_before_game a13_keyed_upsert a13_partition_move a15_schedule_payload a19_game_log_pitchers a22_embedded_page_rows b3_clipped_logit b9_one_hot "
    "b16_name_normalisation b21_matchup_recompute c7_strict_asof_join c8_roster_forward_fill c12_nearest_in_time c13_reconciliation c20_slot_pivot "
    "d3_tiered_priors d5_lineup_means d7_reserve_availability d12_league_average d14_league_deltas d18_median_imputation d19_probability_metrics "
    "d20_calibration_error d21_merged_bins d25_roc_points e3_ewm_rate e3_long_gap e5_rolling_block e10_pythagorean e13_batting_block e16_velocity_trend "
    "e17_stability_score e_team_form_per_game f1_best_quote g4_perspective_duplication h1_season_split h3_expanding_folds h9_platt_grid h11_isotonic_fit "
    "h15_back_test j1_incremental_ingest"
).split()
NAMES = list(catalog.ORACLES) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck.execute(catalog.ORACLES[name]).df()) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
