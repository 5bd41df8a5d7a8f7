"""Time the headline queries: BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default all)."""

from __future__ import annotations

import json
import os
import time

from tallyline.plans import catalog
from tallyline.session import local_session

HEADLINE = (
    "a1_season_scan", "a13_keyed_upsert", "b2_margin_removal", "e1_running_sum", "e3_ewm_rate", "e5_rolling_block", "e8_win_pct",
    "e13_batting_block", "e_team_form_per_game", "c7_strict_asof_join", "c12_nearest_in_time", "c13_reconciliation", "c20_slot_pivot",
    "d10_quote_consensus", "d12_league_average", "d18_median_imputation", "d19_probability_metrics", "d20_calibration_error",
    "f1_best_quote", "g4_perspective_duplication", "h1_season_split", "h9_platt_grid", "h15_back_test",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    catalog.QUERIES["a25_table_inventory"](spark, sf_dir).collect()  # start-up cost stays out
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
