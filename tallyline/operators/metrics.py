"""The metric blocks, their weights, shrinkage strengths and sample floors."""

from __future__ import annotations

from tallyline.operators.history import Metric

BATTING = (
    Metric("woba", "woba", "pa", 100),
    Metric("ops", "ops", "pa", 100),
    Metric("wrc_plus", "wrc_plus", "pa", 150),
    Metric("iso", "iso", "ab", 100),
    Metric("babip", "babip", "bip", 200),
    Metric("k_percent", "k_percent", "pa", 150),
    Metric("bb_percent", "bb_percent", "pa", 150),
    Metric("barrel_percent", "barrel_percent", "bip", 70),
    Metric("hard_hit", "hard_hit", "bip", 100),
    Metric("ev", "ev", "bip", 50),
    Metric("gb_fb", "gb_fb", "bip", 150),
    Metric("bb_k", "bb_k", "pa", 150),
    Metric("baserunning", "baserunning", "pa", 150),
    Metric("wraa", "wraa", "pa", 200),
    Metric("wpa", "wpa", "pa", 250),
)
RELIEVER = (
    Metric("era", "era", "ip", 30),
    Metric("k_percent", "k_percent", "tbf", 120),
    Metric("bb_percent", "bb_percent", "tbf", 120),
    Metric("k_bb_percent", "k_bb_percent", "tbf", 120),
    Metric("babip", "babip", "bip", 180),
    Metric("barrel_percent", "barrel_percent", "bip", 100),
    Metric("hard_hit", "hard_hit", "bip", 100),
    Metric("ev", "ev", "bip", 180),
    Metric("hr_fb", "hr_fb", "bip", 80),
    Metric("fip", "fip", "ip", 20),
    Metric("siera", "siera", "ip", 20),
    Metric("stuff", "stuff", "tbf", 40),
    Metric("gmli", "gmli", "apps", 10),
    Metric("wpa_li", "wpa_li", "apps", 10),
)
STARTER = (
    Metric("era", "era", "ip", 30),
    Metric("k_percent", "k_percent", "tbf", 100),
    Metric("bb_percent", "bb_percent", "tbf", 100),
    Metric("k_bb_percent", "k_bb_percent", "tbf", 120),
    Metric("babip", "babip", "bip", 150),
    Metric("barrel_percent", "barrel_percent", "bip", 120),
    Metric("hard_hit", "hard_hit", "bip", 120),
    Metric("ev", "ev", "bip", 120),
    Metric("hr_fb", "hr_fb", "bip", 80),
    Metric("fip", "fip", "ip", 50),
    Metric("siera", "siera", "ip", 50),
    Metric("stuff", "stuff", "tbf", 40),
    Metric("wpa", "wpa", "apps", 10),
)
BATTING_FLOORS = {"pa": 100, "ab": 75, "bip": 50}
PITCHING_FLOORS = {"tbf": 100, "bip": 50, "ip": 20, "apps": 10}

BATTER_HALFLIVES = (4, 12)
STARTER_HALFLIVES = (3, 8)
RELIEVER_HALFLIVES = (3, 8)
TEAM_HALFLIVES = (3, 8, 20)

# stat -> (weight, which direction is better)
BATTING_LEAGUE = {
    "woba": ("pa", "higher"), "ops": ("pa", "higher"), "bb_percent": ("pa", "higher"),
    "bb_k": ("pa", "higher"), "babip": ("bip", "higher"), "barrel_percent": ("bip", "higher"),
    "hard_hit": ("bip", "higher"), "ev": ("bip", "higher"), "gb_fb": ("bip", "higher"),
    "iso": ("ab", "higher"), "k_percent": ("pa", "lower"),
}
PITCHING_LEAGUE = {
    "era": ("ip", "lower"), "fip": ("ip", "lower"), "siera": ("ip", "lower"),
    "k_percent": ("tbf", "higher"), "bb_percent": ("tbf", "lower"),
    "k_bb_percent": ("tbf", "higher"), "babip": ("bip", "lower"),
    "barrel_percent": ("bip", "lower"), "hard_hit": ("bip", "lower"), "ev": ("bip", "lower"),
    "hr_fb": ("bip", "lower"),
}

# match-up differences
STARTER_DIFFS = (
    "starter_era", "starter_babip", "starter_hard_hit", "starter_k_percent",
    "starter_barrel_percent", "starter_fip", "starter_siera", "starter_stuff", "starter_ev",
    "starter_hr_fb", "starter_wpa",
)
PEN_DIFFS = (
    "pen_era", "pen_babip", "pen_hard_hit", "pen_k_percent", "pen_barrel_percent", "pen_fip",
    "pen_siera", "pen_stuff", "pen_ev", "pen_hr_fb", "pen_wpa_li",
)
STARTER_VS_BATTER = (
    ("starter_fip", "woba"), ("starter_k_percent", "k_percent"),
    ("starter_bb_percent", "bb_percent"), ("starter_barrel_percent", "barrel_percent"),
)
TEAM_DIFFS = ("win_pct", "pyth_expectation", "run_diff", "one_run_win_pct")
BATTING_DIFFS = (
    "woba", "wrc_plus", "hard_hit", "barrel_percent", "bb_k", "ops", "babip", "ev", "iso",
    "baserunning", "wpa",
)


def horizons(halflives) -> list[str]:
    return ["season", *[f"ewm_h{h}" for h in halflives]]
