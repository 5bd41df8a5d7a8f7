"""Team names and abbreviations as the sources spell them."""

TEAM_ALIASES = {
    "Arizona Diamondbacks": "ARI", "Atlanta Braves": "ATL", "Baltimore Orioles": "BAL",
    "Boston Red Sox": "BOS", "Chicago Cubs": "CHC", "Chicago White Sox": "CHW",
    "Cincinnati Reds": "CIN", "Cleveland Guardians": "CLE", "Cleveland Indians": "CLE",
    "Colorado Rockies": "COL", "Detroit Tigers": "DET", "Houston Astros": "HOU",
    "Kansas City Royals": "KCR", "Los Angeles Angels": "LAA", "Los Angeles Dodgers": "LAD",
    "Miami Marlins": "MIA", "Milwaukee Brewers": "MIL", "Minnesota Twins": "MIN",
    "New York Mets": "NYM", "New York Yankees": "NYY", "Oakland Athletics": "ATH",
    "Athletics": "ATH", "OAK": "ATH", "Philadelphia Phillies": "PHI",
    "Pittsburgh Pirates": "PIT", "San Diego Padres": "SDP", "San Francisco Giants": "SFG",
    "Seattle Mariners": "SEA", "St. Louis Cardinals": "STL", "Tampa Bay Rays": "TBR",
    "Texas Rangers": "TEX", "Toronto Blue Jays": "TOR", "Washington Nationals": "WSN",
    "Diamondbacks": "ARI", "Braves": "ATL", "Orioles": "BAL", "Red Sox": "BOS", "Cubs": "CHC",
    "White Sox": "CHW", "Reds": "CIN", "Cleveland": "CLE", "Guardians": "CLE",
    "Indians": "CLE", "Rockies": "COL", "Tigers": "DET", "Astros": "HOU", "Royals": "KCR",
    "Angels": "LAA", "Dodgers": "LAD", "Marlins": "MIA", "Brewers": "MIL", "Twins": "MIN",
    "Mets": "NYM", "Yankees": "NYY", "Phillies": "PHI", "Pirates": "PIT", "Padres": "SDP",
    "Giants": "SFG", "Mariners": "SEA", "Cardinals": "STL", "Rays": "TBR", "Rangers": "TEX",
    "Blue Jays": "TOR", "Nationals": "WSN",
}

# spellings of the price source
QUOTE_ALIASES = {
    "AZ": "ARI", "KC": "KCR", "OAK": "ATH", "SD": "SDP", "SF": "SFG", "TB": "TBR", "WAS": "WSN",
}
