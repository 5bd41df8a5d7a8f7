import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyline.operators import asof, dedupe, lineups, quotes, reserve
from tallyline.operators.sides import GAME_KEY

D = lambda n: date(2024, 4, n)


def test_strict_asof_ignores_the_same_day_and_takes_the_last_of_a_day(spark):
    left = spark.createDataFrame([("a", D(5)), ("a", D(1)), ("b", D(9))], "k string, d date")
    right = spark.createDataFrame([("a", D(5), 1, 50), ("a", D(3), 1, 31), ("a", D(3), 2, 32)], "k string, d date, dh int, v int")
    got = {(r["k"], r["d"]): r["v"] for r in asof.asof_before(left, right, ["k"], "d", ["v"], ["dh"]).collect()}
    assert got == {("a", D(5)): 32, ("a", D(1)): None, ("b", D(9)): None}


def test_forward_fill(spark):
    rosters = spark.createDataFrame([("T", D(1), 1), ("T", D(1), 2), ("T", D(4), 3), ("U", D(9), 4)], "team string, d date, player int")
    want = spark.createDataFrame([("T", D(3), 7), ("T", D(4), 8), ("T", D(6), 9), ("U", D(2), 5)], "team string, d date, starter int")
    got = {(r["team"], r["d"], r["starter"], r["player"]) for r in asof.forward_fill_groups(rosters, want, ["team"], "d", ["starter"]).collect()}
    assert got == {("T", D(3), 7, 1), ("T", D(3), 7, 2), ("T", D(6), 9, 3)}


def test_nearest_time(spark):
    t = lambda h, m: datetime(2024, 4, 1, h, m)
    games = spark.createDataFrame([("g", t(13, 5), 1, "one"), ("g", t(19, 5), 2, "two")], "k string, t timestamp_ntz, dh int, id string")
    asked = spark.createDataFrame([("g", t(12, 55)), ("g", t(19, 15)), ("g", t(16, 5)), ("x", t(1, 0))], "k string, t timestamp_ntz")
    got = {r["t"]: r["id"] for r in asof.nearest_in_time(asked, games, ["k"], "t", ["id"], "dh").collect()}
    # 16:05 is three hours from both: the lower dh wins; 'x' has no game and is gone
    assert got == {t(12, 55): "one", t(19, 15): "two", t(16, 5): "one"}


def test_mirror_fill(spark):
    rows = [(D(1), 0, "A", "B", None, 9), (D(1), 0, "B", "A", 9, 5)]
    df = spark.createDataFrame(rows, "game_date date, dh int, team string, opposing_team string, team_starter_id long, opposing_starter_id long")
    assert {r["team"]: r["team_starter_id"] for r in asof.mirror_fill(df).collect()} == {"A": 5, "B": 9}


def test_availability(spark):
    rows = [(D(10), "T", D(8), 2.0), (D(10), "T", D(7), 1.0)]
    df = spark.createDataFrame(rows, "game_date date, team string, last_app_date date, gmli_ewm_h8 double")
    r = reserve.availability(df, ["game_date", "team"], "gmli_ewm_h8").first()
    assert r["team_pen_rest_days_mean"] == 2.5 and r["team_pen_rest_days_median"] == 2.5
    assert r["team_pen_freshness_mean"] == pytest.approx(0.8333, abs=1e-4)
    assert r["team_pen_freshness_gmliw"] == pytest.approx(7 / 9)
    assert r["team_pen_hi_lev_available"] == pytest.approx(1.0)


def test_unknown_starter_excludes_nobody(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "player_id int, team_starter_id int")
    assert sorted(r["player_id"] for r in reserve.exclude_starter(df).collect()) == [2, 3]


def test_opener_needs_a_known_share(spark):
    rows = [(1, 1, 5), (1, 0, 5), (2, None, None), (3, 3, 3), (4, 0, 0)]
    df = spark.createDataFrame(rows, "player_id int, gs int, games int")
    got = {r["player_id"]: r["is_opener_flag"] for r in reserve.opener_flags(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_keep_first_is_an_aggregate(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (2, 7, None)], "k int, o int, v string")
    out = dedupe.keep_first(df, ["k"], ["o"])
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(1, "y"), (2, None)]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_consensus_of_one_book_has_no_spread(spark):
    from tallyline.functions.market import add_market_probabilities

    rows = [(D(1), datetime(2024, 4, 1), "A", "B", "b1", 120.0, -140.0)]
    q = spark.createDataFrame(rows, "game_date date, game_datetime timestamp_ntz, away_team string, home_team string, sportsbook string, away_opening_odds double, home_opening_odds double")
    r = quotes.consensus(add_market_probabilities(q), market_only=True).first()
    raw_home, raw_away = 140 / 240, 100 / 220
    assert r["num_books"] == 1 and r["p_open_home_std"] == 0 and r["logit_prob_home_std_nv"] == 0
    assert r["p_open_home_median_nv"] == pytest.approx(raw_home / (raw_home + raw_away))
    assert r["vig_open"] == pytest.approx(raw_home + raw_away)


def test_slots_and_median_fill(spark):
    games = spark.createDataFrame([("g1", D(1), 0, "H", "A")], f"{GAME_KEY[0]} string, game_date date, dh int, home_team string, away_team string")
    lu = spark.createDataFrame([(D(1), 0, "H", "A", 1, 1), (D(1), 0, "H", "A", 2, 1), (D(1), 0, "H", "A", 3, 2)], "game_date date, dh int, team string, opposing_team string, player_id int, batting_order int")
    stats = spark.createDataFrame([(D(1), 0, 1, 0.5), (D(1), 0, 2, 0.9), (D(2), 0, 3, 7.0)], "game_date date, dh int, player_id int, woba_season double")
    rows = lineups.lineup_players(games, lu, stats, ["woba_season"])
    r = lineups.slot_vectors(rows, ["woba_season"]).first()
    assert r["home_batter_1_woba_season"] == 0.5 and not r["home_batter_1_is_missing_player"]
    assert r["home_batter_2_woba_season"] is None and r["home_batter_2_is_missing_player"]
    assert r["away_batter_9_is_missing_player"]
    no_lineup = lineups.slot_vectors(rows.where("player_id IS NULL"), ["woba_season"]).first()
    assert no_lineup["home_batter_1_is_missing_player"] and no_lineup[GAME_KEY[0]] == "g1"
    plan = lineups.slot_vectors(rows, ["woba_season"])._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(struct" not in plan  # wide rows are not sorted to find the first player
    from pyspark.sql import functions as F

    m = lineups.side_means(rows, ["woba_season"], F.struct(F.lit(0.7).alias("woba_season"))).first()
    assert m["home_woba_season"] == pytest.approx((0.5 + 0.9 + 0.7) / 3) and m["away_woba_season"] == pytest.approx(0.7)


def test_all_books_are_priced_and_unlisted_books_raise(spark):
    rows = [(1, 1, "a", 110.0), (1, 5, "b", 120.0), (1, 5, "c", 125.0), (2, 9, "d", -130.0)]
    q = spark.createDataFrame(rows, "true_game_id int, sportsbook int, quote_id string, home_opening_odds double")
    long = quotes.book_prices(q, ["true_game_id"], ["home_opening_odds"])
    assert sorted(tuple(r) for r in long.collect()) == [(1, 1, 1, 110.0), (1, 5, 2, 120.0), (2, 9, 1, -130.0)]
    wide = quotes.pivot_books(q, ["true_game_id"], [1, 5, 9], ["home_opening_odds"]).orderBy("true_game_id")
    assert [tuple(r) for r in wide.collect()] == [(1, 110.0, 120.0, None), (2, None, None, -130.0)]
    with pytest.raises(Exception, match="not in the pivot's list: 9"):
        quotes.pivot_books(q, ["true_game_id"], [1, 5], ["home_opening_odds"]).collect()


def one_hot_key(seed=3, rows=400):
    """Nine tenths of all rows share a key; times come in bursts and at long intervals."""
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 9 + ["cold"])
    at = lambda: datetime(2024, 1, 1) + timedelta(seconds=rng.choice([rng.randrange(600), rng.randrange(40_000_000)]))
    left = [(key(), at(), i) for i in range(rows)]
    right = [(key(), rng.choice([at(), rng.choice(left)[1]]), i % 3, i) for i in range(rows)]
    return left, right


def test_hot_key_is_cut_and_gives_the_same_rows(spark):
    left, right = one_hot_key()
    a = spark.createDataFrame(left, "k string, t timestamp_ntz, i int")
    b = spark.createDataFrame(right, "k string, t timestamp_ntz, dh int, v int")
    early = lambda rows, k, t: [r for r in rows if r[0] == k and r[1] < t]
    want = {i: max(((r[1], r[2], r[3]) for r in early(right, k, t)), default=(0, 0, None))[2] for k, t, i in left}
    for segment in (None, 20, 7):
        got = {r.i: r.v for r in asof.asof_before(a, b, ["k"], "t", ["v"], ["dh", "v"], segment_rows=segment).collect()}
        assert got == want
    gap = lambda r, t: (abs((r[1] - t).total_seconds()), r[2], r[3])
    want = {i: min(gap(r, t) for r in right if r[0] == k)[2] for k, t, i in left}
    for segment in (None, 20, 7):
        got = {r.i: r.v for r in asof.nearest_in_time(a, b, ["k"], "t", ["v"], "dh", segment_rows=segment).collect()}
        assert got == want


def test_no_window_holds_more_than_a_stretch(spark):
    left, right = one_hot_key()
    both = spark.createDataFrame([(k, t, None) for k, t, _ in left] + [(k, t, 1) for k, t, *_ in right], "k string, t timestamp_ntz, v int")
    hot = asof.hot_entities(both.withColumn("__tick", F.expr(asof._clock(both, "t"))), ["k"], "__tick", 60)
    cut = both.join(hot, "k").withColumn("seg", F.expr("floor((unix_seconds(cast(t as timestamp)) - __first) / __width)"))
    sizes = [r["count"] for r in cut.groupBy("k", "seg").count().collect()]
    assert len(sizes) > 5 and max(sizes) <= 60


def test_hot_key_of_dates_fills_forward(spark):
    days = [date(2020, 1, 1) + timedelta(days=3 * i) for i in range(300)]
    rosters = spark.createDataFrame([("T", d, n) for n, d in enumerate(days) if n % 5], "team string, d date, player int")
    want = spark.createDataFrame([("T", d, n) for n, d in enumerate(days)], "team string, d date, starter int")
    rows = lambda s: sorted(map(tuple, asof.forward_fill_groups(rosters, want, ["team"], "d", ["starter"], segment_rows=s).collect()))
    assert rows(None) == rows(11) and len(rows(11)) == 59


def test_a_pivot_of_more_books_than_a_plan_of_aggregates_holds(spark):
    q = spark.range(6_000).selectExpr("id % 3 AS true_game_id", "int(id) AS sportsbook", "string(id) AS quote_id", "double(id) AS home_opening_odds")
    books = quotes.book_list(q)
    assert len(books) == 6_000
    wide = quotes.pivot_books(q, ["true_game_id"], books, ["home_opening_odds"])
    assert len(wide.columns) == 6_001
    got = {r.true_game_id: r for r in wide.collect()}
    assert got[2]["home_opening_odds_5999"] == 5999.0 and got[1]["home_opening_odds_5999"] is None
    assert [sum(x is not None for x in got[g]) - 1 for g in (0, 1, 2)] == [2_000] * 3


def test_a_pivot_is_laid_out_by_all_cores_without_a_cell_in_python(spark):
    q = spark.range(3_000).selectExpr("id % 300 AS true_game_id", "int(id % 50) AS sportsbook", "string(id) AS quote_id", "double(id) AS home", "CASE WHEN id % 7 > 0 THEN int(id) END AS away")
    wide = quotes.pivot_books(q, ["true_game_id"], list(range(50)), ["home", "away"], lambda price, book: f"{book}_{price}")
    assert wide.columns[:3] == ["true_game_id", "0_home", "0_away"] and dict(wide.dtypes)["49_away"] == "int"
    rows = wide.withColumn("part", F.spark_partition_id()).collect()
    assert len({r["part"] for r in rows}) > spark.sparkContext.defaultParallelism  # few bytes are merged into few tasks else
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    first = {}
    for i in sorted(range(3_000), key=str):
        first.setdefault((i % 300, i % 50), i)
    assert len(rows) == 300
    for r in rows:
        for b in range(50):
            i = first.get((r["true_game_id"], b))
            assert r[f"{b}_home"] == i and r[f"{b}_away"] == (i if i is not None and i % 7 else None)


def test_a_pivot_keeps_any_type_and_no_books_give_no_columns(spark):
    rows = [(1, "a", "q1", "x", D(1), [1, None], Decimal("1.500")), (1, "a", "q0", None, D(2), [], None), (None, "b c", "q2", "", None, None, Decimal("-0.125"))]
    q = spark.createDataFrame(rows, "g int, sportsbook string, quote_id string, s string, d date, l array<int>, e decimal(9,3)")
    got = {r.g: r for r in quotes.pivot_books(q, ["g"], ["a", "b c"], ["s", "d", "l", "e"]).collect()}
    assert tuple(got[1])[1:] == (None, D(2), [], None, None, None, None, None)
    assert tuple(got[None])[1:] == (None, None, None, None, "", None, None, Decimal("-0.125"))
    assert [r.g for r in quotes.pivot_books(q.where("g > 1"), ["g"], [], ["s"]).collect()] == []
    with pytest.raises(Exception, match="not in the pivot's list"):
        quotes.pivot_books(q, ["g"], [], ["s"]).collect()
    with pytest.raises(Exception, match="not in the pivot's list: NULL"):
        quotes.pivot_books(q.selectExpr("g", "string(NULL) AS sportsbook", "quote_id", "s"), ["g"], ["a"], ["s"]).collect()


def test_kept_quotes_carry_only_what_is_asked_for(spark):
    from tallyline.functions.market import add_market_probabilities

    games = spark.createDataFrame([(D(1), datetime(2024, 4, 1, 13), "A", "B", "g1", 1), (D(1), datetime(2024, 4, 1, 19), "A", "B", "g2", 2)], "game_date date, game_datetime timestamp_ntz, away_team string, home_team string, game_id string, dh int")
    rows = [(D(1), datetime(2024, 4, 1, h), "A", "B", b, f"{b}{h}", 120.0, -140.0, 2024) for h, b in ((13, "b1"), (14, "b1"), (18, "b2"), (19, "b2"), (12, "b3"))]
    q = add_market_probabilities(spark.createDataFrame(rows, "game_date date, game_datetime timestamp_ntz, away_team string, home_team string, sportsbook string, quote_id string, away_opening_odds double, home_opening_odds double, season int"))
    _, full = quotes.reconcile(games, q)
    _, slim = quotes.reconcile(games, q, long_columns=["game_id", "sportsbook", "quote_id"])
    assert slim.columns == ["game_id", "sportsbook", "quote_id"] and set(full.columns) >= {"season", "vig_open", "exact", "dh"}
    want = {("g1", "b1", "b113"), ("g2", "b2", "b219"), ("g1", "b3", "b312")}
    assert {tuple(r) for r in slim.collect()} == want == {tuple(r) for r in full.select(slim.columns).collect()}
    kept = next(x for x in slim._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)
    assert "quote_id" in kept and "season" not in kept and "odds" not in kept


def test_nearest_time_reads_the_asked_rows_once_for_their_times(spark):
    seen = spark.sparkContext.accumulator(0)
    from pyspark.sql import functions as F

    @F.udf("string")
    def look(x):
        seen.add(1)
        return x

    rows = [("k", datetime(2024, 4, 1, 1 + i % 20), i) for i in range(40)]
    asked = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int").withColumn("k", look.asNondeterministic()("k"))
    offers = spark.createDataFrame([("k", datetime(2024, 4, 1, 5), 1), ("k", datetime(2024, 4, 1, 15), 2)], "k string, t timestamp_ntz, g int")
    got = {(r["i"], r["g"]) for r in asof.nearest_in_time(asked, offers, ["k"], "t", ["g"], "g").collect()}
    assert got == {(i, 1 if 1 + i % 20 <= 10 else 2) for i in range(40)} and seen.value <= 80
