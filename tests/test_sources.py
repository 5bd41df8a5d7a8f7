import json

import pytest
from pyspark.sql import functions as F, types as T

from tallyline.functions.text import clean_timestamp_text, normalize_name
from tallyline.schemas import KEYS, SCHEMAS
from tallyline.operators import prepare
from tallyline.sources import payloads, shapes, sinks, tables
from tallyline.sources.align import align_to_schema, schema_changes


def test_every_key_is_a_required_column():
    for name, key in KEYS.items():
        fields = {f.name: f.nullable for f in SCHEMAS[name].fields}
        assert all(not fields[c] for c in key), name


def test_names(spark):
    cases = {
        "José Altuve": "jose altuve", "O'Neill, Tyler": "tyler oneill", "Guerrero Jr., Vladimir": "vladimir guerrero jr",
        "de la Cruz, Elly": "elly de la cruz", "  A.J.   Puk ": "aj puk", "Ken III Griffey": "ken griffey iii", None: "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert df.where(normalize_name("raw") != F.col("want")).collect() == []


def test_timestamps(spark):
    cases = {
        "2021-04-13T18:10:00+00:00": "2021-04-13T18:10:00", "2021-04-13T18:10:00Z": "2021-04-13T18:10:00",
        "2021-04-13 18:10:00": "2021-04-13T18:10:00", "2021-04-13T18:10:00.123": "2021-04-13T18:10:00",
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert df.where(clean_timestamp_text("raw") != F.col("want")).collect() == []


def test_alignment(spark):
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType(), False), T.StructField("s", T.StringType())])
    df = spark.range(1)
    assert align_to_schema(df, target).first().asDict() == {"id": 0, "n": 0, "s": None}
    assert [(r["column_name"], r["default_value"]) for r in schema_changes(df, target).collect()] == [("n", "0"), ("s", None)]


def test_validation_and_snapshot_arguments(spark):
    df = spark.createDataFrame([("2024-04-01", float("inf"))], "game_date string, v double")
    row = tables.validate(df, ["v"]).first()
    assert row["v"] is None and str(row["game_date"]) == "2024-04-01"
    with pytest.raises(ValueError, match="missing"):
        tables.validate(df, ["w"])
    with pytest.raises(ValueError, match="not in season"):
        tables.snapshot_scan(df, 2023, day="2024-04-01")


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", 1, 2023), (2, "b", 1, 2024)], "k int, v string, ver int, season int")
    sinks.upsert_table(first, path, ["k"], ["ver"], "season")
    old = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "season=2023").iterdir()}
    batch = spark.createDataFrame([(2, "c", 2, 2024), (3, "d", 1, 2024)], "k int, v string, ver int, season int")
    for _ in range(2):  # delivered twice
        sinks.upsert_table(batch, path, ["k"], ["ver"], "season")
    rows = {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert rows == {(1, "a"), (2, "c"), (3, "d")}
    assert old == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "season=2023").iterdir()}


def test_cache_builds_once_and_key_has_every_parameter(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    key = sinks.cache_key(halflives=(3, 8))
    assert key != sinks.cache_key(halflives=(3, 9))
    for force in (False, False, True):
        assert sinks.cached(spark, str(tmp_path), key, build, force).count() == 3
    assert len(calls) == 2


def test_schedule_rejects(spark):
    def game(pk, away_wins, home_wins, **more):
        side = lambda n, w: {"team": {"name": n}, "score": 1, "isWinner": w}
        return {
            "gamePk": pk, "gameType": "R", "officialDate": "2024-04-01", "gameDate": "2024-04-01T18:00:00Z", "doubleHeader": "N", "gameNumber": 1,
            "status": {"detailedState": "Final"}, "teams": {"away": side("Mets", away_wins), "home": side("Yankees", home_wins)}, **more,
        }

    doc = {"dates": [{"games": [game(1, True, False), game(2, False, False), game(3, True, False, gameType="S"), game(4, True, False, doubleHeader="?")]}]}
    raw = spark.createDataFrame([(2024, json.dumps(doc))], "season int, payload string")
    good, bad = payloads.flatten_schedule(raw)
    assert [(r["game_id"], r["winning_team"], r["losing_team"], r["venue_elevation"]) for r in good.collect()] == [("1", "NYM", "NYY", 0)]
    assert sorted(r["game_id"] for r in bad.collect()) == ["2", "4"]


def test_a_key_leaves_its_old_partition(spark, tmp_path):
    path = str(tmp_path / "moving")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, season int, ver int")
    sinks.upsert_table(rows((1, 2000, 1), (2, 2001, 1), (3, 2002, 1)), path, ["k"], ["ver"], "season")
    sinks.upsert_table(rows((1, 2001, 2)), path, ["k"], ["ver"], "season")
    got = sorted((r.k, r.season) for r in spark.read.parquet(path).collect())
    assert got == [(1, 2001), (2, 2001), (3, 2002)]
    flat = str(tmp_path / "flat")
    for batch in (rows((1, 1, 1)), rows((1, 2, 2), (2, 2, 2))):
        sinks.upsert_table(batch, flat, ["k"], ["ver"])
    assert sorted((r.k, r.season) for r in spark.read.parquet(flat).collect()) == [(1, 2), (2, 2)]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("flat")] == ["flat"]


def test_accents_of_every_latin_letter(spark):
    from tallyline.functions.text import normalize_name

    names = ["Nguyễn", "Ḥĝǎ", "José Ramírez", "Łuk", "Čech, Ǻsa", "Ḗ"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.x for r in df.select(normalize_name("n").alias("x")).collect()] == ["nguyen", "hga", "jose ramirez", "łuk", "asa cech", "e"]


def test_table_sizes_are_those_of_the_files(spark, tmp_path):
    for name, n in (("a", 3), ("b", 1)):
        spark.range(50).repartition(n).write.parquet(str(tmp_path / name))
    got = {r.table_name: (r.n_files, r.n_bytes) for r in tables.sizes({n: spark.read.parquet(str(tmp_path / n)) for n in ("a", "b")}).collect()}
    own = {n: [f.stat().st_size for f in (tmp_path / n).glob("*.parquet")] for n in ("a", "b")}
    assert got["a"] == (len(own["a"]), sum(own["a"])) and got["b"] == (len(own["b"]), sum(own["b"]))
    assert got[None] == (len(own["a"] + own["b"]), sum(own["a"] + own["b"]))


def game_logs(spark):
    good = {"playerid": 7, "gamedate": "2024-04-01", "PlayerName": "Ann", "Team": "XYZ", "dh": "0"}
    records = [
        {**good, "AB": "3", "wOBA": "0.4", "wRC+": None}, {**good, "TBF": 4, "FIP": 3.5}, {**good, "AB": "3", "BB%": "n/a"}, {**good, "G": 1},
        {"gamedate": "2024-04-01", "AB": 1}, {**good, "gamedate": "soon", "W": 1}, {**good, "AB": 1, "W": 2},
    ]
    texts = [json.dumps({"mlb": [{"playerid": "total"}, *records]}), "{not json", "[]", json.dumps({"mlb": "none"}), json.dumps({"mlb": []}), json.dumps({"mlb": [{"AB": 1}]}), None]
    return spark.createDataFrame([(2024, i, t) for i, t in enumerate(texts)], "season int, mlb_id long, payload string")


def test_records_are_routed_or_rejected_with_a_reason(spark):
    raw = game_logs(spark)
    batters, pitchers, rejects = shapes.route_game_logs(raw)
    assert [(r.player_id, r.ab, r.woba, r.wrc_plus) for r in batters.orderBy("ab").collect()] == [(7, 1, 0.0, 100.0), (7, 3, 0.4, 100.0)]
    assert [(r.player_id, r.fip, r.stuff) for r in pitchers.collect()] == [(7, 3.5, 100.0)]
    got = sorted((r.mlb_id, r.reason) for r in rejects.collect())
    assert got == sorted([(0, "bad BB%"), (0, "unknown shape"), (0, "no playerid"), (0, "bad gamedate"), (1, "malformed"), (2, "no records"), (3, "no records"), (6, "malformed")])
    assert "OBJECT" in rejects.where("reason = 'bad BB%'").first().shape and "n/a" in rejects.where("reason = 'bad BB%'").first().text


def test_routed_rows_are_those_of_the_flat_reader(spark):
    raw = game_logs(spark).where("mlb_id = 0").selectExpr("season", "mlb_id", """replace(payload, '"n/a"', '0.1') AS payload""")
    for new, old in zip(shapes.route_game_logs(raw), payloads.flatten_game_logs(raw)):
        old = old.where("player_id IS NOT NULL AND game_date IS NOT NULL")
        assert sorted(map(str, new.collect())) == sorted(map(str, old.collect()))


def test_shape_report(spark):
    raw = spark.createDataFrame([("a", '{"x": 1}'), ("a", '{"x": "t", "y": [1]}'), ("a", "{"), ("b", None)], "k string, payload string")
    got = {r.k: (r.n, r.n_malformed, r["shape"]) for r in shapes.shape_report(raw, ["k"]).collect()}
    assert got["a"][:2] == (3, 1) and "y: ARRAY<BIGINT>" in got["a"][2] and got["b"][:2] == (1, 0)


def test_cache_notices_changed_inputs(spark, tmp_path):
    table, builds = str(tmp_path / "t"), []
    spark.range(5).write.parquet(table)

    def build():
        builds.append(1)
        return spark.read.parquet(table).selectExpr("sum(id) AS s")

    read = lambda **p: sinks.cached_from(spark, str(tmp_path / "cache"), [spark.read.parquet(table)], build, **p).first().s
    assert [read(v=1), read(v=1), len(builds)] == [10, 10, 1]
    assert [read(v=2), len(builds)] == [10, 2]
    spark.range(5, 7).write.mode("append").parquet(table)
    assert [read(v=1), read(v=1), len(builds)] == [21, 21, 3]
    spark.range(1).write.mode("overwrite").parquet(table)
    assert read(v=1) == 0


def test_audits_come_with_the_write(spark, tmp_path):
    rows = [("train", 0.5, 1), ("train", None, 1), ("test", 1.5, None), ("test", float("nan"), 2), ("val", float("inf"), 2)]
    df = spark.createDataFrame(rows, "split string, p double, a int").repartition(3)
    audits = prepare.audit_texts(["p", "a"], "p", ["train", "test", "val"])
    stored, seen = sinks.write_audited(df, str(tmp_path / "t"), audits)
    assert stored.count() == 5 and seen["train__n_rows"] == 2 and seen["train__n_null_rows"] == 1
    alone = {r.split: r for r in prepare.probability_audit(df, "p").collect()}
    assert all(seen[f"{s}__{n}"] == alone[s][n] for s in alone for n in ("n_out_of_range", "n_not_finite"))
