"""Payloads whose shape is not known beforehand: routed by what they hold, with a table of rejects instead of silent NULLs.

Texts become VARIANT values, so a record keeps what the source sent; fields are read by path, and a value of the wrong type is
told apart from one that is missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tallyline.functions.aliases import TEAM_ALIASES
from tallyline.functions.text import canonical, normalize_name
from tallyline.sources.payloads import BATTER_FIELDS, PITCHER_FIELDS

# Routes of a game log (fixed values: a batter's record has AB, a pitcher's TBF or W and no AB).
GAME_LOG_ROUTES = {"batter": ("AB",), "pitcher": ("TBF", "W")}
GAME_LOG_KEYS = {"playerid": "bigint", "gamedate": "date"}


def path(field: str) -> str:
    return f"$[\"{field}\"]"


def get(record: str, field: str, kind: str) -> str:
    """A field as ``kind``, NULL where it is missing or something else (SQL text)."""
    return f"try_variant_get({record}, '{path(field)}', '{kind}')"


def parsed(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``raw`` with ``doc``; NULL where the text is no JSON."""
    return raw.withColumn("doc", F.try_parse_json(payload))


def shape_report(raw: DataFrame, by: Sequence[str] = (), payload: str = "payload") -> DataFrame:
    """Per group: payloads, those that are no JSON, and the schema that holds all others."""
    return parsed(raw, payload).groupBy(*by).agg(
        F.expr("count(1) AS n"), F.expr(f"count_if(doc IS NULL AND {payload} IS NOT NULL) AS n_malformed"), F.expr("schema_of_variant_agg(doc) AS shape"))


def routed_records(raw: DataFrame, records: str, routes: Mapping[str, Sequence[str]], keys: Mapping[str, str], numbers: Mapping[str, Sequence[str]], skip: int = 0, payload: str = "payload") -> DataFrame:
    """One row per record of the array at path ``records`` after the first ``skip``: ``record``, ``route``, ``reason``.

    A record takes the first route of which it has a field. It is rejected (``route`` NULL, ``reason`` says why) where it has
    none, where a key is missing or of the wrong type, or where one of its route's number fields holds something else. A text
    that is no JSON, or has no such array, is one rejected row without a record.
    """
    docs = parsed(raw, payload).selectExpr("*", f"try_variant_get(doc, '{records}', 'array<variant>') AS __records")
    outer = docs.selectExpr(
        "*", f"explode_outer(CASE WHEN __records IS NULL THEN array(CAST(NULL AS variant)) ELSE slice(__records, {skip + 1}, greatest(size(__records), 1)) END) AS record"
    ).where("__records IS NULL OR record IS NOT NULL")
    has = lambda f: f"try_variant_get(record, '{path(f)}', 'variant') IS NOT NULL"
    route = "CASE " + " ".join(f"WHEN {' OR '.join(has(f) for f in fields)} THEN '{name}'" for name, fields in routes.items()) + " END"
    wrong = [f"CASE WHEN {has(k)} AND {get('record', k, kind)} IS NULL THEN 'bad {k}' WHEN NOT {has(k)} THEN 'no {k}' END" for k, kind in keys.items()]
    for name, fields in numbers.items():
        wrong += [f"CASE WHEN __route = '{name}' AND {has(f)} AND NOT is_variant_null(try_variant_get(record, '{path(f)}', 'variant')) AND {get('record', f, 'double')} IS NULL THEN 'bad {f}' END" for f in fields]
    reason = (
        f"CASE WHEN doc IS NULL THEN 'malformed' WHEN __records IS NULL THEN 'no records' WHEN __route IS NULL THEN 'unknown shape' ELSE coalesce({', '.join(wrong)}) END"
    )
    return outer.selectExpr("*", f"{route} AS __route").selectExpr("*", f"{reason} AS reason").selectExpr(
        *[c for c in raw.columns], "record", "CASE WHEN reason IS NULL THEN __route END AS route", "reason")


def route_game_logs(raw: DataFrame, payload: str = "payload", aliases=TEAM_ALIASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batters, pitchers, rejects) of game logs; the rows of the first two are those of ``flatten_game_logs``.

    The first record of a payload (totals) is skipped. Metrics that are absent take their typed default; metrics that hold
    something other than a number reject the record. Rejects keep the payload's keys, the reason, the record's shape and text.
    """
    numbers = {"batter": [f for f, _ in BATTER_FIELDS.values()], "pitcher": [f for f, _ in PITCHER_FIELDS.values()]}
    rows = routed_records(raw, "$.mlb", GAME_LOG_ROUTES, GAME_LOG_KEYS, numbers, skip=1, payload=payload)
    at = lambda f, kind: F.expr(get("record", f, kind))
    common = [
        at("playerid", "bigint").alias("player_id"), F.col("mlb_id"), at("PlayerName", "string").alias("name"), normalize_name(at("PlayerName", "string")).alias("normalized_player_name"),
        canonical(at("Team", "string"), aliases).alias("team"), at("gamedate", "date").alias("game_date"), at("dh", "int").alias("dh"), F.col("season"),
    ]
    metrics = lambda fields: [F.coalesce(at(f, "double"), F.lit(d)).alias(n) for n, (f, d) in fields.items()]
    batters = rows.where("route = 'batter'").select(
        *common, at("BatOrder", "string").alias("batorder"), at("Pos", "string").alias("pos"), at("AB", "int").alias("ab"), at("PA", "int").alias("pa"), *metrics(BATTER_FIELDS))
    pitchers = rows.where("route = 'pitcher'").select(*common, at("G", "int").alias("games"), at("GS", "int").alias("gs"), *metrics(PITCHER_FIELDS))
    rejects = rows.where("route IS NULL").selectExpr(
        "season", "mlb_id", "reason", "schema_of_variant(record) AS shape", f"CASE WHEN record IS NULL THEN {payload} ELSE to_json(record) END AS text")
    return batters, pitchers, rejects
