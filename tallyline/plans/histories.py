"""Queries of family E: windows over entity histories, and the team blocks."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tallyline.functions.numeric import ratio
from tallyline.operators import history, metrics, reserve, sides, teams
from tallyline.operators.evaluate import stability_score
from tallyline.operators.history import Metric
from tallyline.operators.prepare import order_violations
from tallyline.operators.priors import league_priors
from tallyline.plans.registry import query, r, tidy
from tallyline.session import scratch_path
from tallyline.streaming.histories import HistoryFeed

PLAYER_ORDER = ("game_date", "dh")
LOG_ORDER = ("game_date", "l_orderkey", "l_linenumber")


def sql_rolling(view, entity, order, ms, hs, keep, prior, extra="", where=""):
    """Rolling block in SQL: running sums and lists folded by the recursive definition.

    ``prior`` is a SQL expression per metric name, or a dict of them.
    """
    weights = sorted({m.weight for m in ms})
    num = {m.name: f"coalesce({m.value}, 0.0) * coalesce({m.weight}, 0)" if m.rate else f"coalesce({m.value}, 0.0)" for m in ms}
    cols = []
    for w in weights:
        cols += [f"sum(CAST(coalesce({w}, 0) AS DOUBLE)) OVER p AS w_{w}", f"list(CAST(coalesce({w}, 0) AS DOUBLE)) OVER p AS lw_{w}"]
    for n, e in num.items():
        cols += [f"sum(CAST({e} AS DOUBLE)) OVER p AS n_{n}", f"list(CAST({e} AS DOUBLE)) OVER p AS ln_{n}"]
    out = []

    def fold(l, h):
        a = 0.5 ** (1.0 / h)
        return f"list_reduce({l}, lambda e, x: {a!r} * e + {1 - a!r} * x)"

    for m in ms:
        pr = prior[m.name] if isinstance(prior, dict) else prior.format(m=m.name)
        n = f"coalesce(w_{m.weight}, 0)"

        def shrunk(x):
            return f"CASE WHEN {n} > 0 THEN {n} / ({n} + {m.k}) * ({x}) + {m.k} / ({n} + {m.k}) * ({pr}) ELSE {pr} END"

        out.append(f"{r(shrunk(f'n_{m.name} / nullif(w_{m.weight}, 0)'))} AS {m.name}_season")
        for h in hs:
            rate = f"{fold(f'ln_{m.name}', h)} / nullif({fold(f'lw_{m.weight}', h)}, 0)"
            out.append(f"{r(shrunk(rate))} AS {m.name}_ewm_h{h}")
    return (
        f"SELECT {keep}, {', '.join(out)}{extra} FROM (SELECT *, {', '.join(cols)}, row_number() OVER p0 - 1 AS seq FROM {view} src {where}"
        f" WINDOW p AS (PARTITION BY {entity} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),"
        f" p0 AS (PARTITION BY {entity} ORDER BY {order})) st"
    )


@query(
    "e1_running_sum",
    """SELECT entity, game_date, l_orderkey, l_linenumber, sum(value) OVER (PARTITION BY entity ORDER BY game_date, l_orderkey, l_linenumber
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total FROM @supplier_log s""",
)
def e1(v):
    out = history.running_state(v.supplier_log, ["entity"], LOG_ORDER, sums={"total": "value"})
    return out.select("entity", "game_date", "l_orderkey", "l_linenumber", "total")


@query(
    "e2_expanding_mean",
    f"""SELECT entity, game_date, l_orderkey, l_linenumber, {r('a / nullif(w, 0)')} AS season_rate, w AS n FROM (
         SELECT *, sum(value * weight) OVER p AS a, CAST(sum(weight) OVER p AS DOUBLE) AS w FROM @supplier_log s
         WINDOW p AS (PARTITION BY entity ORDER BY game_date, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x""",
)
def e2(v):
    out = history.running_state(v.supplier_log, ["entity"], LOG_ORDER, sums={"a": "value * weight", "n": "weight"})
    return tidy(out.select("entity", "game_date", "l_orderkey", "l_linenumber", ratio(F.col("a"), F.col("n")).alias("season_rate"), "n"), skip=("n",))


_A3 = 0.5 ** (1 / 3)


@query(
    "e3_ewm_rate",
    f"""SELECT entity, game_date, l_orderkey, l_linenumber,
          {r(f"list_reduce(a, lambda e, x: {_A3!r} * e + {1 - _A3!r} * x) / nullif(list_reduce(w, lambda e, x: {_A3!r} * e + {1 - _A3!r} * x), 0)")} AS ewm_h3
        FROM (SELECT *, list(value * weight) OVER p AS a, list(CAST(weight AS DOUBLE)) OVER p AS w FROM @supplier_log s
         WINDOW p AS (PARTITION BY entity ORDER BY game_date, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x""",
)
def e3(v):
    out = history.running_state(v.supplier_log, ["entity"], LOG_ORDER, ewms={"a": ("value * weight", 3), "w": ("weight", 3)})
    return tidy(out.select("entity", "game_date", "l_orderkey", "l_linenumber", ratio(F.col("a"), F.col("w")).alias("ewm_h3")))


_GAP = 0.5 ** (1 / 0.65)


@query(
    "e3_long_gap",
    f"""SELECT entity, game_date, l_orderkey, l_linenumber,
          {r(f"list_reduce(a, lambda e, x: {_GAP!r} * e + {1 - _GAP!r} * x) / nullif(list_reduce(w, lambda e, x: {_GAP!r} * e + {1 - _GAP!r} * x), 0)")} AS ewm_gap
        FROM (SELECT *, list(value * early) OVER p AS a, list(early) OVER p AS w FROM (
          SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY game_date, l_orderkey, l_linenumber) <= 10 THEN CAST(weight AS DOUBLE) ELSE 0.0 END AS early
          FROM @supplier_log s) t
         WINDOW p AS (PARTITION BY entity ORDER BY game_date, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x""",
)
def e3_long_gap(v):
    """Weight on the first rows only: numerator and weight fade together, the rate stays."""
    early = "if(row_number() OVER (PARTITION BY entity ORDER BY game_date, l_orderkey, l_linenumber) <= 10, cast(weight AS double), 0D)"
    log = v.supplier_log.selectExpr("*", f"{early} AS early")
    out = history.running_state(log, ["entity"], LOG_ORDER, ewms={"a": ("value * early", 0.65), "w": ("early", 0.65)})
    return tidy(out.select("entity", "game_date", "l_orderkey", "l_linenumber", ratio(F.col("a"), F.col("w")).alias("ewm_gap")))


@query(
    "e4_shrinkage",
    f"""SELECT player_id, game_date, dh, {r("CASE WHEN coalesce(bip, 0) > 0 THEN bip / (bip + 70.0) * woba + 70.0 / (bip + 70.0) * 25.0 ELSE 25.0 END")} AS shrunk
        FROM @player_game p""",
)
def e4(v):
    return tidy(v.player_game.select("player_id", "game_date", "dh", F.expr(history.shrink("bip", 70.0, "woba", "25.0D")).alias("shrunk")))


_LOG_METRICS = (Metric("value", "value", "weight", 50), Metric("total", "value", "weight", 20, rate=False))


_E5 = sql_rolling("@supplier_log", "entity", "game_date, l_orderkey, l_linenumber", _LOG_METRICS, (4, 12), "entity, game_date, l_orderkey, l_linenumber, seq", "25.5",
                extra=", last_app_date").replace("row_number() OVER p0 - 1 AS seq", "row_number() OVER p0 - 1 AS seq, lag(game_date) OVER p0 AS last_app_date")


@query("e5_rolling_block", _E5)
def e5(v):
    log = v.supplier_log.select("*", F.lit(25.5).alias("prior_value"), F.lit(25.5).alias("prior_total"))
    return tidy(history.rolling_rates(log, ["entity"], LOG_ORDER, _LOG_METRICS, (4, 12), keep=["entity", "game_date", "l_orderkey", "l_linenumber"]))


@query("e5_incremental_block", _E5)
def e5_incremental(v):
    """The years arrive one after the other; the rows are those of one pass over everything."""
    log = v.supplier_log.select("*", F.lit(25.5).alias("prior_value"), F.lit(25.5).alias("prior_total"))
    sums, ewms = history.rate_state(_LOG_METRICS, (4, 12))
    feed = HistoryFeed(v.spark, scratch_path(v.spark, "feed"), ["entity"], LOG_ORDER, sums=sums, ewms=ewms, latest={"last_app_date": "game_date"})
    # the log as it is delivered: one folder per year, each read for its own batch alone
    delivered = scratch_path(v.spark, "delivered")
    log.withColumn("year", F.year("game_date")).write.partitionBy("year").parquet(delivered)
    arrived = v.spark.read.schema(T.StructType([*log.schema.fields, T.StructField("year", T.IntegerType())])).parquet(delivered)
    first, last = arrived.agg(F.min("year"), F.max("year")).first()
    for number, year in enumerate(range(first, last + 1)):
        feed.ingest(arrived.where(F.col("year") == year).drop("year"), number)
    return tidy(feed.rows().selectExpr("entity", "game_date", "l_orderkey", "l_linenumber", "seq", *history.rates_of(_LOG_METRICS, (4, 12)), "last_app_date"))


@query(
    "e6_previous_appearance",
    "SELECT player_id, game_date, dh, lag(game_date) OVER (PARTITION BY player_id, season ORDER BY game_date, dh) AS last_app_date FROM @player_game p",
)
def e6(v):
    out = history.running_state(v.player_game, ["player_id", "season"], PLAYER_ORDER, latest={"last_app_date": "game_date"})
    return out.select("player_id", "game_date", "dh", "last_app_date")


@query(
    "e7_games_played",
    "SELECT game_id, team, row_number() OVER (PARTITION BY season, team ORDER BY game_date, dh, game_datetime, game_id) - 1 AS team_gp FROM @team_log t",
)
def e7(v):
    out = history.running_state(sides.team_rows(v.games), ["season", "team"], teams.ORDER)
    return out.select("game_id", "team", F.col("seq").alias("team_gp"))


_TEAM_LOG = """(SELECT *, 1 AS gp, team_score - opposing_team_score AS run_diff,
    CASE WHEN abs(team_score - opposing_team_score) = 1 THEN 1 ELSE 0 END AS one_run_game,
    CASE WHEN abs(team_score - opposing_team_score) = 1 AND is_winner = 1 THEN 1 ELSE 0 END AS one_run_win FROM @team_log tl)"""


def _team_sql(ms, hs, keep="game_id, team"):
    """Team log with its season priors, then the rolling block."""
    pri = ", ".join(
        f"(sum({m.value} * {m.weight}) OVER (PARTITION BY season)) / CAST(nullif(sum({m.weight}) OVER (PARTITION BY season), 0) AS DOUBLE) AS prior_{m.name}" for m in ms
    )
    view = f"(SELECT *, {pri} FROM {_TEAM_LOG} z)"
    return sql_rolling(view, "season, team", "game_date, dh, game_datetime, game_id", ms, hs, keep, "prior_{m}")


def _form(v, ms, **kw):
    return teams.team_form(sides.team_rows(v.games), ms, pythagorean=False, **kw)


@query("e8_win_pct", _team_sql((teams.WIN,), (3, 8, 20)))
def e8(v):
    return tidy(_form(v, (teams.WIN,), keep=("game_id", "team")).drop("team_gp"))


@query("e9_run_differential", _team_sql((teams.RUNS,), (3, 8, 20)))
def e9(v):
    return tidy(_form(v, (teams.RUNS,), keep=("game_id", "team")).drop("team_gp"))


def _pyth_sql():
    def fold(l, h):
        a = 0.5 ** (1.0 / h)
        return f"list_reduce({l}, lambda e, x: {a!r} * e + {1 - a!r} * x)"

    def ex(s, a):
        return f"coalesce(pow({s} + alpha, 1.83) / (pow({s} + alpha, 1.83) + pow({a} + alpha, 1.83)), 0.5)"

    cols = [f"{r(ex('rs', 'ra'))} AS pyth_expectation_season"]
    cols += [f"{r(ex(fold('lrs', h), fold('lra', h)))} AS pyth_expectation_ewm_h{h}" for h in (3, 8, 20)]
    return f"""SELECT game_id, team, {', '.join(cols)} FROM (
      SELECT *, sum(team_score) OVER p AS rs, sum(opposing_team_score) OVER p AS ra, list(CAST(team_score AS DOUBLE)) OVER p AS lrs,
        list(CAST(opposing_team_score AS DOUBLE)) OVER p AS lra, 10 * avg(team_score) OVER (PARTITION BY season) AS alpha FROM @team_log t
      WINDOW p AS (PARTITION BY season, team ORDER BY game_date, dh, game_datetime, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x"""


@query("e10_pythagorean", _pyth_sql())
def e10(v):
    out = teams.team_form(sides.team_rows(v.games), (), keep=("game_id", "team"))
    return tidy(out.select("game_id", "team", *[c for c in out.columns if c.startswith("pyth")]))


@query("e11_one_run_win_pct", _team_sql((teams.ONE_RUN,), (3, 8, 20)))
def e11(v):
    return tidy(_form(v, (teams.ONE_RUN,), keep=("game_id", "team")).drop("team_gp"))


@query(
    "e12_head_to_head",
    sql_rolling(
        f"(SELECT *, (sum(is_winner) OVER (PARTITION BY season)) / CAST(count(*) OVER (PARTITION BY season) AS DOUBLE) AS prior_h2h_win_pct FROM {_TEAM_LOG} z)",
        "season, team, opposing_team", "game_date, dh, game_datetime, game_id", (teams.HEAD_TO_HEAD,), (), "game_id, team", "prior_{m}",
    ),
)
def e12(v):
    return tidy(_form(v, (teams.HEAD_TO_HEAD,), halflives=(), entity=("season", "team", "opposing_team"), keep=("game_id", "team")).drop("team_gp"))


def _season_prior_sql(view, ms):
    pri = ", ".join(
        f"(sum(coalesce({m.value}, 0.0) * {m.weight}) OVER (PARTITION BY season)) / nullif(CAST(sum({m.weight}) OVER (PARTITION BY season) AS DOUBLE), 0) AS prior_{m.name}"
        for m in ms
    )
    return f"(SELECT *, {pri} FROM {view} z)"


def _player_block(v, log, ms, hs, season="season"):
    priors = F.broadcast(league_priors(log, ms, [season]))  # one row per season
    return history.rolling_rates(log.join(priors, season), ["player_id", season], PLAYER_ORDER, ms, hs, keep=["player_id", "game_date", "dh"])


def _block_sql(view, ms, hs):
    text = sql_rolling(_season_prior_sql(view, ms), "player_id, season", "game_date, dh", ms, hs, "player_id, game_date, dh, seq", "prior_{m}", extra=", last_app_date")
    return text.replace("row_number() OVER p0 - 1 AS seq", "row_number() OVER p0 - 1 AS seq, lag(game_date) OVER p0 AS last_app_date")


@query("e13_batting_block", _block_sql("@position_log", metrics.BATTING, metrics.BATTER_HALFLIVES))
def e13(v):
    return tidy(_player_block(v, v.position_log, metrics.BATTING, metrics.BATTER_HALFLIVES))


_REL = "(SELECT * FROM @player_game pg WHERE gs = 0)"
_STA = "(SELECT * FROM @player_game pg WHERE gs = 1)"


@query("e14_reliever_block", _block_sql(_REL, metrics.RELIEVER, metrics.RELIEVER_HALFLIVES))
def e14(v):
    return tidy(_player_block(v, v.player_game.where("gs = 0"), metrics.RELIEVER, metrics.RELIEVER_HALFLIVES))


@query("e15_starter_block", _block_sql(_STA, metrics.STARTER, metrics.STARTER_HALFLIVES))
def e15(v):
    return tidy(_player_block(v, v.player_game.where("gs = 1"), metrics.STARTER, metrics.STARTER_HALFLIVES))


def _velo_sql():
    def fold(l, h):
        a = 0.5 ** (1.0 / h)
        return f"list_reduce({l}, lambda e, x: {a!r} * e + {1 - a!r} * x)"

    s2, s6 = (f"{fold('lt', h)} / nullif({fold('lu', h)}, 0)" for h in (2, 6))
    return f"""SELECT player_id, game_date, dh, {r('coalesce(t / nullif(u, 0), mean)')} AS velo_season, {r(f'coalesce({s2}, mean)')} AS velo_short,
       {r(f'coalesce({s6}, mean)')} AS velo_long, {r(f'coalesce({s2} - {s6}, 0)')} AS velo_diff FROM (
      SELECT *, sum(vs) OVER p AS t, sum(us) OVER p AS u, list(vs) OVER p AS lt, list(us) OVER p AS lu,
        avg(vs / nullif(us, 0)) OVER () AS mean FROM (
        SELECT *, fa_velo * fa_percent + fc_velo * fc_percent + si_velo * si_percent AS vs, fa_percent + fc_percent + si_percent AS us FROM @player_game pg WHERE gs = 1) z
      WINDOW p AS (PARTITION BY player_id, season ORDER BY game_date, dh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x"""


@query("e16_velocity_trend", _velo_sql())
def e16(v):
    log = v.player_game.where("gs = 1")
    total, usage = reserve.velocity_columns()
    state = history.running_state(
        log, ["player_id", "season"], PLAYER_ORDER,
        sums={"__velo": total, "__usage": usage},
        ewms={f"__{n}_{h}": (c, h) for n, c in (("velo", total), ("usage", usage)) for h in (2, 6)},
    )
    speed = F.expr(f"try_divide({total}, {usage})")
    mean = log.agg(F.avg(F.when(speed > 0, speed))).scalar()
    out = reserve.velocity_trend(state, mean)
    return tidy(out.select("player_id", "game_date", "dh", "velo_season", "velo_short", "velo_long", "velo_diff"))


@query(
    "e17_stability_score",
    f"""WITH a AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n,
        avg(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM @run_log r
        WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
      b AS (SELECT run_id, max(n) AS n, min(CASE WHEN i >= least(n, 5) - 1 THEN m END) AS bm, max(CASE WHEN i = n - 1 THEN m END) AS tm,
        min(val_loss) AS best, arg_min(i, struct_pack(a := val_loss, b := i)) AS be FROM a GROUP BY run_id)
      SELECT run_id, n AS epochs, be AS best_epoch, {r('bm + 0.25 * greatest(0, tm - best) + 0.02 * greatest(0, (floor(n * 0.15) - be) / n)')} AS stability FROM b""",
)
def e17(v):
    return tidy(stability_score(v.run_log))


@query(
    "e18_order_contract",
    "SELECT split, season, min(game_date) AS first, max(game_date) AS last, CAST(0 AS BIGINT) AS falls FROM @pred_wide p GROUP BY split, season",
)
def e18(v):
    return tidy(order_violations(v.pred_wide))


# ---- the flagship: team form per game -----------------------------------------------------

_FORM = [m for m in (teams.WIN, teams.RUNS, teams.ONE_RUN)]


def team_form_per_game(v):
    return teams.game_form(teams.team_form(sides.team_rows(v.games)))


def _flagship_sql():
    block = _team_sql(_FORM, (3, 8, 20), "game_id, game_date, dh, season, team, is_home, seq AS team_gp")
    pyth = _pyth_sql()
    cols = [c for c in teams.form_columns()] + ["team_gp"]
    side = ", ".join(f"max(CASE WHEN is_home = {f} THEN {c} END) AS {s}_{c}" for s, f in (("home", 1), ("away", 0)) for c in ["team", *cols])
    return f"""SELECT game_id, game_date, dh, season, {side} FROM (SELECT a.*, b.* EXCLUDE (game_id, team) FROM ({block}) a
      JOIN ({pyth}) b ON a.game_id = b.game_id AND a.team = b.team) x GROUP BY game_id, game_date, dh, season"""


@query("e_team_form_per_game", _flagship_sql())
def flagship(v):
    """Unpivot to team rows, one window pass for all team blocks, back to one row per game."""
    return tidy(team_form_per_game(v).drop("game_datetime"))
