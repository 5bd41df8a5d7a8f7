"""Strictly-earlier history of an entity: running sums, running EWM, running maximum.

Every value on a row is computed from the rows *before* it in the entity's order.

Three physical shapes, chosen from one cheap count per entity (two columns are read):

* short histories: one exchange, one sort, one window spec;
* long histories: the EWM is taken in blocks of ``400 * halflife`` rows, because its closed
  form ``r^k * sum(c * x * r^-i)`` overflows over longer runs. The ends of all earlier blocks
  that a double can still hold (FULL_DECAY half-lives back) are carried over, so a rate whose
  numerator and weight have faded together is kept, whatever the length of the history;
* hot entities: an entity with more rows than ``segment_rows`` is cut into stretches of its
  clock (a day by default), each with a bounded number of rows, so that no task gets the
  entity as a whole. The stretches' totals (at most one row per clock tick) are carried forward
  and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

BLOCK_FACTOR = 400
FULL_DECAY = 1100  # halvings after which a double has decayed to zero
# a window holds a stretch's rows once per half-life and kind of state, some 30 KB a row for a whole team block
MIN_SEGMENT_ROWS = 25_000
# Rows of one task: adaptive execution goes by compressed bytes, and a task's sorts hold every row several times and widened.
TASK_ROWS = 100_000
# segment_rows = rows / MAX_HOT, so at most MAX_HOT entities can be hot: the broadcast bound
MAX_HOT = 20_000

# Expressions are SQL text: a block has a hundred columns, and one parsed text per column
# costs the driver far less than a dozen Column calls each.
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@dataclass(frozen=True)
class HistorySize:
    rows: int
    longest: int

    @property
    def segment_rows(self) -> int:
        return max(MIN_SEGMENT_ROWS, self.rows // MAX_HOT)


def measure(df: DataFrame, entity: Sequence[str]) -> HistorySize:
    """Row count and longest history: one map-side combined count, one row to the driver."""
    row = df.groupBy(*entity).count().agg(F.sum("count"), F.max("count")).first()
    return HistorySize(row[0] or 0, row[1] or 0)


def dealt(df: DataFrame, keys: Sequence[str], size: HistorySize) -> DataFrame:
    """The exchange of a large table's windows with a number of tasks that follows its rows."""
    tasks = -(-size.rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def zero(text: str) -> str:
    return f"coalesce(cast({text} as double), 0D)"


def over(entity: Sequence[str], order: Sequence[str], frame: str = EARLIER) -> str:
    keys = ", ".join(f"`{e}`" for e in entity)
    return f"OVER (PARTITION BY {keys} ORDER BY {', '.join(order)} {frame})"


def hot_entities(df: DataFrame, entity, clock: str, segment_rows: int) -> DataFrame:
    """Entities over ``segment_rows`` with the stretch width that keeps a stretch under it."""
    ticks = df.groupBy(*entity, F.expr(clock).alias("__tick")).agg(F.expr("count(1) AS n"))
    return (
        ticks.groupBy(*entity)
        .agg(
            F.expr("sum(n) AS __rows"),
            F.expr(f"greatest(1L, cast(floor({segment_rows} / max(n)) as bigint)) AS __width"),
            F.expr("min(__tick) AS __first"),
        )
        .where(f"__rows > {segment_rows}")
        .drop("__rows")
    )


def ewm_factors(halflife: float) -> tuple[float, float]:
    r = 0.5 ** (1.0 / halflife)
    return r, 1.0 - r


def running_state(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, str] | None = None,
    ewms: Mapping[str, tuple[str, float]] | None = None,
    latest: Mapping[str, str] | None = None,
    clock: str = "game_date",
    size: HistorySize | None = None,
    block_factor: int = BLOCK_FACTOR,
    segment_rows: int | None = None,
) -> DataFrame:
    """Add ``seq`` (0-based position) and the named state of the earlier rows.

    ``sums``: running totals, NULL on the first row. ``ewms``: recursive EWM
    (first value seeds, alpha = 1 - 0.5^(1/h)). ``latest``: running maximum.
    Values, order and clock are SQL text. ``order`` must be total within an entity and start
    with a key that the clock never falls along.
    """
    sums, ewms, latest = dict(sums or {}), dict(ewms or {}), dict(latest or {})
    size = size or measure(df, entity)
    segment_rows = segment_rows or size.segment_rows
    block_limit = min((int(block_factor * h) for _, h in ewms.values()), default=segment_rows)
    # one input column per distinct expression
    texts = list(dict.fromkeys([*(zero(t) for t in sums.values()), *(zero(t) for t, _ in ewms.values())]))
    column = {t: f"__v{i}" for i, t in enumerate(texts)}
    base = df.selectExpr(
        "*",
        *[f"{t} AS {c}" for t, c in column.items()],
        *[f"{t} AS __d_{n}" for n, t in latest.items()],
    )
    x = {n: column[zero(t)] for n, t in sums.items()}
    e = {n: (column[zero(t)], h) for n, (t, h) in ewms.items()}
    if size.longest <= min(block_limit, segment_rows):
        out = _direct(dealt(base, entity, size), entity, order, x, e, latest)
    else:
        out = _segmented(
            base, entity, order, x, e, latest, as_clock(df, clock),
            block_factor, segment_rows, size,
        )
    return out.select(*df.columns, "seq", *sums, *ewms, *latest)


def as_clock(df: DataFrame, clock: str) -> str:
    """A whole number that never falls along the order."""
    if dict(df.dtypes).get(clock) == "date":
        return f"cast(unix_date({clock}) as bigint)"
    return f"cast({clock} as bigint)"


def _g(h) -> str:
    return "__g_" + str(h).replace(".", "_")


def _direct(base, entity, order, sums, ewms, latest):
    earlier = over(entity, order)
    halflives = sorted({h for _, h in ewms.values()})
    base = base.selectExpr("*", f"cast(row_number() {over(entity, order, '')} - 1 as bigint) AS seq")
    base = base.selectExpr("*", *[f"pow(2D, seq / {h}D) AS {_g(h)}" for h in halflives])
    cols = [f"sum({c}) {earlier} AS {n}" for n, c in sums.items()]
    for n, (c, h) in ewms.items():
        r, alpha = ewm_factors(h)
        weighted = f"if(seq = 0, 1D, {alpha!r}D) * {c} * {_g(h)}"
        cols.append(f"(sum({weighted}) {earlier}) / {_g(h)} / {r!r}D AS {n}")
    cols += [f"max(__d_{n}) {earlier} AS {n}" for n in latest]
    return base.selectExpr("*", *cols)


def _segmented(base, entity, order, sums, ewms, latest, clock, block_factor, segment_rows, size):
    has_hot = size.longest > segment_rows
    base = base.selectExpr("*", f"{clock} AS __clock")
    if has_hot:
        hot = hot_entities(base, entity, "__clock", segment_rows)
        base = base.join(F.broadcast(hot), list(entity), "left")
        base = base.selectExpr("*", "cast(coalesce(floor((__clock - __first) / __width), 0) as bigint) AS __seg")
    else:
        base = base.selectExpr("*", "0L AS __seg")
    part = [*entity, "__seg"]
    base = dealt(base, part, size)
    earlier = over(part, order)
    base = base.selectExpr("*", f"cast(row_number() {over(part, order, '')} - 1 as bigint) AS __j")
    base = base.selectExpr(
        "*",
        *[f"coalesce(sum({c}) {earlier}, 0D) AS __t_{n}" for n, c in sums.items()],
        *[f"max(__d_{n}) {earlier} AS __l_{n}" for n in latest],
    )
    for h in sorted({h for _, h in ewms.values()}):
        r, alpha = ewm_factors(h)
        rows = int(block_factor * h)
        named = {n: c for n, (c, hh) in ewms.items() if hh == h}
        base = base.selectExpr(
            "*",
            f"floor(__j / {rows}) AS __blk",
            f"pow(2D, (__j % {rows}) / {h}D) AS __g",
            f"if(__j = 0 AND __seg = 0, 1D, {alpha!r}D) AS __c",
        )
        in_block = over([*part, "__blk"], ["__j"])
        base = base.selectExpr(
            "*", *[f"coalesce(sum(__c * {c} * __g) {in_block}, 0D) / __g / {r!r}D AS __b_{n}" for n, c in named.items()]
        )
        tail = f"CASE WHEN __j % {rows} = {rows - 1} THEN __b_{{n}} * {r!r}D + __c * {{c}} END"

        def carried(n: str, c: str) -> str:
            ends = []
            for back in range(1, int(FULL_DECAY * h / rows) + 2):
                frame = over(part, ["__blk"], f"RANGE BETWEEN {back} PRECEDING AND {back} PRECEDING")
                ends.append(f"coalesce(sum({tail.format(n=n, c=c)}) {frame}, 0D) * pow(2D, {-(back - 1) * rows / h!r}D)")
            return " + ".join(ends)

        base = base.selectExpr("*", *[f"__b_{n} + ({carried(n, c)}) / __g AS __e_{n}" for n, c in named.items()])
        if has_hot:
            base = base.selectExpr("*", *[f"__e_{n} * {r!r}D + __c * {c} AS __a_{n}" for n, c in named.items()])
        base = base.drop("__blk", "__c", "__g", *[f"__b_{n}" for n in named])
    if not has_hot:
        return base.selectExpr(
            "*",
            "__j AS seq",
            *[f"if(__j > 0, __t_{n}, NULL) AS {n}" for n in sums],
            *[f"if(__j > 0, __e_{n}, NULL) AS {n}" for n in ewms],
            *[f"__l_{n} AS {n}" for n in latest],
        )
    base = base.join(_carry(base, entity, sums, ewms, latest), part, "left")
    seq = "(__j + coalesce(__n0, 0L))"
    return base.selectExpr(
        "*",
        f"{seq} AS seq",
        *[f"if({seq} > 0, __t_{n} + coalesce(__t0_{n}, 0D), NULL) AS {n}" for n in sums],
        *[
            f"if({seq} > 0, __e_{n} + coalesce(__e0_{n}, 0D) * pow(2D, -__j / {h}D), NULL) AS {n}"
            for n, (_, h) in ewms.items()
        ],
        *[f"greatest(__l_{n}, __l0_{n}) AS {n}" for n in latest],
    )


def _carry(base, entity, sums, ewms, latest):
    """State at the start of each stretch of the hot entities (at most one row per tick)."""
    ends = (
        base.where("__width IS NOT NULL")
        .groupBy(*entity, "__seg")
        .agg(
            F.expr("count(1) AS __n"),
            *[F.expr(f"sum({c}) AS __ts_{n}") for n, c in sums.items()],
            *[F.expr(f"max(__d_{n}) AS __ls_{n}") for n in latest],
            *[F.expr(f"max_by(__a_{n}, __j) AS __a_{n}") for n in ewms],
        )
    )
    ends = ends.selectExpr("*", f"sum(__n) {over(entity, ['__seg'], 'ROWS UNBOUNDED PRECEDING')} AS __end")
    if ewms:
        # a stretch further back than FULL_DECAY half-lives has faded to zero
        reach = int(FULL_DECAY * max(h for _, h in ewms.values()))
        near = over(entity, ["__end"], f"RANGE BETWEEN {reach} PRECEDING AND CURRENT ROW")
        item = ", ".join(["__end AS at", *[f"__a_{n} AS {n}" for n in ewms]])
        ends = ends.selectExpr("*", f"collect_list(struct({item})) {near} AS __near")
        ends = ends.selectExpr(
            "*",
            *[
                f"aggregate(__near, 0D, (acc, s) -> acc + s.{n} * pow(2D, (s.at - __end) / {h}D)) AS __y_{n}"
                for n, (_, h) in ewms.items()
            ],
        )
    before = over(entity, ["__seg"])
    return ends.selectExpr(
        *entity,
        "__seg",
        "__end - __n AS __n0",
        *[f"sum(__ts_{n}) {before} AS __t0_{n}" for n in sums],
        *[f"lag(__y_{n}) {over(entity, ['__seg'], '')} AS __e0_{n}" for n in ewms],
        *[f"max(__ls_{n}) {before} AS __l0_{n}" for n in latest],
    )


# ---- rates ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Metric:
    """``rate``: value is weight-averaged; otherwise the value total is divided by the weight."""

    name: str
    value: str
    weight: str
    k: float
    rate: bool = True

    def numerator(self) -> str:
        v = zero(self.value)
        return f"{v} * {zero(self.weight)}" if self.rate else v


def shrink(n: str, k: float, value: str, prior: str) -> str:
    """N/(N+k) * value + k/(N+k) * prior; the prior alone while N is 0 or NULL (SQL text)."""
    k = f"{float(k)!r}D"
    return f"CASE WHEN {n} > 0 THEN {n} / ({n} + {k}) * ({value}) + {k} / ({n} + {k}) * {prior} ELSE {prior} END"


def rate_state(metrics: Sequence[Metric], halflives: Sequence[float]) -> tuple[dict[str, str], dict[str, tuple[str, float]]]:
    """The running sums and EWMs that rates are made of; weight totals once per weight column, not once per metric."""
    weights = sorted({m.weight for m in metrics})
    sums = {f"__n_{m.name}": m.numerator() for m in metrics} | {f"__w_{x}": x for x in weights}
    ewms = {f"__n_{m.name}_{h}": (m.numerator(), h) for m in metrics for h in halflives}
    ewms |= {f"__w_{x}_{h}": (x, h) for x in weights for h in halflives}
    return sums, ewms


def rates_of(metrics: Sequence[Metric], halflives: Sequence[float], prior_prefix: str = "prior_") -> list[str]:
    """``{m}_season`` and ``{m}_ewm_h{h}`` from the columns of ``rate_state``, shrunk to the row's prior (SQL text)."""
    out = []
    for m in metrics:
        n, prior = f"__w_{m.weight}", prior_prefix + m.name
        out.append(f"{shrink(n, m.k, f'try_divide(__n_{m.name}, {n})', prior)} AS {m.name}_season")
        for h in halflives:
            rate = f"try_divide(__n_{m.name}_{h}, __w_{m.weight}_{h})"
            out.append(f"{shrink(n, m.k, rate, prior)} AS {m.name}_ewm_h{h}")
    return out


def rolling_rates(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    metrics: Sequence[Metric],
    halflives: Sequence[float],
    *,
    prior_prefix: str = "prior_",
    keep: Sequence[str] | None = None,
    date: str | None = "game_date",
    extra_sums: Mapping[str, str] | None = None,
    extra_ewms: Mapping[str, tuple[str, float]] | None = None,
    **state_options,
) -> DataFrame:
    """``{m}_season`` and ``{m}_ewm_h{h}``, shrunk to the row's ``prior_{m}`` column."""
    sums, ewms = rate_state(metrics, halflives)
    state = running_state(
        df, entity, order,
        sums={**sums, **(extra_sums or {})},
        ewms={**ewms, **(extra_ewms or {})},
        latest={"last_app_date": date} if date else None,
        **state_options,
    )
    keep = list(keep) if keep is not None else df.columns
    tail = ["last_app_date"] if date else []
    return state.selectExpr(*keep, "seq", *rates_of(metrics, halflives, prior_prefix), *(extra_sums or {}), *(extra_ewms or {}), *tail)
