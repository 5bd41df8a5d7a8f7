"""Boosted trees on histograms, with a margin of the caller's own to start from; many models in one pass.

Rows are binned once: one byte per feature (0 where it is NULL), stored with the margin they start from, many rows to a block of
BLOCK_BYTES, since a level costs far more per record that it reads than per row that it adds up. Every level of a tree is one job: a task adds up gradient and hessian per (model, node, feature, bin) of its rows, the sums meet in one exchange whose size
follows the bins and not the rows (up to DRIVER_CELLS of them at the driver, which saves the exchange), and the best split of every node is taken from running sums over its bins. Only the rows a
model learns from at that level walk through its trees. Leaves take their value from the sums of the split that made them. Losses
of the training and the stopping rows come with the first level of the next tree, so early stopping costs no pass of its own. After
PIN_ROUNDS trees the margins are stored anew, one per model.

Models that differ in settings or in their rows (candidates of a search x folds) are grown side by side by the same jobs.

A split's gain is the reduction of the regularised loss as boosting libraries report it (without the factor 1/2); a node is
split where it exceeds ``gamma``. Missing values go to the side that gains more (ties: right); ties between splits go to
the first feature, then to the lowest threshold. A row is left of a threshold where its value is smaller.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.operators.ordering import exact_quantiles
from tallyline.session import drop_scratch, scratch_path

BINS = 64  # at most 254
PIN_ROUNDS = 8
LEAST_GAIN = 1e-6
BLOCK_BYTES = 4_096  # a task is handed up to 10,000 blocks at once
PIECE = 16_384  # rows worked on together
SUM_CELLS = 8_000_000  # sums that a task holds at once (a deep tree over many features may need more alone)
NODE_CELLS = 4_096  # a node of at most so many sums has its best split found by one task
DRIVER_CELLS = 2_000_000  # sums of all tasks that a level may bring to the driver (32 bytes each)


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    patience: int = 40  # rounds without a smaller loss on the stopping rows
    depth: int = 6
    rate: float = 0.3
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class Task:
    """One model to be fitted: its settings and SQL conditions for its training and stopping rows."""

    settings: Settings
    train: str = "true"
    stopping: str = "false"


LEAF = {"feature": -1, "bin": 0, "missing_left": False, "left": -1, "right": -1, "gain": 0.0}


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Thresholds of every feature: its distinct quantiles at k / bins; a constant or empty feature has one or none."""
    if not 2 <= bins <= 254:
        raise ValueError("between 2 and 254 bins")
    found = {r["name"]: r["q"] for r in exact_quantiles(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features]), features, [k / bins for k in range(1, bins)]).collect()}
    return [sorted(set(found.get(c, []))) for c in features]


def _codes(n: int, columns: Sequence[pa.Array], cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """(``n`` rows x features) bytes: 0 for a missing value, else 1 + the number of thresholds at or below it."""
    out = np.empty((n, len(columns)), np.uint8)
    for k, c in enumerate(columns):
        x = c.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.asarray(cuts[k], float), x, side="right"))
    return out


class _Walk:
    """A tree (arrays by node) as one table of the next node per (node, code): three look-ups a level."""

    def __init__(self, tree: dict, depth: int, width: int):
        nodes = np.arange(len(tree["feature"]))[:, None]
        code = np.arange(width)[None]
        left = np.where(code == 0, tree["missing_left"][:, None], code <= tree["bin"][:, None])
        then = np.where(left, tree["left"][:, None], tree["right"][:, None])
        self.then = np.where(tree["feature"][:, None] < 0, nodes, then).ravel()
        self.column, self.width = np.maximum(tree["feature"], 0), width
        self.depth = depth if len(tree["feature"]) > 1 else 0
        self.value = tree["value"]

    def leaves(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The node at which every row ends; ``flat`` holds the codes row by row, ``start`` the first place of every row."""
        node = np.zeros(len(start), np.int64)
        for _ in range(self.depth):
            node = self.then.take(node * self.width + flat.take(start + self.column.take(node)))
        return node


def _arrays(nodes: Sequence[dict]) -> dict[str, np.ndarray]:
    kinds = {"feature": np.int64, "bin": np.int64, "missing_left": bool, "left": np.int64, "right": np.int64, "value": float}
    return {c: np.array([n[c] for n in nodes], k) for c, k in kinds.items()}


def _uniform(draw: np.ndarray, round_: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from a row's stored draw: the same for every task and retry."""
    x = draw.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + round_) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """(rows x width) view of a column of binaries without NULLs, whole rows each: they lie one behind the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, ends[0]).reshape(-1, width)


def _blocks(rows: dict[str, np.ndarray], block_bytes: int) -> pa.RecordBatch:
    """Matrices of the same rows as binaries: blocks of ``block_bytes`` in all, one row at least."""
    n, size = len(rows["y"]), sum(m.shape[1] * m.itemsize for m in rows.values())
    step = max(1, block_bytes // size)
    ends = np.append(np.arange(0, n, step), n)
    out = [
        pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * (m.shape[1] * m.itemsize)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(m))])
        for m in rows.values()
    ]
    return pa.RecordBatch.from_arrays(out, list(rows))


def _pieces(batches, features: int, roles: int, margins: int):
    """The rows of all blocks as matrices, PIECE of them at a time."""
    kinds = {"codes": (np.uint8, features), "y": (float, 1), "draw": (np.int64, 1), "roles": (np.uint8, roles), "margins": (float, margins)}
    for batch in batches:
        if batch.num_rows:
            y = _matrix(batch.column("y"), *kinds["y"])
            whole = {c: _matrix(batch.column(c), *kinds[c]) if kinds[c][1] else np.empty((len(y), 0), kinds[c][0]) for c in batch.schema.names}
            for at in range(0, len(y), PIECE):
                yield {c: m[at : at + PIECE] for c, m in whole.items()}


class _Grown:
    """A model while it grows."""

    def __init__(self, task: Task, features: int, role: int = 0, start: float = 0.0):
        self.s, self.features, self.role, self.start = task.settings, features, role, start
        self.trees: list[list[dict]] = []
        self.arrays: list[dict[str, np.ndarray]] = []  # the same trees by node
        self.losses: list[tuple[float | None, float | None]] = []
        self.open = task.settings.rounds > 0
        self.nodes: list[dict] = []
        self.frontier: list[int] = []

    def start_tree(self) -> None:
        rng = np.random.default_rng([self.s.seed, len(self.trees)])
        n = max(1, int(self.s.colsample * self.features))
        self.columns = sorted(rng.choice(self.features, n, replace=False).tolist()) if n < self.features else list(range(self.features))
        self.nodes, self.frontier = [{**LEAF, "value": 0.0}], [0]

    def best_round(self) -> int:
        """Trees to keep: up to the first least stopping loss, all of them without stopping rows."""
        staged = [s for _, s in self.losses[1:]]
        if not staged or staged[0] is None:
            return len(self.trees)
        return 1 + min(range(len(staged)), key=lambda i: (staged[i], i))

    def told(self, train: float | None, stopping: float | None) -> None:
        self.losses.append((train, stopping))
        done = len(self.losses) - 1
        if done >= self.s.rounds or (done and stopping is not None and done - self.best_round() >= self.s.patience):
            self.open = False


def _level(rows: DataFrame, models: list[_Grown], stored: int, first: bool, features: int, width: int, whole: bool = True) -> DataFrame:
    """(model, node, feature, bin, g, h) sums over the frontiers; losses as node -1 (training) and -2 (stopping).

    Models whose sums do not fit together are added up by different tasks. Unless ``whole``, every task's sums are rows of their own.
    """
    groups, cells = [], SUM_CELLS
    for k, m in enumerate(models):
        if m.open and m.frontier:
            own = len(m.frontier) * features * width
            if cells + own > SUM_CELLS:
                groups.append([])
                cells = 0
            cells += own
            groups[-1].append((k, m.s, m.role, m.start, m.arrays[stored:], len(m.trees), _arrays(m.nodes), list(m.frontier), m.columns))
    roles, count = 1 + max(m.role for m in models), len(models) if stored else 0
    parts = [rows.mapInArrow(_summing(work, roles, count, first, features, width), "model int, node int, feature int, bin int, g double, h double") for work in groups]
    sums = reduce(DataFrame.union, parts)
    if not whole:
        return sums
    # the tasks' sums are dealt by what the running sums need later on, small nodes as a whole for the best split, too: one exchange for all
    dealt = sums.repartition("model", "node", *(["feature"] if features * width > NODE_CELLS else []))
    return dealt.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _summing(work: list[tuple], kinds: int, count: int, first: bool, features: int, width: int):
    """The function that adds up the sums of a task's rows for some of the models; ``count`` margins are stored, or one for all (0)."""

    def partial(batches):
        sums = {k: np.zeros((2, len(frontier), features, width)) for k, *_, frontier, _ in work}
        losses = {k: np.zeros((2, 2)) for k, *_ in work}
        walks = {k: ([_Walk(t, s.depth, width) for t in trees], _Walk(nodes, s.depth, width)) for k, s, _, _, trees, _, nodes, *_ in work}
        places = {}
        for k, *_, nodes, frontier, _ in work:
            places[k] = np.full(len(nodes["feature"]), -1)
            places[k][frontier] = np.arange(len(frontier))
        for piece in _pieces(batches, features, kinds, count or 1):
            margins, roles, y = piece["margins"], piece["roles"], piece["y"][:, 0]
            flat, draws, learners = piece["codes"].ravel(), {}, {}
            for k, s, kind, start, _, round_, _, frontier, columns in work:
                if (kind, s.subsample, s.seed, round_) not in learners:
                    learns = roles[:, kind] == 1
                    if s.subsample < 1:
                        if (s.seed, round_) not in draws:
                            draws[s.seed, round_] = _uniform(piece["draw"][:, 0], round_, s.seed)
                        learns &= draws[s.seed, round_] < s.subsample
                    learners[kind, s.subsample, s.seed, round_] = learns
                learns = learners[kind, s.subsample, s.seed, round_]
                rows = np.flatnonzero(roles[:, kind] > 0 if first else learns)
                z, at = margins[rows, k] if count else margins[rows, 0] + start, rows * features
                for t in walks[k][0]:
                    z += t.value.take(t.leaves(flat, at))
                if first:
                    loss = np.logaddexp(0.0, z) - y[rows] * z
                    for role in (0, 1):
                        own = roles[rows, kind] == role + 1
                        losses[k][role] += loss[own].sum(), own.sum()
                    own = learns[rows]
                    rows, z, at = rows[own], z[own], at[own]
                node = places[k].take(walks[k][1].leaves(flat, at))
                if len(frontier) > 1 or not first:
                    own = node >= 0
                    rows, z, at, node = rows[own], z[own], at[own], node[own]
                p = 1 / (1 + np.exp(-z))
                g, h, node = p - y[rows], p * (1 - p), node * width
                for f in columns:
                    cell = node + flat.take(at + f)
                    for i, x in enumerate((g, h)):
                        sums[k][i, :, f] += np.bincount(cell, x, len(frontier) * width).reshape(-1, width)
        out = []
        for k, *_, frontier, _ in work:
            n, f, b = np.nonzero(sums[k][1])
            out.append((np.full(len(n), k), np.array(frontier, np.int64)[n], f, b, sums[k][0][n, f, b], sums[k][1][n, f, b]))
            if first:
                out.append((np.full(2, k), np.array([-1, -2]), np.zeros(2, int), np.zeros(2, int), losses[k][:, 0], losses[k][:, 1]))
        if out:
            ints, sums_ = zip(*[(x[:4], x[4:]) for x in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*ints)] + [pa.array(np.concatenate(c).astype(float)) for c in zip(*sums_)],
                ["model", "node", "feature", "bin", "g", "h"])

    return partial


def best_splits(sums: DataFrame, settings: Sequence[Settings], by: Sequence[str] = ("model", "node")) -> DataFrame:
    """One row per ``by``: totals and the split with the largest gain, NULL where none is allowed.

    ``sums`` has (model, node, feature, bin, g, h), ``settings`` one entry per model.
    """
    by = list(by)
    whole = "OVER (PARTITION BY model, node, feature)"
    upto = "OVER (PARTITION BY model, node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = sums.selectExpr(
        "model", "node", "feature", "bin", f"sum(g) {whole} AS gt", f"sum(h) {whole} AS ht", f"sum(if(bin = 0, g, 0D)) {whole} AS gm", f"sum(if(bin = 0, h, 0D)) {whole} AS hm",
        f"sum(if(bin = 0, 0D, g)) {upto} AS gk", f"sum(if(bin = 0, 0D, h)) {upto} AS hk",
        *[f"get(array({', '.join(f'{float(getattr(x, c))!r}D' for x in settings)}), model) AS {c}" for c in ("reg_alpha", "reg_lambda", "gamma", "min_child_weight")])
    sides = run.selectExpr("*", "inline(array(struct(false AS missing_left, gk AS gl, hk AS hl), struct(true AS missing_left, gk + gm AS gl, hk + hm AS hl)))")
    score = lambda g, h: f"pow(greatest(abs({g}) - reg_alpha, 0D), 2) / ({h} + reg_lambda)"
    gain = f"{score('gl', 'hl')} + {score('(gt - gl)', '(ht - hl)')} - {score('gt', 'ht')}"
    allowed = f"bin > 0 AND (hm > 0 OR NOT missing_left) AND hl >= min_child_weight AND ht - hl >= min_child_weight AND ht - hl > 0 AND hl > 0 AND {gain} > greatest(gamma, {LEAST_GAIN}D)"
    shown = sides.selectExpr(*by, *(["feature"] if "feature" not in by else []), "bin", "missing_left", "gl", "hl", "gt", "ht", f"CASE WHEN {allowed} THEN {gain} END AS gain")
    order = "CASE WHEN gain IS NOT NULL THEN struct(round(gain, 12) AS a, -feature AS b, -bin AS c, NOT missing_left AS d) END"
    best = f"max_by(struct({'feature, ' if 'feature' not in by else ''}bin, missing_left, gl, hl, gain), {order}) AS best"
    return shown.groupBy(*by).agg(F.expr("max(gt) AS gt"), F.expr("max(ht) AS ht"), F.expr(best))


class _Split(NamedTuple):
    feature: int
    bin: int
    missing_left: bool
    gl: float
    hl: float
    gain: float


class _Best(NamedTuple):
    gt: float
    ht: float
    best: _Split | None


def _found(rows: DataFrame, models: list[_Grown], stored: int, first: bool, features: int, width: int, tasks: int) -> dict[tuple[int, int], _Best]:
    """Totals and best split of every open node; the losses ride along as nodes of their own, whose single bin cannot be split."""
    settings = [m.s for m in models]
    if tasks * features * width * sum(len(m.frontier) for m in models if m.open) > DRIVER_CELLS:
        best = best_splits(_level(rows, models, stored, first, features, width), settings)
        return {(r.model, r.node): _Best(r.gt, r.ht, r.best and _Split(*[r.best[c] for c in _Split._fields])) for r in best.collect()}  # one row per open node
    return _splits(_level(rows, models, stored, first, features, width, False).toArrow(), settings, features, width)


def _splits(sums: pa.Table, settings: Sequence[Settings], features: int, width: int) -> dict[tuple[int, int], _Best]:
    """``best_splits`` of sums that are here."""
    model, node, feature, bin_, g, h = (c.to_numpy() for c in sums.columns)
    names, place = np.unique(model.astype(np.int64) * 2**32 + node + 2, return_inverse=True)
    shape = len(names), features, width
    cell = (place * features + feature) * width + bin_
    seen, g, h = (np.bincount(cell, x, math.prod(shape)).reshape(shape) for x in (None, g, h))
    seen = seen > 0
    models, nodes = names >> 32, (names & (2**32 - 1)) - 2
    alpha, weight, gamma, least = (np.array([float(getattr(x, c)) for x in settings])[models].reshape(-1, 1, 1, 1) for c in ("reg_alpha", "reg_lambda", "gamma", "min_child_weight"))
    # (node, feature, bin, missing left or not): the first of the largest is the split that ties go to
    gt, ht = (x.sum(2)[..., None, None] for x in (g, h))
    gl, hl = (np.cumsum(x[..., 1:], 2)[..., None] + np.stack([np.zeros_like(x[..., :1]), x[..., :1]], -1) for x in (g, h))
    score = lambda g, h: np.maximum(np.abs(g) - alpha, 0) ** 2 / (h + weight)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
    missing = np.stack([np.ones_like(seen[..., :1]), h[..., :1] > 0], -1)
    allowed = seen[..., 1:, None] & missing & (hl >= least) & (ht - hl >= least) & (ht - hl > 0) & (hl > 0) & (gain > np.maximum(gamma, LEAST_GAIN))
    order = np.where(allowed, np.round(gain, 12), -np.inf).reshape(len(names), -1)
    best = order.argmax(1)
    # a feature that no sums came for has no totals
    gt, ht = (np.where(seen.any(2), x[..., 0, 0], -np.inf).max(1) for x in (gt, ht))
    out = {}
    for i, (m, n) in enumerate(zip(models.tolist(), nodes.tolist())):
        split = None
        if order[i, best[i]] > -np.inf:
            f, b, left = np.unravel_index(best[i], gain.shape[1:])
            split = _Split(int(f), int(b) + 1, bool(left), *[float(x[i, f, b, left]) for x in (gl, hl, gain)])
        out[m, n] = _Best(float(gt[i]), float(ht[i]), split)
    return out


def _value(g: float, h: float, s: Settings) -> float:
    return -math.copysign(max(abs(g) - s.reg_alpha, 0.0), g) / (h + s.reg_lambda) * s.rate if h + s.reg_lambda else 0.0


def role_kinds(tasks: Sequence[Task]) -> dict[tuple[str, str], int]:
    """A number for every distinct pair of training and stopping rows: candidates on the same fold share one."""
    return {pair: i for i, pair in enumerate(dict.fromkeys((t.train, t.stopping) for t in tasks))}


def binned(df: DataFrame, features: Sequence[str], cuts, target: str, margin: Column | None, tasks: Sequence[Task], block_bytes: int = 0) -> DataFrame:
    """(codes, y, roles, margins): one byte per feature, one role per pair of training and stopping rows, the margin to start from.

    ``draw`` comes along where a model learns from a share of its rows. A record is a block of about ``block_bytes``, by default a single row.
    """
    pairs, sampled = role_kinds(tasks), any(t.settings.subsample < 1 for t in tasks)
    roles = [F.expr(f"CASE WHEN {train} THEN 1 WHEN {stopping} THEN 2 ELSE 0 END").cast("int") for train, stopping in pairs]
    names, count = [f"__x{i}" for i in range(len(features))], len(pairs)
    used = " OR ".join(f"({c})" for c in dict.fromkeys(c for pair in pairs for c in pair))
    rows = df.where(F.col(target).isNotNull() & F.expr(used)).select(
        *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)], F.col(target).cast("double").alias("y"), F.array(*roles).alias("roles"),
        (F.lit(0.0) if margin is None else margin.cast("double")).alias("margin"),
    )
    if sampled:
        rows = rows.withColumn("draw", F.xxhash64(*names, "y", "margin"))

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                packed = {
                    "codes": _codes(batch.num_rows, [batch.column(c) for c in names], cuts), "y": batch.column("y").to_numpy()[:, None], "roles": np.asarray(batch.column("roles").flatten()).astype(np.uint8).reshape(-1, count),
                    "margins": batch.column("margin").to_numpy(zero_copy_only=False).astype(float)[:, None],
                }
                yield _blocks(packed | ({"draw": batch.column("draw").to_numpy()[:, None]} if sampled else {}), block_bytes)

    return rows.mapInArrow(pack, "codes binary, y binary, roles binary, margins binary" + (", draw binary" if sampled else ""))


def _starts(rows: DataFrame, kinds: int, features: int) -> list[float]:
    """The logit of the training rows' mean for every pair of roles, from the stored blocks."""

    def partial(batches):
        sums = np.zeros((2, kinds))
        for piece in _pieces(batches, features, kinds, 1):
            own = piece["roles"] == 1
            sums += np.where(own, piece["y"], 0.0).sum(0), own.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(kinds, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], ["kind", "y", "n"])

    sums = rows.mapInArrow(partial, "kind int, y double, n double").groupBy("kind").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    means = {r.kind: r.y / r.n for r in sums.collect() if r.n}
    return [math.log(m / (1 - m)) if (m := means.get(k)) and m < 1 else 0.0 for k in range(kinds)]


def _moved(rows: DataFrame, models: list[_Grown], stored: int, features: int, width: int) -> DataFrame:
    """Rows with the margins after all trees, one per model."""
    work = [(m.start, m.s.depth, m.arrays[stored:]) for m in models]
    roles = 1 + max(m.role for m in models)

    def move(batches):
        walks = [(start, [_Walk(t, depth, width) for t in trees]) for start, depth, trees in work]
        for piece in _pieces(batches, features, roles, len(work) if stored else 1):
            flat, at = piece["codes"].ravel(), np.arange(len(piece["y"])) * features
            margins = piece["margins"].copy() if stored else piece["margins"] + np.array([start for start, _ in walks])[None]
            for k, (_, trees) in enumerate(walks):
                for t in trees:
                    margins[:, k] += t.value.take(t.leaves(flat, at))
            yield _blocks(piece | {"margins": margins}, BLOCK_BYTES)

    return rows.mapInArrow(move, rows.schema)


def fit_many(df: DataFrame, features: Sequence[str], tasks: Sequence[Task], target: str = "y", margin: Column | None = None, bins: int = BINS) -> list[dict]:
    """A model per task, all grown by the same jobs. Without ``margin`` a model starts at the logit of its training rows' mean.

    The thresholds are quantiles of the rows that any task trains on.
    """
    spark, features = df.sparkSession, list(features)
    used = df.where(" OR ".join(f"({t})" for t in dict.fromkeys(t.train for t in tasks)))
    cuts = quantile_cuts(used, features, bins)
    paths = [scratch_path(spark, "boosting")]
    table = binned(df, features, cuts, target, margin, tasks, BLOCK_BYTES)
    # read once per level, so dealt evenly over all cores, whatever the input's files were
    table.repartition(spark.sparkContext.defaultParallelism).write.parquet(paths[-1])
    rows = spark.read.schema(table.schema).parquet(paths[-1])
    pairs = role_kinds(tasks)
    roots = _starts(rows, len(pairs), len(features)) if margin is None else [0.0] * len(pairs)
    starts = [roots[pairs[t.train, t.stopping]] for t in tasks]
    models = [_Grown(t, len(features), pairs[t.train, t.stopping], start) for t, start in zip(tasks, starts)]
    stored, width, dealt = 0, max(map(len, cuts), default=0) + 2, rows.rdd.getNumPartitions()
    while any(m.open for m in models):
        for m in models:
            if m.open:
                m.start_tree()
        level = 0
        while level == 0 or any(m.open and m.frontier for m in models):
            found = _found(rows, models, stored, level == 0, len(features), width, dealt)
            for k, m in enumerate(models):
                if not m.open:
                    continue
                if level == 0:
                    mean = [found[k, n].gt / found[k, n].ht if (k, n) in found and found[k, n].ht else None for n in (-1, -2)]
                    m.told(*mean)
                    if not m.open:
                        m.nodes, m.frontier = [], []
                        continue
                grown = []
                for n in m.frontier:
                    r = found.get((k, n))
                    if r is None:
                        continue
                    m.nodes[n]["value"] = _value(r.gt, r.ht, m.s)
                    if r.best is None:
                        continue
                    b, l = r.best, len(m.nodes)
                    m.nodes[n] |= {"feature": b.feature, "bin": b.bin, "missing_left": b.missing_left, "left": l, "right": l + 1, "gain": b.gain}
                    for g, h in ((b.gl, b.hl), (r.gt - b.gl, r.ht - b.hl)):
                        m.nodes.append({**LEAF, "value": _value(g, h, m.s)})
                    grown += [l, l + 1]
                m.frontier = grown if level + 1 < m.s.depth else []
            level += 1
        for m in models:
            if m.open:
                m.trees.append(m.nodes)
                m.arrays.append(_arrays(m.nodes))
        grown_trees = max(len(m.trees) for m in models)
        if grown_trees - stored >= PIN_ROUNDS and any(m.open for m in models):
            # models that stopped earlier have no trees beyond ``stored`` and keep their margins
            moved, path = _moved(rows, models, stored, len(features), width), scratch_path(spark, "boosting")
            moved.write.parquet(path)
            rows, stored = spark.read.schema(table.schema).parquet(path), grown_trees
            dealt = rows.rdd.getNumPartitions()
            drop_scratch(spark, paths[-1])
            paths.append(path)
    drop_scratch(spark, paths[-1])
    out = []
    for m, start in zip(models, starts):
        kept = m.best_round()
        out.append({
            "features": features, "cuts": cuts, "start": start, "market": margin is not None, "depth": m.s.depth, "trees": m.trees[:kept],
            "losses": [{"train": a, "stopping": b} for a, b in m.losses], "grown": len(m.trees),
        })
    return out


def fit(df: DataFrame, features: Sequence[str], settings: Settings = Settings(), train: str = "true", stopping: str = "false", target: str = "y", margin: Column | None = None, bins: int = BINS) -> dict:
    return fit_many(df, features, [Task(settings, train, stopping)], target, margin, bins)[0]


def predict(model: dict, df: DataFrame, margin: Column | None = None, output: str = "p") -> DataFrame:
    """``df`` with the probability; a model fitted with a margin needs it here, too. No trees: the margin's probability."""
    if model["market"] != (margin is not None):
        raise ValueError("the margin must be given where the model was fitted with one, and only there")
    features, cuts, depth, start = model["features"], model["cuts"], model["depth"], model["start"]
    trees = [_arrays(t) for t in model["trees"]]
    width = max(map(len, cuts), default=0) + 2

    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        walks = [_Walk(t, depth, width) for t in trees]
        for margins, *columns in batches:
            flat, at = _codes(len(margins), columns, cuts).ravel(), np.arange(len(margins)) * len(columns)
            z = margins.to_numpy(zero_copy_only=False) + start
            for t in walks:
                z = z + t.value.take(t.leaves(flat, at))
            yield pa.array(1 / (1 + np.exp(-z)), from_pandas=True)

    # a column of its own, so that only what it needs goes to Python and columns that nobody asks for are not read
    values = [F.lit(0.0) if margin is None else margin.cast("double"), *[F.col(c).cast("double") for c in features]]
    return df.select(*[c for c in df.columns if c != output], F.arrow_udf(score, "double")(*values).alias(output))


def gains(model: dict, spark: SparkSession) -> DataFrame:
    """(feature, gain, splits): mean gain of the splits on every feature that has one."""
    found: dict[int, list[float]] = {}
    for tree in model["trees"]:
        for n in tree:
            if n["feature"] >= 0:
                found.setdefault(n["feature"], []).append(n["gain"])
    rows = [(model["features"][f], float(np.mean(g)), len(g)) for f, g in sorted(found.items())]
    return spark.createDataFrame(rows, "feature string, gain double, splits int")


def root_splits(df: DataFrame, features: Sequence[str], settings: Settings = Settings(), target: str = "y", margin: Column | None = None, bins: int = BINS) -> DataFrame:
    """(feature, threshold, gain, left_weight, right_weight): the best first split on every feature that allows one."""
    spark, features = df.sparkSession, list(features)
    cuts = quantile_cuts(df, features, bins)
    start = 0.0
    if margin is None:
        mean = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
        start = math.log(mean / (1 - mean)) if mean and mean < 1 else 0.0
    model = _Grown(Task(settings), len(features), start=start)
    model.start_tree()
    rows = binned(df, features, cuts, target, margin, [Task(settings)])
    best = best_splits(_level(rows, [model], 0, False, len(features), max(map(len, cuts)) + 2), [settings], ("model", "node", "feature"))
    names = spark.createDataFrame([(i, c, [float(x) for x in q]) for i, (c, q) in enumerate(zip(features, cuts))], "feature int, name string, cuts array<double>")
    return best.where("best IS NOT NULL").join(F.broadcast(names), "feature").selectExpr(
        "name AS feature", "get(cuts, best.bin - 1) AS threshold", "best.gain AS gain", "best.hl AS left_weight", "ht - best.hl AS right_weight")


def save(model: dict, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(json.dumps(model),)], "value string").write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
