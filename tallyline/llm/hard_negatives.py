"""Hard negatives by angular triangle filtering.

Components become integers, floor(256 x); a score is the integer inner product. Every row stores its angle to a few reference
directions. For an anchor at angle a and a row at angle b to the same direction, the angle between both lies in
[|a - b|, min(a + b, 2 pi - a - b)]; over all directions that leaves an interval of the cosine, and with the two norms, rounded
outwards, bounds of the score. Only rows whose bounds overlap a window that an anchor asks for are scored.

Rows are kept in blocks of one nearest direction; a block's extreme angles and norms bound all of it, so most anchors never
meet it. The windows grow narrow before the blocks are visited: an anchor's own block yields scores that the last of its
positives, or of its negatives for a positive, cannot fall below. Of rows equal in label and vector only the first
POSITIVES + 1 ids can be among the first of any anchor (equal scores go by id), so no more enter the blocks: this is exact and
bounds a vector that holds a third of all rows. Anchors are never reduced; they travel in chunks.

Defined results: rows without id, label or vector, with a null or non-finite component, an empty vector or another length than
the most common one (ties: the shorter) take no part, nor do rows whose squared integer norm exceeds 2^61 (their scores would
not fit a long). Exact repeats of a row count once; an anchor never meets its own id. A zero vector scores 0. Score ties go to
the smaller id. A positive without a negative in its window gives no row; an empty table gives none. Only the named columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyline.session import pin

POSITIVES = 5
NEGATIVES = 5
SCALE = 256
DIRECTIONS = 16
SAMPLE_ROWS = 4096  # the directions are chosen among so many rows, those of the smallest hash
BLOCK_ROWS = 4096
CHUNK_ANCHORS = 512
PACK_BLOCKS = 4096  # summaries of blocks that an anchor chunk meets at once
SLACK = 4e-6  # radians: errors of arccos and of single precision
LONGEST = 2.0**61  # largest squared norm
EXACT = 2.0**53  # sums of products below this are exact in doubles
NONE, ALL = -(2**62), 2**62

ROW = "id long, label long, q array<bigint>, norm double, angles array<float>, cell int"


def sound(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, q): the rows that take part, components as integers."""
    wide = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).where(
        "id IS NOT NULL AND label IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
        f" AND aggregate(v, 0D, (s, c) -> s + {SCALE}D * c * {SCALE}D * c) <= {LONGEST!r}D"
    )
    common = wide.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return wide.where(F.size("v") == (common.dim if common else 0)).selectExpr("id", "label", f"transform(v, c -> floor({SCALE}D * c)) AS q")


def directions(rows: DataFrame) -> np.ndarray:
    """Unit vectors far from one another: farthest-first among a bounded sample."""
    taken = rows.where("exists(q, c -> c <> 0)").orderBy(F.xxhash64("id", "q"), "id").limit(SAMPLE_ROWS).select("q").collect()
    if not taken:
        return np.zeros((0, 0))
    x = np.array([r.q for r in taken], float)
    x /= np.sqrt((x**2).sum(1))[:, None]
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(DIRECTIONS, len(x)) and near.min() < 0.999:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def matrix(column: pa.Array, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), -1)


def measured(rows: DataFrame, axes: np.ndarray) -> DataFrame:
    """Rows with norm, angles to the directions and the nearest direction (cell). A zero vector has angles 0."""

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column("q"), float)
                norm = np.sqrt((q**2).sum(1))
                cos = (q @ axes.T) / np.maximum(norm, 1e-300)[:, None] if len(axes) else np.ones((len(q), 1))
                angles = np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * angles.shape[1]), pa.array(angles.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), batch.column("q"), pa.array(norm), flat, pa.array(angles.argmin(1).astype(np.int32))],
                    ["id", "label", "q", "norm", "angles", "cell"])

    return rows.mapInArrow(measure, ROW)


def packed(rows: DataFrame, by: list[str], names: list[str], extremes: bool = False) -> DataFrame:
    """One row per group with the arrays ``names`` as bytes, and with the extreme angles and norms of the group."""
    kinds = {"q": np.int64, "angles": np.float32, "norm": float, "low": np.int64, "high": np.int64}

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id") if "id" in names else table
        out = {b: table.column(b)[:1] for b in by}
        out["n"] = pa.array([table.num_rows], pa.int32())
        arrays = {c: matrix(table.column(c), kinds[c]) if pa.types.is_list(table.schema.field(c).type) or pa.types.is_large_list(table.schema.field(c).type)
                  else table.column(c).to_numpy().astype(kinds.get(c, np.int64)) for c in names}
        out |= {c: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for c, a in arrays.items()}
        if extremes:
            a, norm = arrays["angles"].astype(float), arrays["norm"]
            out["bound"] = pa.array([np.concatenate([a.min(0), a.max(0), [norm.min(), norm.max()]]).tobytes()], pa.binary())
        return pa.table(out)

    kind = dict(rows.dtypes)
    schema = ", ".join([f"{b} {kind[b]}" for b in by] + ["n int"] + [f"{c} binary" for c in names] + ["bound binary"] * extremes)
    return rows.select(*dict.fromkeys(by + names)).groupBy(*by).applyInArrow(pack, schema)


def score_bounds(nearest: np.ndarray, farthest: np.ndarray, norms: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bound of the scores for angles between ``nearest`` and ``farthest``; norms as (smallest, largest) pairs, rounded outwards."""
    up, down = np.cos(np.maximum(nearest - SLACK, 0)), np.cos(np.minimum(farthest + SLACK, np.pi))
    small, large = norms * other[0], norms * other[1]
    upper = np.maximum(small * up, large * up)
    lower = np.minimum(small * down, large * down)
    return np.floor(lower * (1 - 1e-9 * np.sign(lower)) - 1), np.ceil(upper * (1 + 1e-9 * np.sign(upper)) + 1)


def overlapping(low: np.ndarray, high: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Whether [lower, upper] (anchors x things) meets one of the windows (anchors x windows)."""
    met = np.zeros(lower.shape, bool)
    for j in range(low.shape[1]):
        met |= (low[:, j] <= high[:, j])[:, None] & (upper >= low[:, j, None]) & (lower <= high[:, j, None])
    return met


ANCHOR = {"aid": np.int64, "id": np.int64, "label": np.int64, "q": np.int64, "norm": float, "angles": np.float32, "low": np.int64, "high": np.int64}
THING = {"id": np.int64, "label": np.int64, "q": np.int64, "norm": float, "angles": np.float32}


def unpack(row: dict, n: int, kinds: dict, prefix: str = "") -> dict:
    got = {c: np.frombuffer(row[prefix + c], k) for c, k in kinds.items()}
    return {c: a.reshape(n, -1) if c in ("q", "angles", "low", "high") else a for c, a in got.items()}


def search_block(a: dict, b: dict, same: bool, first: int) -> tuple[np.ndarray, ...]:
    """(aid, window, id, score): the first rows of a block in every window of every anchor."""
    nearest = np.zeros((len(a["id"]), len(b["id"])), np.float32)
    farthest = np.full_like(nearest, np.pi)
    for r in range(a["angles"].shape[1]):
        one, two = a["angles"][:, r, None], b["angles"][None, :, r]
        np.maximum(nearest, np.abs(one - two), out=nearest)
        both = one + two
        np.minimum(farthest, np.minimum(both, np.float32(2 * np.pi) - both), out=farthest)
    # beside a zero vector any angle is right: its bounds are 0
    lower, upper = score_bounds(nearest, farthest, a["norm"][:, None], (b["norm"][None], b["norm"][None]))
    asked = overlapping(a["low"], a["high"], lower, upper)
    like = a["label"][:, None] == b["label"][None]
    asked &= (like & (a["id"][:, None] != b["id"][None])) if same else ~like
    rows, cols = np.flatnonzero(asked.any(1)), np.flatnonzero(asked.any(0))
    asked, ids = asked[np.ix_(rows, cols)], b["id"][cols]
    one, two = a["q"][rows], b["q"][cols]
    if len(rows) and a["norm"].max() * b["norm"].max() < EXACT:
        score = np.rint(one.astype(float) @ two.astype(float).T).astype(np.int64)
    else:
        score = one @ two.T
    found = []
    for j in range(a["low"].shape[1]):
        inside = asked & (score >= a["low"][rows, j, None]) & (score <= a["high"][rows, j, None])
        if len(cols) > first:
            open_ = np.where(inside, score, NONE - 1)
            inside &= score >= np.partition(open_, -first, axis=1)[:, -first, None]
        r, c = np.nonzero(inside)
        order = np.lexsort((ids[c], -score[r, c], r))
        r, c = r[order], c[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < first
        r, c = r[best], c[best]
        found.append((a["aid"][rows[r]], np.full(len(r), j, np.int32), ids[c], score[r, c]))
    return tuple(np.concatenate(p) for p in zip(*found))


FOUND = "aid long, window int, id long, score long"


def visited(work: DataFrame, same: bool, first: int) -> DataFrame:
    """FOUND rows of every pair of a chunk of anchors (columns a_*) and a block."""

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = search_block(unpack(row, row["a_n"], ANCHOR, "a_"), unpack(row, row["n"], THING), same, first)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["aid", "window", "id", "score"])

    return work.mapInArrow(search, FOUND)


class Mined:
    """Blocks of all rows and their summaries; chunks of anchors meet the blocks that their windows overlap."""

    def __init__(self, rows: DataFrame):
        cells = {r.cell: -(-r["count"] // BLOCK_ROWS) for r in rows.groupBy("cell").count().collect()}  # one row per direction
        self.parts = F.create_map(*[F.lit(x) for kv in (cells or {0: 1}).items() for x in kv])
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "label", "q"), self.parts[F.col("cell")].cast("long")))
        self.blocks = pin(packed(dealt, ["cell", "part"], list(THING), extremes=True), "blocks")
        summaries = self.blocks.select("cell", "part", "bound", F.pmod(F.xxhash64("cell", "part"), F.lit(max(1, -(-sum(cells.values()) // PACK_BLOCKS)))).alias("pack"))
        self.packs = max(1, -(-sum(cells.values()) // PACK_BLOCKS))
        self.summaries = pin(summaries.groupBy("pack").agg(F.collect_list(F.struct("cell", "part", "bound")).alias("held")), "summaries")

    def chunks(self, anchors: DataFrame) -> DataFrame:
        """Anchors with windows (low, high) in chunks of one cell."""
        sizes = {r.cell: -(-r["count"] // CHUNK_ANCHORS) for r in anchors.groupBy("cell").count().collect()}
        number = F.create_map(*[F.lit(x) for kv in (sizes or {0: 1}).items() for x in kv])
        dealt = anchors.withColumn("chunk", F.pmod(F.xxhash64("aid"), number[F.col("cell")].cast("long")))
        return packed(dealt, ["cell", "chunk"], list(ANCHOR)).select("cell", "chunk", *[F.col(c).alias(f"a_{c}") for c in ["n", *ANCHOR]])

    def at_home(self, anchors: DataFrame, same: bool, first: int) -> DataFrame:
        """FOUND rows of one block of an anchor's own cell."""
        sent = self.chunks(anchors).withColumn("part", F.pmod("chunk", self.parts[F.col("cell")].cast("long")))
        return visited(self.blocks.join(sent, ["cell", "part"]), same, first)

    def everywhere(self, anchors: DataFrame, same: bool, first: int) -> DataFrame:
        """FOUND rows of every block whose bounds overlap a window."""
        asked = self.chunks(anchors).drop("cell").withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.packs - 1).cast("long"))))
        met = asked.join(self.summaries, "pack")
        names = ["n", *ANCHOR]

        def choose(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    a = unpack(row, row["a_n"], ANCHOR, "a_")
                    bounds = np.array([np.frombuffer(h["bound"]) for h in row["held"]])
                    d = a["angles"].shape[1]
                    least, most, norms = bounds[:, :d], bounds[:, d: 2 * d], bounds[:, 2 * d:]
                    nearest, farthest = np.zeros((len(a["id"]), len(bounds))), np.full((len(a["id"]), len(bounds)), np.pi)
                    for r in range(d):
                        x = a["angles"][:, r, None].astype(float)
                        nearest = np.maximum(nearest, np.maximum(least[:, r] - x, x - most[:, r]))
                        # a + b and 2 pi - a - b are largest at the ends of the block's interval
                        farthest = np.minimum(farthest, np.minimum(x + most[:, r], 2 * np.pi - x - least[:, r]))
                    lower, upper = score_bounds(nearest, farthest, a["norm"][:, None], (norms[None, :, 0], norms[None, :, 1]))
                    asked = overlapping(a["low"], a["high"], lower, upper)
                    for k in np.flatnonzero(asked.any(0)):
                        at = np.flatnonzero(asked[:, k])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["held"][k]["cell"]], pa.int32()), pa.array([row["held"][k]["part"]], pa.int64()), pa.array([len(at)], pa.int32())]
                            + [pa.array([np.ascontiguousarray(a[c][at]).tobytes()], pa.binary()) for c in ANCHOR],
                            ["cell", "part"] + [f"a_{c}" for c in names])

        schema = "cell int, part long, a_n int, " + ", ".join(f"a_{c} binary" for c in ANCHOR)
        return visited(self.blocks.join(met.mapInArrow(choose, schema), ["cell", "part"]), same, first)


def firsts(found: DataFrame, first: int) -> DataFrame:
    order = Window.partitionBy("aid", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def floors(found: DataFrame, first: int) -> DataFrame:
    """(aid, floors): for every window a score that the last of its first rows cannot fall below."""
    least = found.groupBy("aid", "window").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= first)
    return least.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("floors"))


def lifted(anchors: DataFrame, found: DataFrame, first: int) -> DataFrame:
    return anchors.join(floors(found, first), "aid", "left").withColumn(
        "low", F.expr("transform(low, (l, j) -> greatest(l, coalesce(floors[j], l)))")).drop("floors")


def mine_negatives(rows: DataFrame, anchors: str, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that the condition ``anchors`` marks.

    ``anchors`` is a condition on ``id``, the key as a long.
    """
    taken = pin(sound(rows, key, vector, label), "vectors")
    axes = directions(taken)
    order = Window.partitionBy("label", "q").orderBy("id")
    once = taken.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= max(POSITIVES + 1, NEGATIVES)).dropDuplicates(["label", "q", "id"]).drop("nth")
    index = Mined(pin(measured(once, axes), "measured"))
    asked = measured(taken.where(anchors).dropDuplicates(["id", "label", "q"]), axes).withColumn("aid", F.monotonically_increasing_id())
    asked = pin(asked, "anchors")  # stored with its numbers

    whole = asked.withColumn("low", F.array(F.lit(NONE))).withColumn("high", F.array(F.lit(ALL)))
    narrow = pin(lifted(whole, index.at_home(whole, True, POSITIVES), POSITIVES), "positive-windows")
    positives = pin(firsts(index.everywhere(narrow, True, POSITIVES), POSITIVES).selectExpr("aid", "rank - 1 AS window", "id AS positive_id", "score AS positive_score"), "positives")

    # 80 p <= 100 n, for integers n >= p - floor(p / 5); every anchor has POSITIVES windows, the missing ones empty
    by_anchor = positives.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("window", "positive_score"))).alias("score"))
    windows = asked.join(by_anchor, "aid")
    nth = ", ".join(f"score[{j}]" for j in range(POSITIVES))
    windows = windows.withColumn("high", F.expr(f"transform(array({nth}), p -> coalesce(p, {NONE}L))")).withColumn(
        "low", F.expr(f"transform(array({nth}), p -> coalesce(p - (p - pmod(p, 5L)) div 5L, {ALL}L))")).drop("score")
    windows = pin(windows, "negative-windows")
    narrow = pin(lifted(windows, index.at_home(windows, False, NEGATIVES), NEGATIVES), "narrow-windows")
    negatives = firsts(index.everywhere(narrow, False, NEGATIVES), NEGATIVES).selectExpr("aid", "window", "rank", "id AS negative_id", "score AS negative_score")
    return (
        negatives.join(positives, ["aid", "window"]).join(asked.selectExpr("aid", "id AS anchor_id"), "aid")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def relabelled(rows: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Every seventh id moves to the next of ten labels."""
    return rows.withColumn(label, F.expr(f"if({key} % 7 = 0, ({label} + 1L) % 10, {label})"))


def oracle(every: int = 100) -> str:
    """DuckDB text of the same rows: all anchors against all rows."""
    return f"""
WITH finite AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), counted AS (SELECT len(v) AS dim, count(*) AS n FROM finite GROUP BY 1),
sound AS (SELECT DISTINCT id, label, v AS q FROM finite WHERE len(v) = (SELECT dim FROM counted ORDER BY n DESC, dim LIMIT 1)),
scored AS (
  SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.id <> b.id WHERE a.id % {every} = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM scored WHERE label = own) WHERE r <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s USING (anchor_id)
  WHERE s.label <> s.own AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
) WHERE rank <= {NEGATIVES}"""
