"""Approximate nearest neighbours by collision counting: one sorted array per projection, windows around the query.

Vectors are lengthened by one coordinate so that the largest inner product is the smallest distance, and projected on
``projections`` random lines. Every shard of the index keeps one array per line, sorted by projection. A query opens a window
around its own projection on every line; virtual rehashing widens all windows step by step, and only what a step adds is
counted. Vectors that fall into the windows of enough lines are verified by their exact inner product; a query is done once
``verified`` of the shard's vectors (a share) and ``neighbours`` at least have been.

Every vector is indexed and every query meets every shard: queries and shards travel in blocks. Only the best rows of each
block meet again, per query.

Defined results: vectors that are null, zero, of another length than the most common one or that hold null or non-finite
components take no part, neither do null ids. Ties go to the smaller id. Exact repeats of a row (id and vector) count once, as
candidates and as queries; rows that share an id but not a vector are separate candidates and separate queries, each with
ranks of its own. A query never finds its own id. Fewer candidates give fewer rows; no vectors give none. Only the named
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyline.session import pin

NEIGHBOURS = 20
PROJECTIONS = 64
VERIFIED = 0.3
SHARD_ROWS = 8192
QUERY_ROWS = 1024
FIRST_WIDTH = 0.8  # half a window, in units of the largest norm
STEP = 1.25  # by which a window grows each time
THRESHOLD = 0.5  # share of the lines on which a vector has to collide
SEED = 5


def lines(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, PROJECTIONS))


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, top_norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the best verified vectors of one shard for every query."""
    n, axes = len(ids), lines(x.shape[1] + 1)
    longer = np.sqrt(np.maximum(top_norm**2 - (x**2).sum(1), 0))
    on_lines = x @ axes[:-1] + longer[:, None] * axes[-1]
    scale = top_norm / np.sqrt((q**2).sum(1))  # a query's own length does not change its order
    q_on_lines = (q * scale[:, None]) @ axes[:-1]
    order = [np.argsort(on_lines[:, j], kind="stable") for j in range(PROJECTIONS)]
    arrays = [on_lines[o, j] for j, o in enumerate(order)]
    enough = min(n, NEIGHBOURS + 1 + int(np.ceil(VERIFIED * n)))
    found_q, found_id, found_score = [], [], []
    counts = np.zeros((len(q), n), np.int16)
    # positions of the windows' ends, line by line for all queries of the block
    low = [np.searchsorted(a, q_on_lines[:, j]) for j, a in enumerate(arrays)]
    high = [p.copy() for p in low]
    open_, width = np.arange(len(q)), FIRST_WIDTH * top_norm
    while len(open_):
        adds = []
        for j, a in enumerate(arrays):
            at = q_on_lines[open_, j]
            lo, hi = np.minimum(np.searchsorted(a, at - width), low[j][open_]), np.maximum(np.searchsorted(a, at + width), high[j][open_])
            adds.append((lo, low[j][open_], high[j][open_], hi))
            low[j][open_], high[j][open_] = lo, hi
        still = []
        for m, k in enumerate(open_):
            new = [part for (lo, was_lo, was_hi, hi), o in zip(adds, order) for part in (o[lo[m]: was_lo[m]], o[was_hi[m]: hi[m]])]
            counts[k] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
            near = np.flatnonzero(counts[k] >= THRESHOLD * PROJECTIONS)
            if len(near) < enough:
                still.append(k)
                continue
            near = near[ids[near] != query_ids[k]]
            score = x[near] @ q[k]
            if len(near) > NEIGHBOURS:
                kept = score >= np.partition(score, -NEIGHBOURS)[-NEIGHBOURS]
                near, score = near[kept], score[kept]
            best = np.lexsort((ids[near], -score))[:NEIGHBOURS]
            found_q.append(np.full(len(best), k))
            found_id.append(ids[near][best])
            found_score.append(score[best])
        open_, width = np.array(still, np.int64), width * STEP
    return np.concatenate(found_q), np.concatenate(found_id), np.concatenate(found_score)


def sound(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    wide = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity')) AND exists(v, c -> c <> 0)"
    )
    common = wide.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return wide.where(F.size("v") == (common.dim if common else 0))


def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """(block, ids, vectors): packed rows of one hash class of the id, about ``size`` each."""
    count = rows.count()
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", F.lit(SEED), F.col("v")), F.lit(max(1, -(-count // size)))))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        # a row's repeats fall into the same block, so they can be told here
        rows = np.ascontiguousarray(np.hstack([ids[:, None].view(float), flat]))
        at = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1])))[:, 0], return_index=True)[1]
        at = at[np.argsort(ids[at], kind="stable")]
        return pa.table({name: table.column(name)[:1], "ids": pa.array([ids[at].tobytes()], pa.binary()), "vectors": pa.array([flat[at].tobytes()], pa.binary())})

    return dealt.groupBy(name).applyInArrow(pack, f"{name} long, ids binary, vectors binary")


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): the nearest rows found for every query, by inner product."""
    index, asked = pin(sound(rows, key, vector), "vectors"), sound(queries, key, vector)
    top = index.agg(F.max(F.expr("aggregate(v, 0D, (a, c) -> a + c * c)"))).first()[0]
    top_norm = float(top or 0.0) ** 0.5 * (1 + 1e-9)
    shards = blocks(index, "shard", SHARD_ROWS)
    asked = pin(blocks(asked, "block", QUERY_ROWS).withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors"}), "queries")
    n_shards = max(1, -(-index.count() // SHARD_ROWS))
    # a stated set of queries, in blocks, meets every shard of the index
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    work = shards.join(sent, "shard").repartition(F.col("shard"), F.col("block"))
    # a query is told by its block and its place there, not by its id

    def search(batches):
        for batch in batches:
            for block, ids, vectors, query_ids, query_vectors in zip(*[batch.column(c).to_pylist() for c in ("block", "ids", "vectors", "query_ids", "query_vectors")]):
                ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64)
                x, q = np.frombuffer(vectors).reshape(len(ids), -1), np.frombuffer(query_vectors).reshape(len(query_ids), -1)
                if not x.shape[1] == q.shape[1]:
                    continue
                k, found, score = search_shard(ids, x, query_ids, q, top_norm)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), block)), pa.array(k), pa.array(query_ids[k]), pa.array(found), pa.array(score)], ["block", "place", "query_id", "found", "score"])

    found = work.select("block", "ids", "vectors", "query_ids", "query_vectors").mapInArrow(search, "block long, place long, query_id long, found long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "found")))
    return ranked.where(F.col("rank") <= NEIGHBOURS).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(key), "score")
