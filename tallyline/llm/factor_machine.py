"""Toxicity: a factorisation machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), x_i = 1 where term i occurs. The pair weights let an
insult and a group mention count together for more than their sum. Terms are hashed to 2^20 ids; those of the labelled sample
whose share differs between the classes (``Z`` standard errors; the ``max_terms`` largest differences) enter the model.

The fit takes at most ``labelled_rows`` labelled documents (those with the smallest hash of the id), gathered in one task;
everything is scored. Only the text is an input. Defined results: null and empty texts get the model's base rate; without
labels of both classes every score is the mean label (0 without any). A document labelled twice is toxic if one label is.
Repeated rows are scored each, rows with equal texts alike. Very long texts are hashed whole, one at a time. Terms of equal
difference enter in the order of their hash. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyline.llm import vector

TERM_BITS = 20
LABELLED_ROWS = 20_000
TERMS = 4096
Z = 3.0
FACTORS = 4
EPOCHS = 30


def term_ids(texts: pa.Array):
    """Per row: the sorted distinct hashed terms of the whole text."""
    for _, data, bounds in vector.pieces(texts):
        words, rows = vector.word_hashes(data, bounds, inside=vector.ALNUM)
        ids = (words >> np.uint64(64 - TERM_BITS)).astype(np.uint32)
        for a, b in zip(rows[:-1], rows[1:]):
            yield np.unique(ids[a:b])


def fit(samples: list[np.ndarray], labels: np.ndarray, seed: int = 3, max_terms: int = TERMS) -> tuple:
    """(ids, b, w, v) by AdaGrad on the log loss with L2."""
    rate = float(labels.mean()) if len(labels) else 0.0
    base = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    none = (np.zeros(0, np.uint32), base, np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < rate < 1:
        return none
    flat = np.concatenate(samples) if samples else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(samples)), [len(s) for s in samples])
    toxic = np.bincount(flat, labels[row], 1 << TERM_BITS)
    seen = np.bincount(flat, minlength=1 << TERM_BITS)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    p = (seen + 0.5) / (len(labels) + 1)
    z = np.abs(toxic / n1 - (seen - toxic) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    z[seen < 3] = 0
    ids = np.flatnonzero(z >= Z)
    ids = np.sort(ids[np.argsort(-z[ids], kind="stable")[:max_terms]]).astype(np.uint32)
    if not len(ids):
        return none
    at = np.searchsorted(ids, flat)
    there = ids[np.minimum(at, len(ids) - 1)] == flat
    col, row = at[there], row[there]
    start = np.searchsorted(row, np.arange(len(samples) + 1))
    rng = np.random.default_rng(seed)
    b, w, v = base, np.zeros(len(ids)), rng.normal(0, 0.05, (len(ids), FACTORS))
    gb, gw, gv = 1e-8, np.full(len(ids), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for k in range(0, len(order), 256):
            part = order[k: k + 256]
            sizes = start[part + 1] - start[part]
            own = np.repeat(np.arange(len(part)), sizes)
            c = col[np.repeat(start[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            sums = np.stack([np.bincount(own, v[c, f], len(part)) for f in range(FACTORS)], 1)
            squares = np.bincount(own, (v[c] ** 2).sum(1), len(part))
            margin = b + np.bincount(own, w[c], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
            d_w = np.bincount(c, error[own], len(ids)) + 1e-5 * w
            d_v = np.stack([np.bincount(c, error[own] * (sums[own, f] - v[c, f]), len(ids)) for f in range(FACTORS)], 1) + 1e-4 * v
            d_b = error.sum()
            gb, gw, gv = gb + d_b**2, gw + d_w**2, gv + d_v**2
            b, w, v = b - 0.1 * d_b / np.sqrt(gb), w - 0.2 * d_w / np.sqrt(gw), v - 0.05 * d_v / np.sqrt(gv)
    return ids, float(b), w, v


def margins(model: tuple, terms: np.ndarray) -> float:
    ids, b, w, v = model
    if not len(ids) or not len(terms):
        return b
    at = np.searchsorted(ids, terms)
    c = at[ids[np.minimum(at, len(ids) - 1)] == terms]
    return b + w[c].sum() + 0.5 * ((v[c].sum(0) ** 2).sum() - (v[c] ** 2).sum())


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, label_key: str, labelled_rows: int, max_terms: int = TERMS) -> tuple:
    """The model, fitted in one task on the bounded sample."""
    chosen = labels.groupBy(F.col(label_key).alias("id")).agg(F.max(label).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(labelled_rows)  # bounded, hence the broadcast
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "y", F.xxhash64("id", "text").alias("h"))

    def terms(batches):
        for batch in batches:
            blobs = [t.tobytes() for t in term_ids(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column("y"), batch.column("h")], ["terms", "y", "h"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("y", "ascending")])
        samples = [np.frombuffer(x, np.uint32) for x in table.column("terms").to_pylist()]
        ids, b, w, v = fit(samples, table.column("y").to_numpy(), max_terms=max_terms)
        return pa.table({"ids": pa.array([ids.tobytes()], pa.binary()), "b": [b], "w": pa.array([w.tobytes()], pa.binary()), "v": pa.array([v.tobytes()], pa.binary())})

    gathered = rows.mapInArrow(terms, "terms binary, y double, h long").selectExpr("*", "int(y IS NULL) AS all").groupBy("all")
    found = gathered.applyInArrow(learn, "ids binary, b double, w binary, v binary").first()
    if found is None:
        return fit([], np.zeros(0))
    return np.frombuffer(found.ids, np.uint32), found.b, np.frombuffer(found.w), np.frombuffer(found.v).reshape(-1, FACTORS)


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", label_key: str = "doc_id",
                   labelled_rows: int = LABELLED_ROWS, max_terms: int = TERMS) -> DataFrame:
    """(key, score, predicted) of every row. ``labels`` holds the rows that may be learned from."""
    vector.small_batches(docs.sparkSession)
    model = train(docs, labels, key, text, label, label_key, labelled_rows, max_terms)
    wanted = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def score(batches):
        for batch in batches:
            margin = np.array([margins(model, t) for t in term_ids(batch.column("text"))])
            chance = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    kind = wanted.schema["key"].dataType.simpleString()
    return wanted.mapInArrow(score, f"`{key}` {kind}, score double, predicted int")


def held_out(key: str) -> str:
    """Rows that are never learned from: a fifth by the checksum of the id."""
    return f"crc32(binary(string(`{key}`))) % 5 = 0"
