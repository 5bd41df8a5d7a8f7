"""Vectorised word hashing for Arrow batches: whole texts, a few million bytes at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

PIECE = 2_000_000  # bytes of text that are worked on at once (a longer text is one piece)
ARROW_ROWS = "500"

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_RUN = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.ones(256, bool)  # True: part of a word
SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def shard_count(docs, text: str, bytes_per_shard: int) -> int:
    """Shards for what is made of all texts: as many as shuffle partitions, more where a shard would come from more bytes."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_per_shard))


def small_batches(spark) -> None:
    """Texts are long: fewer rows in an Arrow batch than Spark's default, so that a task's memory stays bounded."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 2 * len(_POWERS)), _STEP, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def pieces(texts: pa.Array):
    """(first row, bytes, bounds): consecutive rows of about PIECE bytes; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        bounds = offsets[row: end + 1]
        yield row, data[bounds[0]: bounds[-1]], bounds - bounds[0]
        row = end


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True, inside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every row and the total): words are runs of bytes that ``inside`` marks."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    word = inside[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    begins[firsts] = word[firsts]  # a word never crosses rows
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    at = np.flatnonzero(word)
    own = np.cumsum(begins)[at] - 1
    place = at - starts[own]
    terms = _BYTE[data[at]] * powers(int(place.max()) + 1)[place]
    sums = np.add.reduceat(terms, np.searchsorted(at, starts))
    return mix(sums), rows


def run_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a row, and the first run of every row. A shorter row with words is one run."""
    counts = np.diff(rows)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(rows[:-1] - first[:-1], runs) + np.arange(first[-1])
    last = np.repeat(rows[1:], runs)
    total = np.zeros(len(begin), np.uint64)
    for k in range(n):
        there = begin + k < last
        total += np.where(there, words[np.minimum(begin + k, max(len(words) - 1, 0))] * _RUN[k] + _RUN[k + 8], 0) if len(words) else total
    return mix(total), first
