"""Exact removal of long repeats with sparse suffix arrays in a logarithmic index family.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id. Suffixes are sampled
at anchors: the K-mer with the smallest hash in every window of LENGTH bytes. Equal windows have the same anchor at the same
offset, so a sparse array over about one suffix in sixteen finds every match. The windows that share an anchor occurrence
form its context, one contiguous stretch of text.

1. Documents are packed into batches. A batch orders its contexts by (anchor, context) and keeps, of equal ones, those of the
   smallest id; larger ids are repeats already. What is left travels packed to the shards of the anchor space, so a passage
   of a million copies sends one entry per batch. A shard merges the sorted arrays: a context that a smaller id has as a
   whole is a repeat; contexts that share only the anchor are asked for.
2. The batches send those contexts as text. Here batches get suffix arrays of the contexts' windows, each merge-scanned
   against the existing levels for matches of LENGTH bytes; levels of about equal size merge geometrically. Within a
   string only the smallest id stays, comparisons are of bytes.
3. The removed windows come back to the batches, which cut their texts.

Batches are written to the shared folder once, so their ids and orders are the same in every step and after a retry. Hashes
decide in step 1 only (40 + 40 bits beside the shard); no pair of occurrences is ever formed.

Defined results: null text is empty. Texts shorter than LENGTH are kept whole. Rows without an id are kept whole and remove
nothing; repeated ids do not remove each other. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallyline.llm import vector
from tallyline.session import pin

LENGTH = 50
K = 20
BATCH = 8_000_000  # bytes of text in a batch (a longer text is one batch)
SHARD_BYTES = 64_000_000  # of text whose contexts make a shard, which a task holds as a whole: about four million of them
CHUNK = 1 << 20  # bytes scanned at once
PLACE = np.uint64((1 << 21) - 1)  # low bits that hold a position inside a chunk
RUN = 100_000  # windows that make a batch of the index family
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_TABLES: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _TABLES or len(_TABLES[base]) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _TABLES[base] = np.multiply.accumulate(steps)
    return _TABLES[base]


def scan(data: np.ndarray, bounds: np.ndarray):
    """(first window, last window, anchor hash, context hash) of all contexts; windows are numbered by their first byte."""
    n = len(data)
    if n < LENGTH:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
    words = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    grams = words[: n - K + 1] * np.uint64(0xD6E8FEB86659FD93)
    grams ^= (words[8: n - K + 9] * np.uint64(0xA0761D6478BD642F)) >> np.uint64(7)
    grams += words[12: n - K + 13] * np.uint64(0xE7037ED1A0B428DB)
    grams = vector.mix(grams)
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    inner = bounds[1:-1]
    for k in range(1, K):
        at = inner - k
        low[at[(at >= 0) & (at < len(low))]] = TOP
    for wide in (1, 2, 4, 8):
        low = np.minimum(low[:-wide], low[wide:])
    windows = n - LENGTH + 1
    reach = LENGTH - K + 1 - 16
    anchor = (np.minimum(low[:windows], low[reach: reach + windows]) & PLACE).astype(np.int64)
    for k in range(1, LENGTH):
        at = inner - k
        anchor[at[(at >= 0) & (at < windows)]] = -1
    begins = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], windows) - 1
    real = anchor[first] >= 0
    first, last = first[real], last[real]
    at = anchor[first]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(vector._BYTE[data] * _powers(STEP, n)[:n], out=sums[1:])
    whole = (sums[last + LENGTH] - sums[first]) * _powers(BACK, n)[first]
    context = vector.mix(vector.mix(whole) + (at - first).astype(np.uint64) * np.uint64(STEP) + (last - first).astype(np.uint64))
    return first, last, vector.mix(grams[at] + np.uint64(STEP)), context


def contexts(data: np.ndarray, bounds: np.ndarray):
    """``scan`` over a batch, chunk by chunk; a text longer than a chunk is cut with an overlap, which splits contexts only."""
    parts = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64, np.uint64)]
    row = 0
    while row < len(bounds) - 1:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK, "right")) - 1)
        start, stop = int(bounds[row]), int(bounds[end])
        for at in range(start, max(stop - LENGTH + 1, start + 1), CHUNK):
            cut = min(stop, at + CHUNK + LENGTH - 1)
            found = scan(data[at:cut], bounds[row: end + 1] - at if end > row + 1 else np.array([0, cut - at]))
            for part, x, shift in zip(parts, found, (at, at, 0, 0)):
                part.append(x + shift if shift else x)
        row = end
    return [np.concatenate(p) for p in parts]


class Batch:
    """The contexts of a batch, equal ones of larger ids marked, one representative of each of the rest in packing order."""

    def __init__(self, payload: bytes, ids: bytes, real: bytes, sizes: bytes, shards: int):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
        self.ids, self.real = np.frombuffer(ids, np.int64), np.frombuffer(real, bool)
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        if not shards:
            return
        first, last, anchor, context = contexts(self.data, self.bounds)
        row = np.searchsorted(self.bounds, first, "right") - 1
        keep = self.real[row]
        first, last, anchor, context, doc = first[keep], last[keep], anchor[keep], context[keep], self.ids[row[keep]]
        both = vector.mix(anchor + vector.mix(context))
        order = np.lexsort((doc, both))
        both, doc = both[order], doc[order]
        head = np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        low = doc[head]
        repeat = doc > low[group]
        self.first, self.last = first[order], last[order]
        self.repeats = np.flatnonzero(repeat)
        at = np.flatnonzero(head)
        shard = (((anchor[order][at] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
        packing = np.lexsort((low, shard))
        self.rep, self.shard, self.doc = at[packing], shard[packing], low[packing]
        self.anchor, self.context = anchor[order][self.rep], context[order][self.rep]
        # members of each representative's group that are not repeats: the same text in the same document id
        self.group_of_rep, self.same = group[self.rep], np.flatnonzero(~repeat)
        self.same_group = group[self.same]
        self.cuts = np.searchsorted(self.shard, np.arange(shards + 1))

    def members(self, reps: np.ndarray) -> np.ndarray:
        wanted = np.zeros(int(self.same_group.max()) + 1 if len(self.same_group) else 0, bool)
        wanted[self.group_of_rep[reps]] = True
        return self.same[wanted[self.same_group]]


STAGED = "batch long, payload binary, ids binary, real binary, sizes binary"


def stage(batches):
    """Rows of STAGED from (id, text): texts packed and compressed, about BATCH bytes each."""
    texts, ids, held = [], [], 0

    def flush():
        real = np.array([i is not None for i in ids], bool)
        numbers = np.array([0 if i is None else i for i in ids], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        packed = zstandard.ZstdCompressor(level=6).compress(b"".join(texts))
        values = [uuid.uuid4().int >> 65, packed, numbers.tobytes(), real.tobytes(), sizes.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(values)], [f.split()[0] for f in STAGED.split(", ")])

    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if held and held + len(raw) > BATCH:
                yield flush()
                texts, ids, held = [], [], 0
            texts.append(raw)
            ids.append(i)
            held += len(raw)
    if ids:
        yield flush()


ENTRIES = "shard int, batch long, a_low binary, a_high binary, c_low binary, c_high binary, docs binary, counts binary"


def send_entries(batches, shards: int):
    """Per batch and shard: 40 bits of the anchor, 40 of the context, the documents' ids with their counts."""
    for table in batches:
        for name, *packed in zip(*[table.column(c).to_pylist() for c in ("batch", "payload", "ids", "real", "sizes")]):
            b = Batch(*packed, shards)
            rows = []
            for shard in np.flatnonzero(np.diff(b.cuts)):
                part = slice(b.cuts[shard], b.cuts[shard + 1])
                docs, counts = np.unique(b.doc[part], return_counts=True)
                a, c = b.anchor[part], b.context[part]
                rows.append((int(shard), name, a.astype(np.uint32).tobytes(), (a >> np.uint64(32)).astype(np.uint8).tobytes(), c.astype(np.uint32).tobytes(),
                             (c >> np.uint64(32)).astype(np.uint8).tobytes(), docs.tobytes(), counts.astype(np.uint32).tobytes()))
            if rows:
                yield _rows(rows, ENTRIES)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


FLAGS = "batch long, shard int, repeats binary, asked binary"


def merge_entries(table: pa.Table) -> pa.Table:
    """Of one shard: the entries whose context a smaller id has, and those that share their anchor with other contexts."""
    blobs = {c: [np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (
        ("a_low", np.uint32), ("a_high", np.uint8), ("c_low", np.uint32), ("c_high", np.uint8), ("docs", np.int64), ("counts", np.uint32))}
    sizes = [len(x) for x in blobs["a_low"]]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    anchor = np.concatenate(blobs["a_high"]).astype(np.int64) << 32 | np.concatenate(blobs["a_low"])
    context = np.concatenate(blobs["c_high"]).astype(np.int64) << 32 | np.concatenate(blobs["c_low"])
    doc = np.repeat(np.concatenate(blobs["docs"]), np.concatenate(blobs["counts"]))
    del blobs
    order = np.argsort(anchor, kind="stable")
    sorted_ = anchor[order]
    shared = np.zeros(len(order), bool)
    same = sorted_[1:] == sorted_[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    order = order[np.lexsort((doc[order], context[order], anchor[order]))]
    a, c, d = anchor[order], context[order], doc[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
    new_c = new_a.copy()
    if len(a):
        new_c[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new_c)
    repeat = d > d[starts][np.cumsum(new_c) - 1] if len(a) else np.zeros(0, bool)
    kinds = np.add.reduceat(new_c, np.flatnonzero(new_a)) if len(a) else np.zeros(0, np.int64)
    asked = ~repeat & (kinds[np.cumsum(new_a) - 1] > 1) if len(a) else np.zeros(0, bool)
    out, shard = [], int(table.column("shard")[0].as_py())
    flagged = [np.sort(order[x]) for x in (repeat, asked)]
    for name, low, high in zip(table.column("batch").to_pylist(), offsets[:-1], offsets[1:]):
        r, q = ((x[np.searchsorted(x, low): np.searchsorted(x, high)] - low).astype(np.uint32) for x in flagged)
        if len(r) or len(q):
            out.append((name, shard, r.tobytes(), q.tobytes()))
    if not out:
        return _rows([(0, 0, b"", b"")], FLAGS).slice(0, 0)
    return pa.Table.from_batches([_rows(out, FLAGS)])


SENT = "shard int, batch long, low binary, high binary, docs binary, texts binary"


def send_contexts(batches, shards: int):
    """Per batch: the windows known to be repeats (shard -1), and per shard the contexts asked for, with their text."""
    for table in batches:
        for name, payload, ids, real, sizes, flags in zip(*[table.column(c).to_pylist() for c in ("batch", "payload", "ids", "real", "sizes", "flags")]):
            b = Batch(payload, ids, real, sizes, shards)
            repeats, rows = [b.repeats], []
            for flag in flags or []:
                start = b.cuts[flag["shard"]]
                repeats.append(b.members(start + np.frombuffer(flag["repeats"], np.uint32).astype(np.int64)))
                asked = b.rep[start + np.frombuffer(flag["asked"], np.uint32).astype(np.int64)]
                if len(asked):
                    # every occurrence in the document: its own windows have to be cut as well
                    asked = b.members(start + np.frombuffer(flag["asked"], np.uint32).astype(np.int64))
                    asked = asked[np.argsort(b.first[asked], kind="stable")]
                    low, high = b.first[asked], b.last[asked]
                    text = b"".join(b.data[x: y + LENGTH].tobytes() for x, y in zip(low.tolist(), high.tolist()))
                    docs = b.ids[np.searchsorted(b.bounds, low, "right") - 1]
                    rows.append((flag["shard"], name, low.astype(np.uint32).tobytes(), high.astype(np.uint32).tobytes(), docs.tobytes(), zstandard.ZstdCompressor(level=3).compress(text)))
            known = np.concatenate(repeats)
            if len(known):
                low, high = join_ranges(b.first[known], b.last[known])
                rows.append((-1, name, low.astype(np.uint32).tobytes(), high.astype(np.uint32).tobytes(), b"", b""))
            if rows:
                yield _rows(rows, SENT)


def join_ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges of windows, adjacent and overlapping ones joined."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1] + 1])
    return low[new], high[np.append(np.flatnonzero(new)[1:], len(low)) - 1]


class Levels:
    """Suffix arrays of geometrically growing size. ``add`` takes a new array and returns the occurrences that lose.

    An array holds (string, id, occurrence) sorted by string; of a string only the occurrences of its smallest id are alive.
    """

    def __init__(self):
        self.levels: list = []

    @staticmethod
    def smallest(strings, docs, places):
        """The occurrences of every string's smallest id, and the others. ``strings`` are sorted."""
        new = np.concatenate([[True], strings[1:] != strings[:-1]])
        low = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
        alive = docs == low
        return (strings[alive], docs[alive], places[alive]), places[~alive]

    def add(self, strings: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        if not len(strings):
            return places
        order = np.argsort(strings, kind="stable")
        run, lost = self.smallest(strings[order], docs[order], places[order])
        lost = [lost]
        for k, (s, d, p) in enumerate(self.levels):
            if not len(s) or not len(run[0]):
                continue
            # merge scan: equal strings of the new array and the level, smaller id stays
            at = np.minimum(np.searchsorted(s, run[0]), len(s) - 1)
            met = s[at] == run[0]
            beaten = met & (d[at] < run[1])
            lost.append(run[2][beaten])
            back = np.minimum(np.searchsorted(run[0], s), len(run[0]) - 1)
            worse = (run[0][back] == s) & (run[1][back] < d)
            lost.append(p[worse])
            self.levels[k] = (s[~worse], d[~worse], p[~worse])
            run = tuple(x[~beaten] for x in run)
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            last, before = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(before, last)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append(tuple(x[order] for x in both))
        return np.concatenate(lost)


def meet_contexts(table: pa.Table) -> pa.Table:
    """Of one shard: the windows (batch, ranges) whose string a smaller id has."""
    names, low, high, docs, texts = [], [], [], [], []
    for k, (name, *packed) in enumerate(zip(*[table.column(c).to_pylist() for c in ("batch", "low", "high", "docs", "texts")])):
        lo = np.frombuffer(packed[0], np.uint32).astype(np.int64)
        names.append(name)
        low.append(lo)
        high.append(np.frombuffer(packed[1], np.uint32).astype(np.int64))
        docs.append(np.frombuffer(packed[2], np.int64))
        texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[3]), np.uint8))
    batch_of = np.repeat(np.arange(len(low)), [len(x) for x in low])
    low, high, docs, text = (np.concatenate(x) for x in (low, high, docs, texts))
    windows = high - low + 1
    begin = np.concatenate([[0], np.cumsum(windows + LENGTH - 1)])[:-1]  # of each context in the text
    own = np.repeat(np.arange(len(low)), windows)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[own] + inside
    # strings that cannot be equal to another one are left out by a hash; equality itself is decided by the bytes
    words = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), strides=(1,))
    hashed = np.zeros(len(at), np.uint64)
    for k in (0, 8, 16, 24, 32, 40, 42):
        hashed = vector.mix(hashed ^ words[at + k])
    order = np.argsort(hashed, kind="stable")
    twice = np.zeros(len(at), bool)
    same = hashed[order][1:] == hashed[order][:-1]
    twice[1:] |= same
    twice[:-1] |= same
    places = np.sort(order[twice])
    del hashed, order, words
    every = np.ndarray((len(text) - LENGTH + 1,), f"S{LENGTH}", np.ascontiguousarray(text), strides=(1,))
    family, lost = Levels(), []
    for k in range(0, len(places), RUN):
        part = places[k: k + RUN]
        lost.append(family.add(every[at[part]], docs[own[part]], part))
    gone = np.sort(np.concatenate(lost)) if lost else np.zeros(0, np.int64)
    rows = []
    edges = np.searchsorted(batch_of[own[gone]], np.arange(len(names) + 1))
    for k, name in enumerate(names):
        part = gone[edges[k]: edges[k + 1]]
        if len(part):
            window = low[own[part]] + inside[part]
            rows.append((name, *(x.astype(np.uint32).tobytes() for x in join_ranges(window, window))))
    schema = "batch long, low binary, high binary"
    if not rows:
        return pa.Table.from_batches([_rows([(0, b"", b"")], schema)]).slice(0, 0)
    return pa.Table.from_batches([_rows(rows, schema)])


def cut(batches, key: str):
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of the batches."""
    for table in batches:
        for payload, ids, real, sizes, ranges in zip(*[table.column(c).to_pylist() for c in ("payload", "ids", "real", "sizes", "ranges")]):
            b = Batch(payload, ids, real, sizes, 0)
            steps = np.zeros(len(b.data) + 1, np.int32)
            for r in ranges or []:
                np.add.at(steps, np.frombuffer(r["low"], np.uint32).astype(np.int64), 1)
                np.add.at(steps, np.frombuffer(r["high"], np.uint32).astype(np.int64) + LENGTH, -1)
            gone = np.cumsum(steps[:-1]) > 0
            out = []
            for k, (x, y) in enumerate(zip(b.bounds[:-1].tolist(), b.bounds[1:].tolist())):
                g = gone[x:y]
                spans = int((g[1:] > g[:-1]).sum() + g[0]) if y > x else 0
                kept = b.data[x:y][~g].tobytes()
                out.append((int(b.ids[k]) if b.real[k] else None, y - x, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                if len(out) == 500 or k == len(b.ids) - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                    out = []


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` is what is left, as bytes."""
    spark = docs.sparkSession
    vector.small_batches(spark)
    shards = vector.shard_count(docs, text, SHARD_BYTES)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    staged = pin(rows.mapInArrow(stage, STAGED), "text-batches")
    entries = staged.mapInArrow(lambda b: send_entries(b, shards), ENTRIES)
    flags = entries.groupBy("shard").applyInArrow(merge_entries, FLAGS)
    flags = flags.groupBy("batch").agg(F.collect_list(F.struct("shard", "repeats", "asked")).alias("flags"))
    sent = pin(staged.join(flags.hint("merge"), "batch", "left").mapInArrow(lambda b: send_contexts(b, shards), SENT), "contexts")
    met = sent.where("shard >= 0").groupBy("shard").applyInArrow(meet_contexts, "batch long, low binary, high binary")
    ranges = sent.where("shard < 0").select("batch", "low", "high").union(met)
    ranges = ranges.groupBy("batch").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return staged.join(ranges.hint("merge"), "batch", "left").mapInArrow(
        lambda b: cut(b, key), f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
