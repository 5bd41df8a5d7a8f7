import hashlib
import random

import numpy as np

from tallyline.llm import suffix_dedup


def brute(rows):
    low = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        if i is not None:
            for s in range(len(t) - 49):
                low[t[s:s + 50]] = min(low.get(t[s:s + 50], i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for s in range(len(t) - 49):
                if low[t[s:s + 50]] < i:
                    gone[s:s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((str(i), len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)]
    out = []
    for _ in range(120):
        parts = [rng.choice(pool)[rng.randint(0, 30):] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        out.append(" ".join(parts))
    return out + [None, "", "x" * 49, "x" * 50, "x" * 51, "ab" * 200, "ab" * 30, "\0" * 80, "\0" * 60, "é" * 40, "z" + "é" * 40]


def test_against_brute_force(spark):
    all_texts = texts(1)
    ids = list(range(len(all_texts)))
    random.Random(2).shuffle(ids)
    rows = list(zip(ids, all_texts)) + [(None, all_texts[5]), (3, all_texts[7]), (3, all_texts[7]), (5000, all_texts[8])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute(rows)


def test_many_small_batches_and_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    rows = [(i, long[rng.randint(0, 900): rng.randint(1000, 3000)] + str(i)) for i in range(12)]
    cut = suffix_dedup.contexts(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    parts = suffix_dedup.contexts(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))
    # chunks split contexts but every window stays in exactly one, with the same anchor
    windows = lambda c: [(w, int(a)) for lo, hi, a, _ in zip(*c) for w in range(lo, hi + 1)]
    assert windows(cut) == windows(parts) and len(windows(cut)) == 2951
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute(rows)


def test_levels_against_a_dictionary():
    rng = np.random.default_rng(1)
    family, lost, seen = suffix_dedup.Levels(), [], []
    for k in range(40):
        n = int(rng.integers(1, 60))
        strings, docs = np.array([f"s{x}".encode() for x in rng.integers(0, 90, n)], "S50"), rng.integers(0, 50, n)
        places = np.arange(len(seen), len(seen) + n)
        seen += list(zip(strings.tolist(), docs.tolist()))
        lost += family.add(strings, docs, places).tolist()
    low = {}
    for s, d in seen:
        low[s] = min(d, low.get(s, d))
    assert sorted(lost) == [k for k, (s, d) in enumerate(seen) if d > low[s]]
    assert len(family.levels) <= 12


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_follow_the_texts(spark, monkeypatch):
    """Shards from the counted bytes, and a text beyond one batch."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "BATCH", 20_000)
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = list(enumerate(texts(4))) + [(400, long), (401, long[5_000:9_000] + "!" + long[20_000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute(rows)
