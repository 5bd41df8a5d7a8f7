import random

import numpy as np

from tallyline.llm import importance, vector


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    parts = ["er", "in", "an", "the", "on", "sh", "ly", "ti"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        bad = i % 7 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "s"))
        if i % 2:
            labels.append((i, int(not bad)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, target string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_junk_goes_and_clean_stays(spark):
    rows, labels = corpus()
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "x" * 300_000, "s"), (1, rows[1][1], "s")]
    kept = [r.doc_id for r in importance.resample(*frames(spark, rows, labels)).collect()]
    clean = {i for i, *_ in rows if i < 400 and i % 7}
    assert len(clean - set(kept)) <= 2 and len({i for i in kept if i < 400} - clean) <= 1
    assert kept.count(1) == 2


def test_weights_against_brute_force(spark):
    rows, labels = corpus(60)
    docs, marks = frames(spark, rows, labels)
    sample = importance.label_sample(marks, "quality", "doc_id", 100)
    got = {r.doc_id: r for r in importance.weigh(docs, sample).collect()}
    good = {i for i, q in labels if q}
    context = lambda a, b: ((a << 8 | b) * 0x9E3779B1 % 2**32) >> (32 - importance.CONTEXT_BITS)
    grams = lambda t: [context(*t[k:k + 2]) << 7 | t[k + 2] & 127 for k in range(len(t) - 2)]
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, t, _ in rows:
        for g in grams(t.encode()):
            raw[g] += 1
            target[g] += i in good
    for i, t, _ in rows[:20]:
        want = 0.0
        for g in grams(t.encode()):
            c = slice(g >> 7 << 7, (g >> 7 << 7) + 128)
            p = raw[g] / raw[c].sum()
            want += np.log((target[g] + importance.SHRINK * p) / (target[c].sum() + importance.SHRINK) / p)
        assert got[i].n_grams == max(0, len(t) - 2) and abs(got[i].log_weight - want) < 1e-5 * max(1, abs(want))


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(importance, "EXACT_ROWS", 5)
    rows, labels = corpus(120)
    rows += [(7, rows[7][1], "s")] * 3
    docs, marks = frames(spark, rows, labels)
    every = importance.resample(docs, marks, k=len(rows)).collect()
    for k in (0, 1, 50, len(rows) - 1):
        got = importance.resample(docs, marks, k=k).collect()
        assert k <= len(got) <= k + 3 if k else not got  # identical rows stand or fall together
        assert not got or min(r.noisy for r in got) >= sorted((r.noisy for r in every), reverse=True)[k - 1]


def test_no_labels_and_no_rows(spark):
    rows, _ = corpus(20)
    assert importance.resample(*frames(spark, rows, [])).count() == 20
    assert importance.resample(*frames(spark, [], [(1, 1)])).count() == 0


def test_runs_of_words():
    data = np.frombuffer(b"a b c d e f  g\nx y", np.uint8)
    words, rows = vector.word_hashes(data, np.array([0, 12, 12, 14, 18]))
    assert rows.tolist() == [0, 6, 6, 7, 9]
    runs, first = vector.run_hashes(words, rows, 5)
    assert first.tolist() == [0, 2, 2, 3, 4] and len(set(runs.tolist())) == 4
