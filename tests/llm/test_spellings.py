import random
import re
import zlib
from collections import Counter

import pytest

from tallyline.llm import spellings


def run(spark, rows, schema="doc_id long, text string", **settings):
    counted = spellings.count_words(spark.createDataFrame(rows, schema), **settings)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spellings.group_spellings(counted).collect()}


def counted(rows, noise):
    words = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                words[w] += 1
    return {w: n for w, n in words.items() if n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute(rows, noise=None):
    words, out = counted(rows, noise), {}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 2 * n else None, n, len(near))
    done = {}
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        done[w] = (form, root, n, near, out[form][1] if form else None)
    return done


def corpus(seed, letters="abÀÿ", docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(25)]
    def word():
        w = list(rng.choices(stems, [1 / (k + 1) for k in range(len(stems))])[0])
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(w))
            w[k: k + rng.choice([0, 1])] = rng.choice([[], [rng.choice(letters)], [w[k], w[k]]])
        return "".join(w) or "x"
    return [(i, ", ".join(word() if rng.random() < 0.9 else word().upper() for _ in range(80))) for i in range(docs)]


@pytest.mark.parametrize("seed,noise", [(0, None), (1, 7), (2, 1)])
def test_against_brute_force(spark, monkeypatch, seed, noise):
    monkeypatch.setattr(spellings, "FLUSH", 300)
    rows = corpus(seed)
    got, want = run(spark, rows, noise=noise), brute(rows, noise)
    assert got == want
    assert any(root != form for form, root, *_ in got.values() if form) and max(v[3] for v in got.values()) >= 10


def test_groups_over_batches(spark):
    """A group may begin in one Arrow batch and end in the next."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = corpus(3, docs=30)
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_words_nulls_repeats_and_clashing_columns(spark):
    long = "ab" * 20_000
    text = f"{long} {long} {long} {long[:-1]} {long[:-1]} {long[:-1]} {long}x aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa ×÷Àabc"
    rows = [(1, text, "w", 1), (1, text, "w", 1), (2, None, "w", 1), (3, "", "w", 1), (None, "hello Hello HELLO hÉllo, hell0 12345", "w", 1), (4, "1 2 3 ...", None, None)]
    got = run(spark, rows, "doc_id long, text string, word string, n int")
    assert got == brute(rows) and got[long[:-1]][3] == 1 and got["aaaaa"][3] == 1
    assert got["hello"] == (None, "hello", 3, 0, None)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(1, None), (2, "a b c")]) == {}
