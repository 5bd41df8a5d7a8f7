import random

import pytest

from tallyline.llm import jaccard_join


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and sets[x][0] is not None and sets[y][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                root[find(x)] = find(y)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((str(i), len(s), None if i is None else low[find(k)]) for k, (i, s) in enumerate(sets))


def texts(seed, n=140):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = " ".join(word() for _ in range(40))
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.5:
            words = rng.choice(out[-12:]).split(" ")
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                at = rng.randrange(max(1, len(words)))
                words[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            out.append(" ".join(words))
        else:
            out.append(" ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 8, 11, 20, 40, 90, 200]))) + (" " + passage if kind > 0.8 else ""))
    return out


@pytest.mark.parametrize("group", [16, 3])
def test_against_brute_force(spark, group):
    rows = list(enumerate(texts(group)))
    rows += [(900 + i, rows[20][1].upper()) for i in range(6)] + [(950, None), (951, ""), (952, " \n\t "), (953, "one"), (954, "ONE"), (None, rows[3][1]), (5, rows[9][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.join_similar(docs, group=group).collect())
    want = brute(rows)
    same = {i for i, _, _ in want if [x for x, _, _ in want].count(i) == 1}
    assert [g for g in got if g[0] in same] == [w for w in want if w[0] in same]
    assert [(i, n) for i, n, _ in got] == [(i, n) for i, n, _ in want]


def test_empty(spark):
    assert jaccard_join.join_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_follow_the_texts(spark, monkeypatch):
    """More shards than shuffle partitions, a very long text and its near copy among them."""
    monkeypatch.setattr(jaccard_join, "SHARD_BYTES", 20_000)
    rng = random.Random(8)
    long = [f"v{rng.randrange(3000)}" for _ in range(120_000)]
    other = long[:]
    for _ in range(1500):
        other[rng.randrange(len(other))] = "x"
    rows = list(enumerate(texts(5, 60))) + [(700, " ".join(long)), (701, " ".join(other)), (702, " ".join(long[:100]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard_join.vector.shard_count(docs, "text", 20_000) > 60
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.join_similar(docs).collect())
    assert got == brute(rows) and ("701", len(shingles(rows[61][1])), 700) in got
