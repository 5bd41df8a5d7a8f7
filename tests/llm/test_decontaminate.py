import random
from collections import Counter

from tallyline.llm import decontaminate


def shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, it in items:
            x = (it or "").lower().split()
            if not x or not w:
                continue
            want, best = shingles(x), 0.0
            for s in range(max(1, len(w) - len(x) + 1)):
                part = w[s:s + len(x)]
                if len(part) < len(x) and len(part) < 5:
                    continue
                got = Counter(tuple(part[k:k + min(5, len(x))]) for k in range(len(part) - min(5, len(x)) + 1))
                both = sum((got & want).values())
                best = max(best, both / (sum(got.values()) + sum(want.values()) - both))
            if best >= 0.75:
                out[d, i] = round(best, 9)
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(1, 40)))) for i in range(30)] + [(30, ""), (31, None), (32, "a b a b a b a b a b"), (33, "one")]
    items += [(34, items[5][1]), (5, items[5][1])]
    docs = []
    for d in range(80):
        w = text(rng.randint(0, 120))
        if d % 2:
            x = rng.choice(items)[1] or ""
            x = x.split()
            if d % 4 == 3 and len(x) > 8:
                x = x[rng.randint(0, 3): len(x) - rng.randint(0, 3)]
            at = rng.randint(0, len(w))
            w = w[:at] + x + w[at:]
        docs.append((d, " ".join(w).upper() if d % 3 else "\n".join(w)))
    docs += [(100, None), (101, ""), (102, "One"), (103, "a b a b a b a b a b a b"), (1, docs[1][1]), (None, items[7][1])]
    spec = "doc_id long, text string, item long"
    got = decontaminate.contaminated(
        spark.createDataFrame([(*d, 1) for d in docs], spec), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"))
    rows = got.collect()
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}
    want = brute(docs, items)
    assert set(found) <= set(want)
    missed = {k: v for k, v in want.items() if k not in found}
    assert not missed, missed
    assert found == want and len(rows) == len(found)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.contaminated(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_edited_items_are_found(spark):
    """Items whose last words are replaced, down to a similarity just above the limit, and long texts around them."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items, docs, want = [], [], set()
    for n in (12, 40, 120, 200):
        for _ in range(60):
            words, i = text(n), len(items)
            items.append((i, " ".join(words)))
            gone = max(k for k in range(n) if (n - 4 - k) / (n - 4 + k) >= 0.75)
            edited = words[: n - gone] + [f"x{rng.randrange(5000)}" for _ in range(gone)]
            docs.append((i, " ".join(text(rng.randint(0, 50)) + edited + text(rng.choice([0, 30])))))
            want.add((i, i))
    docs.append((9999, " ".join(text(60_000) + docs[150][1].split() + text(40_000))))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(9999, 150)}
    assert min(r.similarity for r in got) < 0.77
