import math
import random
import re

import numpy as np
import pyarrow as pa

from tallyline.llm import factor_machine


def corpus(n=600, seed=2):
    """Toxic where an insult meets a group name; either alone is clean."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["Vermin"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), i))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_interaction_on_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    learned = spark.createDataFrame(labels[:450], "doc_id long, toxic int")
    got = {r.doc_id: r for r in factor_machine.score_toxicity(docs, learned).collect()}
    assert len(got) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == y for i, y in labels[450:]) >= 145


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "x " * 100_000, 1), (3, "x", 1), (None, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in factor_machine.score_toxicity(docs, none).collect()} == {0}
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert len(factor_machine.score_toxicity(docs, one).collect()) == 5
    assert factor_machine.score_toxicity(docs.limit(0), one).count() == 0


def test_scores_against_a_double_loop(spark):
    """Every score is the sum over all single terms and all pairs of terms of the model."""
    rows, labels = corpus(300)
    rows += [(900, None, 1), (901, "", 1), (902, "Vermin martians vermin " * 500, 1)]
    docs, learned = spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels[:200], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in factor_machine.score_toxicity(docs, learned).collect()}
    ids, b, w, v = factor_machine.train(docs, learned, "doc_id", "text", "toxic", "doc_id", 10**6)
    place = {int(t): k for k, t in enumerate(ids)}
    assert len(place) >= 2
    hashed = {}
    for i, text, _ in rows:
        margin, mine = b, []
        for word in set(re.findall("[a-z0-9]+", (text or "").lower())):
            if word not in hashed:
                hashed[word] = [int(t) for t in next(iter(factor_machine.term_ids(pa.array([word]))))][0]
            if hashed[word] in place:
                mine.append(place[hashed[word]])
        mine = sorted(set(mine))
        for a, k in enumerate(mine):
            margin += w[k]
            for other in mine[a + 1:]:
                margin += sum(float(x) * float(y) for x, y in zip(v[k], v[other]))
        assert abs(got[i] - 1 / (1 + math.exp(-margin))) < 1e-9


def test_fewer_terms_are_the_strongest():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    samples = [np.unique(np.concatenate([[1] * int(a), [2] * int(a and rng.random() < 0.6), rng.integers(10, 60, 5)])).astype(np.uint32) for a in y]
    assert factor_machine.fit(samples, y, max_terms=1)[0].tolist() == [1]
    assert factor_machine.fit(samples, y, max_terms=2)[0].tolist() == [1, 2]
