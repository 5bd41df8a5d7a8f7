import math
import random
import re

from tallyline.llm import licences

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text):
    words = words_of(text)
    at = [(i, label) for phrase, label in licences.BASE for p in [phrase.split()] for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    "CC BY cc-by CC  by, cc\nby", "All rights reserved. ALL RIGHTS RESERVED all rights rights reserved", "", None, "a" * 200_000,
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.", "général public license É", "general public Kicense", "reserved", "cc", "CC BY " * 3000,
    "Licensed under the Apache License, Version 2.0.",
]


def test_base_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "é"]
    texts = TEXTS + [" ".join(rng.choice(pool) for _ in range(200)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = licences.scan_licences(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows] == [by_hand(t) for t in texts]
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    labels = {t: r.labels for t, r in zip(texts, rows)}
    assert labels[TEXTS[7]] == "apache-2.0" and labels[TEXTS[8]] == "mit" and labels[TEXTS[5]] == "gpl"
    assert labels[TEXTS[6]] == "cc-by,cc-by-nc" and labels[""] == ""


def labels_by_hand(texts):
    lists = [words_of(t) for t in texts]
    idf = {w: 1.0 + math.log((len(lists) + 1) / (sum(w in x for x in lists) + 1)) for _, t, _ in licences.TEMPLATES for w in t.split()}
    out = []
    for words in lists:
        found = {label for phrase, label in licences.BASE for p in [phrase.split()] for i in range(len(words)) if words[i:i + len(p)] == p}
        for label, template, must in licences.TEMPLATES:
            parts, need = template.split(), must.split()
            at = next(i for i in range(len(parts)) if parts[i:i + len(need)] == need)
            total = sum(idf[w] for w in parts)
            for s in range(-at, len(words) - at):
                mass = sum(idf[w] / total for j, w in enumerate(parts) if 0 <= s + j < len(words) and words[s + j] == w)
                if words[s + at:s + at + len(need)] == need and mass >= licences.THRESHOLD:
                    found.add(label)
        out.append(",".join(sorted(found)))
    return out


def test_every_licence_of_a_file_is_found(spark):
    rng = random.Random(7)
    several = "Licensed under CC BY-NC. All rights reserved. Licensed under the Apache License, Version 2.0"
    every = " x ".join(t for _, t, _ in licences.TEMPLATES)
    common = [t for t in (licences.TEMPLATES[0][1], licences.TEMPLATES[1][1]) for _ in range(20)]
    prose = "no charge for the person whose forms are the subject of redistribution. " + licences.TEMPLATES[0][1]
    mixed = []
    for _ in range(30):
        picked = [t.split() for _, t, _ in rng.sample(licences.TEMPLATES, 4)]
        mixed.append(" ".join(w if rng.random() > 0.08 else "x" for p in picked for w in p))
    texts = [several, every, prose] + common + mixed
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = [r.labels for r in licences.scan_licences(docs).orderBy("doc_id").collect()]
    assert labels == labels_by_hand(texts)
    assert "apache-2.0" in labels[0].split(",") and "apache-2.0" in labels[2].split(",")
    assert set(labels[1].split(",")) == {label for label, _, _ in licences.TEMPLATES}


def test_empty_table(spark):
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_own_templates_as_a_table(spark):
    """Many templates with shared words; postings find each of them at every place."""
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(40)]
    own = []
    for k in range(300):
        words = [rng.choice(pool) for _ in range(rng.randint(3, 8))]
        at = rng.randrange(len(words) - 1)
        own.append((f"l{k}", " ".join(words), " ".join(words[at:at + 2])))
    table = spark.createDataFrame(own, "label string, template string, key_phrase string")
    texts = [" ".join(rng.choice(pool) for _ in range(60)) + " " + rng.choice(own)[1] for _ in range(25)] + ["", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.labels for r in licences.scan_licences(docs, templates=table).orderBy("doc_id").collect()]
    before = licences.TEMPLATES
    try:
        licences.TEMPLATES = tuple(own)
        assert got == labels_by_hand(texts)
    finally:
        licences.TEMPLATES = before
    assert max(len(x.split(",")) for x in got) > 3


def test_key_phrase_must_be_part_of_the_template(spark):
    wrong = spark.createDataFrame([("x", "some text here", "other")], "label string, template string, key_phrase string")
    try:
        licences.scan_licences(spark.createDataFrame([(1, "a")], "doc_id long, text string"), templates=wrong)
    except ValueError as error:
        assert "key phrase" in str(error)
    else:
        raise AssertionError
