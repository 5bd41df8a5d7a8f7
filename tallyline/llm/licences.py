"""Licence scan: a positional index of rare licence words per file, intersected with template postings.

Templates are a table (label, template, key phrase). Their postings say which word stands where in which template. Of a file's
licence words only those of highest IDF are looked up: for every template the word of its key phrase that is rarest in the
corpus. Each occurrence of it meets its postings, every posting proposes a start (place in the file less place in the template),
and starts that several occurrences propose fall together. At a start the key phrase has to stand in full, and the IDF mass of
the template's words that stand at their relative places decides. As the key phrase has to be in place, all places of all
templates are found. Base phrases are templates that are their own key phrase.

Defined results: null text is empty; an empty text or table has no words and no labels. Repeated rows are scanned alike. Very
long texts are one row like others. Words of equal IDF: the last in the alphabet is looked up. Only ``key`` and ``text`` are
read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

# Base phrases and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# label, template, key phrase that must be in place
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("gpl", "this work is licensed under the gnu general public license", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("cc-by", "licensed under cc by", "cc by"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
MAX_TEMPLATES = 2_000  # they travel with the plan
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.5


def _quoted(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def with_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __words). lower() also touches letters beyond A-Z; the only one that turns into ASCII is the Kelvin sign."""
    plain = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("ķ")))
    return docs.select(F.col(key).alias(key), F.filter(F.split(plain, NON_WORD), lambda w: w != "").alias("__words"))


def inverse_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the licence words over all files. At most one row per vocabulary word comes back."""
    found = words.select(F.explode(F.expr(f"array_union(array(''), array_intersect({_quoted(vocabulary)}, __words))")).alias("w"))
    counts = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    return {w: 1.0 + math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def template_table(spark) -> DataFrame:
    """The built-in templates."""
    return spark.createDataFrame(list(TEMPLATES), "label string, template string, key_phrase string")


def listed(templates: DataFrame) -> list[tuple[str, str, str]]:
    rows = [tuple(r) for r in templates.select("label", "template", "key_phrase").limit(MAX_TEMPLATES + 1).collect()]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    for label, template, must in rows:
        if not must.split() or f" {' '.join(must.split())} " not in f" {' '.join(template.split())} ":
            raise ValueError(f"the key phrase of {label} is empty or not part of its template")
    return rows


def postings(patterns: list[tuple[str, list[str], int, int]], idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Looked-up word -> [(pattern, place)]: the word of highest IDF in every key phrase."""
    out: dict[str, list[tuple[int, int]]] = {}
    for n, (_, words, at, length) in enumerate(patterns):
        rarest = max(words[at: at + length], key=lambda w: (idf[w], w))
        # a word that stands twice in its phrase misses nothing: one place proposes every start
        out.setdefault(rarest, []).append((n, words.index(rarest, at)))
    return out


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, templates: DataFrame | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    table = listed(templates) if templates is not None else list(TEMPLATES)
    words = with_words(docs, key, text)
    patterns = [(label, phrase.split(), 0, len(phrase.split())) for phrase, label in base]
    for label, template, must in table:
        parts, need = template.split(), must.split()
        patterns.append((label, parts, next(i for i in range(len(parts)) if parts[i:i + len(need)] == need), len(need)))
    idf = inverse_frequencies(words, sorted({w for _, parts, _, _ in patterns for w in parts}))
    known = postings(patterns, idf)
    doors = sorted(known)

    # literals: folded into one value each, whatever the number of templates
    index = "map(" + ", ".join(f"'{w}', array({', '.join(f'named_struct(\'p\', {p}, \'at\', {at})' for p, at in known[w])})" for w in doors) + ")"
    every = []
    for label, parts, at, length in patterns:
        total = sum(idf[w] for w in parts)
        masses = ", ".join(f"{idf[w] / total!r}D" for w in parts)
        every.append(f"named_struct('label', '{label}', 'words', {_quoted(parts)}, 'mass', array({masses}), 'at', {at}, 'need', {length})")
    held = f"array({', '.join(every)})"

    rows = words.selectExpr(
        f"`{key}`", "size(__words) AS n_words", f"CASE WHEN arrays_overlap(__words, {_quoted(doors)}) THEN __words END AS words"
    ).selectExpr(
        f"`{key}`", "n_words", "words", f"filter(transform(words, (w, i) -> struct(w, i)), h -> h.w IN ({', '.join(repr(w) for w in doors)})) AS hits",
    ).selectExpr(
        f"`{key}`", "n_words", "words",
        f"array_distinct(flatten(transform(hits, h -> transform(element_at({index}, h.w), q -> struct(q.p AS p, h.i - q.at AS s))))) AS proposed",
    )
    stands = "get(words, c.s + j) <=> get(c.t.words, j)"
    placed = f"filter(transform(proposed, c -> struct(c.p AS p, c.s AS s, get({held}, c.p) AS t)), c -> forall(sequence(c.t.at, c.t.at + c.t.need - 1), j -> {stands}))"
    mass = f"aggregate(sequence(0, size(c.t.words) - 1), 0D, (a, j) -> a + if({stands}, get(c.t.mass, j), 0D))"
    found = rows.selectExpr(
        f"`{key}`", "n_words", f"coalesce(transform({placed}, c -> struct(c.p AS p, c.s AS s, c.t.label AS label, least(1D, {mass}) AS mass)), array()) AS found"
    ).selectExpr(
        f"`{key}`", "n_words", f"filter(found, c -> c.p < {len(base)}) AS based", f"filter(found, c -> c.p >= {len(base)}) AS more",
    )
    return found.selectExpr(
        f"`{key}`", "bigint(n_words) AS n_words", "bigint(size(based)) AS n_base", "bigint(array_min(based.s)) AS first_word", "bigint(array_max(based.s)) AS last_word",
        "array_join(array_sort(array_distinct(based.label)), ',') AS base_labels",
        f"array_join(array_sort(array_union(based.label, filter(more, c -> c.mass >= {threshold}D).label)), ',') AS labels",
        "if(size(based) > 0, 1D, coalesce(array_max(more.mass), 0D)) AS score",
    )
