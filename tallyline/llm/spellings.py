"""Grouping of spelling variants: words at distance one, found through a dictionary of trie-node pairs.

The words' forward trie and the trie of the reversed words are numbered, so the split of a word after i letters is a pair of
integers (prefix node, suffix node). A word is entered at every split as it is, and at every letter with this letter skipped.
Words that skip a letter at the same pair differ by one replaced letter; a word whose skipped pair is the split of another one
has one letter more. Deleting any letter of a run of equal ones gives the same word, so such pairs count once, at the run's
first letter. A pair is met by one whole word and one word per letter of the alphabet at most, 91 rows; no group is larger.

The numbering streams through sorted words: a node gets the next number when a word first leaves the path of the one before, so
only the current path is held. Words are dealt by their first (last) three letters, whose own nodes are numbered by rule; the
numbers do not depend on the partitioning and grow in code-point order, which makes a word's last node its sortable id.

A word's form is its near word of largest count (ties: smallest in code-point order), where that is at least ``ratio`` times
its own. Counts at least double on the way from form to form, so pointer jumping ends after a few rounds.

Defined results: null and empty texts have no words; a null key counts as '' in the checksum; repeated rows count again. Whole
texts are read, words of any length take part. Without words there are no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyline.session import pin

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CODE = {c: i + 1 for i, c in enumerate(LOWER + "".join(map(chr, range(0xC0, 0x100))))}  # 7 bits, in code-point order
HEAD = 3  # letters whose nodes are numbered by rule; all words that take part are longer
MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2
NOISE = 97
FLUSH = 200_000  # letters in a batch of numbered words


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int | None = None, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with their number of occurrences.

    Where ``noise`` divides the checksum of ``key:run``, the letter at checksum modulo length is left out.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN})"), F.lit(1))).alias("__run"))
    words = runs.select("__key", F.translate("__run", UPPER, LOWER).alias("word")).where(F.length("word") >= min_letters)
    if noise:
        words = words.withColumn("h", F.crc32(F.concat_ws(":", "__key", "word"))).withColumn(
            "word", F.expr(f"if(h % {noise} = 0, concat(left(word, int(h % length(word))), substr(word, int(h % length(word)) + 2)), word)")
        ).where(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def numbered(words: DataFrame, backward: bool) -> DataFrame:
    """Every row with ``nodes``: the numbers of the trie nodes on its path, the root first."""
    spelt = F.reverse("word") if backward else F.col("word")
    dealt = words.withColumn("spelt", spelt).repartition(F.substring("spelt", 1, HEAD)).sortWithinPartitions("spelt")

    def walk(batches):
        last, path, made, base = "", [], 0, 0
        for batch in batches:
            rows, flat, ends, begun = batch.column("spelt").to_pylist(), [], [0], 0
            for k, word in enumerate(rows):
                if word[:HEAD] != last[:HEAD]:
                    path, made, base = [0], 0, 0
                    for c in word[:HEAD]:
                        base = base << 7 | CODE[c]
                        path.append(base)
                    base <<= 42
                    same = HEAD
                else:
                    same, most = HEAD, min(len(word), len(last))
                    while same < most and word[same] == last[same]:
                        same += 1
                    del path[same + 1:]
                new = len(word) - same
                path.extend(range(base + made + 1, base + made + 1 + new))
                made, last = made + new, word
                flat.append(np.array(path, np.int64))
                ends.append(ends[-1] + len(path))
                if ends[-1] >= FLUSH or k == len(rows) - 1:
                    nodes = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(flat)))
                    part = batch.slice(begun, k + 1 - begun)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), nodes], [*kept, "nodes"])
                    flat, ends, begun = [], [0], k + 1

    kept = words.columns
    return dealt.mapInArrow(walk, ", ".join(f"{c} {t}" for c, t in words.dtypes) + ", nodes array<bigint>")


def node_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, kind, n, id) of every split (kind 0) and every skipped letter (2, or 1 inside a run of equal ones)."""

    def pairs(batches):
        for batch in batches:
            words, begun = batch.column("word").to_pylist(), 0
            while begun < len(words):
                stop, letters = begun, 0
                while stop < len(words) and letters < FLUSH:
                    letters += len(words[stop])
                    stop += 1
                part = batch.slice(begun, stop - begun)
                size = np.array([len(w) for w in words[begun:stop]])
                text = np.frombuffer("".join(words[begun:stop]).encode("utf-32-le"), np.uint32)
                forward, back = (np.asarray(part.column(c).flatten()) for c in ("forward", "nodes"))
                own = np.repeat(np.arange(len(size)), size + 1)
                first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
                place = np.arange(len(own)) - first[own]
                mirror = first[own] + size[own] - place  # the node of the suffix after `place` letters
                inner = place < size[own]
                letter = (np.arange(len(own)) - own)[inner]  # the letter after the split
                start = (place[inner] == 0) | (text[letter] != text[np.maximum(letter - 1, 0)])
                ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
                whose = np.concatenate([own, own[inner]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([forward, forward[inner]])), pa.array(np.concatenate([back[mirror], back[mirror[inner] - 1]])),
                     pa.array(np.concatenate([np.zeros(len(own), np.int8), 1 + start.astype(np.int8)])), pa.array(n[whose]), pa.array(ids[whose])],
                    ["prefix", "suffix", "kind", "n", "id"])
                begun = stop

    return words.mapInArrow(pairs, "prefix long, suffix long, kind byte, n long, id long")


def neighbours(prefix: np.ndarray, suffix: np.ndarray, kind: np.ndarray, n: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(id, near words, count and id of the best) for rows sorted by pair, groups whole."""
    change = np.ones(len(prefix), bool)
    change[1:] = (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])
    group = np.cumsum(change) - 1
    shared = np.bincount(group)[group] > 1
    if not shared.any():
        return []
    kind, n, ids = kind[shared], n[shared], ids[shared]
    group = np.unique(group[shared], return_inverse=True)[1]
    groups = group[-1] + 1

    def best_two(rows):
        """Row of the largest and the second largest count in every group, -1 where there is none."""
        rows = rows[np.lexsort((ids[rows], -n[rows], group[rows]))]
        begin = np.searchsorted(group[rows], np.arange(groups))
        many = np.bincount(group[rows], minlength=groups)
        padded = np.append(rows, [-1, -1])
        return np.where(many > 0, padded[begin], -1), np.where(many > 1, padded[np.minimum(begin + 1, len(rows))], -1), many

    out = []
    skipped = np.flatnonzero(kind > 0)
    one, two, many = best_two(skipped)
    replaced = skipped[many[group[skipped]] > 1]
    other = np.where(one[group[replaced]] == replaced, two[group[replaced]], one[group[replaced]])
    out.append((ids[replaced], many[group[replaced]] - 1, n[other], ids[other]))
    single = np.full(groups, -1)
    single[group[kind == 0]] = np.flatnonzero(kind == 0)
    longer = np.flatnonzero(kind == 2)
    one, _, many = best_two(longer)
    longer = longer[single[group[longer]] >= 0]
    shorter = single[group[longer]]
    out.append((ids[longer], np.ones(len(longer), np.int64), n[shorter], ids[shorter]))
    whole = single[(single >= 0) & (many > 0)]
    at = one[group[whole]]
    out.append((ids[whole], many[group[whole]], n[at], ids[at]))
    return out


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best): number of near words of every word that has any, and the best of them."""
    names = ["prefix", "suffix", "kind", "n", "id"]

    def meet(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in names]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            held = [x[cut:] for x in now]
            yield from told([x[:cut] for x in now])
        if held is not None:
            yield from told(held)

    def told(rows):
        for part in neighbours(*rows) if len(rows[0]) else []:
            if len(part[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in part], ["id", "near", "best_n", "best"])

    found = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix").mapInArrow(meet, "id long, near long, best_n long, best long")
    best = F.max(F.struct("best_n", (-F.col("best")).alias("b")))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("m")).selectExpr("id", "n_near", "m.best_n", "-m.b AS best")


def followed(links: DataFrame) -> DataFrame:
    """(id, root): the end of the chain of ``links`` (id, form) that starts at every id; every round doubles the way."""
    now = pin(links.selectExpr("id", "form AS root"), "spelling-roots")
    while True:
        step = now.alias("a").join(now.alias("b"), F.expr("a.root = b.id"), "left").selectExpr("a.id", "coalesce(b.root, a.root) AS root", "b.id IS NOT NULL AS moved")
        step = pin(step, "spelling-roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def group_spellings(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words in ``counted`` (word, n)."""
    words = pin(numbered(counted, False).withColumn("id", F.element_at("nodes", -1)).withColumnRenamed("nodes", "forward"), "spelling-words")
    near = pin(near_words(node_pairs(numbered(words, True))), "spelling-near")
    plain = words.select("id", "word", "n")
    links = pin(near.join(plain, "id").where(F.col("best_n") >= ratio * F.col("n")).selectExpr("id", "best AS form", "best_n AS form_n"), "spelling-forms")
    forms = links.join(plain.selectExpr("id AS form", "word AS form_word"), "form").select("id", "form_word", "form_n")
    roots = followed(links).join(plain.selectExpr("id AS root", "word AS root_word"), "root").select("id", "root_word")
    return (
        plain.join(near.select("id", "n_near"), "id", "left").join(forms, "id", "left").join(roots, "id", "left")
        .selectExpr("word", "form_word AS form", "coalesce(root_word, word) AS root", "n", "coalesce(n_near, 0L) AS n_near", "form_n")
    )


def oracle(noise: int = NOISE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> str:
    """DuckDB text of the same rows: checksums byte by byte, words met by what is left without one letter."""
    rounds = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)"
    return f"""
WITH RECURSIVE steps AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, {rounds} AS c FROM range(256) AS g(b))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS w FROM documents
), keyed AS (SELECT k || ':' || w AS s, w, count(*) AS n FROM runs WHERE length(w) >= {min_letters} GROUP BY k, w),
hashed AS (
  SELECT w, n, xor(list_reduce(list_transform(range(0, length(hex(encode(s))), 2), lambda i: ('0x' || substr(hex(encode(s)), i + 1, 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM keyed, steps
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {noise} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed
  ) WHERE length(word) >= {min_letters} GROUP BY word HAVING sum(n) >= {min_count}
), cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS form, max(n) AS form_n FROM near GROUP BY a),
shown AS (
  SELECT word, CASE WHEN form_n >= {ratio} * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {ratio} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON a = word
), way AS (
  SELECT word, word AS root, form AS next FROM shown
  UNION ALL SELECT way.word, shown.word, shown.form FROM way JOIN shown ON way.next = shown.word
)
SELECT shown.word, shown.form, way.root, shown.n, shown.n_near, shown.form_n FROM shown JOIN way ON way.word = shown.word AND way.next IS NULL"""
