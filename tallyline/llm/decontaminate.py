"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming join, exact check.

For every item, the windows of a document that have as many words as the item get a 64-bit SimHash of their words. The
fingerprint is cut into ``radius + 1`` blocks; two fingerprints within the radius agree in at least one block, so an equi
join on (item, block number, block value) finds all of them. Candidates are verified by the weighted Jaccard similarity of
their five-word shingles, the weight being the count of a shingle.

Which windows are looked at loses nothing: a window that matches an item holds one of its shingles, and moving it on to the
first of them (or back from the end of the document) never lowers the similarity. So postings (shingle, item) give a window for
every place of a shingle and every item that has it; a window meets no other item. A text shorter than the item is one window.

The radius follows from the similarity: windows of similarity 0.75 share six sevenths of their words, so a bit differs with
probability arccos(6 / 7) / pi = 0.172, 11 bits of 64 with a deviation of 3. RADIUS lies five deviations above.

Defined results: words are lower-cased and cut at ASCII white space; null text has none. An item without words matches
nothing; an item of fewer than five words has one shingle, the whole. Repeated documents and items are matched each; a
repeated (key, text) or (item, text) row gives one result row; of windows equally similar the one with the smaller distance, then
the first, is reported. Very long texts are one row like others, their windows are cut out of it one by one. Empty tables give no
rows. Only the named columns are read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from tallyline.session import pin

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 26
# so many shingles of the items are broadcast at a time
BROADCAST_ROWS = 200_000
SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), lambda w: w != "")


def shingles_sql(words: str, n: int) -> str:
    """Hashes of all runs of ``n`` words, in order; empty for fewer words."""
    run = ", ".join(f"get({words}, i + {k})" for k in range(n))
    return f"if(size({words}) < {n}, array(), transform(sequence(0, greatest(size({words}) - {n}, 0)), i -> xxhash64({run})))"


def simhash_sql(words: str) -> str:
    ones = "aggregate(hs, 0, (s, h) -> s + int(shiftright(h, b) & 1L))"
    bits = f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(if(2 * {ones} > size(hs), 1L, 0L), b))"
    # never null, or the join below would get a null check that computes all this once more
    return f"coalesce(element_at(transform(array(transform({words}, w -> xxhash64(w))), hs -> {bits}), 1), 0L)"


def blocks_sql(print_: str, radius: int) -> str:
    """(number, value) of radius + 1 blocks whose widths differ by at most one bit."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    parts = [f"struct({k} AS no, shiftrightunsigned({print_}, {a}) & {(1 << (b - a)) - 1}L AS bits)" for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return f"explode(array({', '.join(parts)}))"


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                 similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, item, start_word, n_words, distance, similarity): the best window of every document and item that match."""
    known = items.select(F.col(item).alias("item"), _words(item_text).alias("words")).where("size(words) > 0")
    known = known.selectExpr("item", "words", "size(words) AS n").selectExpr(
        "*", f"CASE {' '.join(f'WHEN n = {n} THEN ' + shingles_sql('words', n) for n in range(1, SHINGLE))} ELSE {shingles_sql('words', SHINGLE)} END AS shingles",
        f"{simhash_sql('words')} AS print",
    )
    known = pin(known.withColumn("number", F.monotonically_increasing_id()), "items")
    wanted = pin(known.selectExpr("number", "n", f"least(n, {SHINGLE}) AS len", "explode(shingles) AS h").distinct(), "item-shingles")
    lengths = [r[0] for r in wanted.select("len").distinct().collect()]  # at most five
    # items are taken in groups small enough for a broadcast; one scan of the documents each
    parts = max(1, -(-wanted.count() // BROADCAST_ROWS))

    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    worded = texts.select("key", F.xxhash64("text").alias("fp"), _words("text").alias("words"))
    windows = None
    for length, part in itertools.product(lengths, range(parts)):
        own = F.broadcast(wanted.where(f"len = {length} AND pmod(h, {parts}) = {part}"))
        # the hashes are a column of their own: a generator over a lambda expression would copy the words for every position,
        # and a filter for empty arrays (which the outer form does without) would compute them twice
        runs = worded.selectExpr("key", "fp", "words", f"{shingles_sql('words', length)} AS runs").selectExpr(
            "key", "fp", "words", "size(words) AS total", "posexplode_outer(runs) AS (pos, h)")
        # the window is cut out of the row at hand, so no text has to be fetched or shuffled
        found = runs.join(own, "h").selectExpr("key", "fp", "number", "n", "words", "total", "least(pos, greatest(0, total - n)) AS s").selectExpr(
            "key", "fp", "number", "s", "least(n, total) AS long", "slice(words, s + 1, n) AS words")
        windows = found if windows is None else windows.union(found)
    names = f"`{key}`"
    if windows is None:
        return docs.select(
            F.col(key).alias(key), F.lit(None).cast(items.schema[item].dataType).alias(item), F.lit(0).cast("long").alias("start_word"),
            F.lit(0).cast("long").alias("n_words"), F.lit(0).alias("distance"), F.lit(0.0).alias("similarity")).limit(0)
    windows = windows.selectExpr("*", f"{simhash_sql('words')} AS print")

    left = windows.selectExpr("*", f"{blocks_sql('print', radius)} AS block").selectExpr("*", "block.no", "block.bits")
    right = known.selectExpr("item", "number AS its_number", "shingles AS theirs", "print AS their_print", f"{blocks_sql('print', radius)} AS block").selectExpr(
        "item", "its_number", "theirs", "their_print", "block.no AS their_no", "block.bits AS their_bits")
    pairs = left.join(right, F.expr("number = its_number AND no = their_no AND bits = their_bits")).selectExpr(
        "key", "fp", "s", "long", "words", "item", "theirs", "bit_count(print ^ their_print) AS distance", "no",
        f"{first_shared_block('print', 'their_print', radius)} AS first_no",
    ).where(f"distance <= {radius} AND no = first_no")
    own = f"CASE {' '.join(f'WHEN size(theirs) = 1 AND long = {n} THEN ' + shingles_sql('words', n) for n in range(1, SHINGLE))} ELSE {shingles_sql('words', SHINGLE)} END"
    # a generator keeps the costly check above the join: as a filter it would be computed for every pair of equal blocks
    pairs = pairs.selectExpr("key", "fp", "s", "long", "item", "distance", f"inline_outer(array(struct({own} AS mine, theirs AS wanted)))")
    count = "size(filter({}, y -> y = x))"
    shared = f"aggregate(array_distinct(wanted), 0, (a, x) -> a + least({count.format('mine')}, {count.format('wanted')}))"
    pairs = pairs.selectExpr("*", f"inline_outer(array(struct({shared} AS both)))")
    scored = pairs.selectExpr("*", "both / double(size(mine) + size(wanted) - both) AS similarity")
    best = scored.where(f"similarity >= {similarity}D").groupBy("key", "fp", "item").agg(
        F.min(F.expr("struct(-similarity AS low, distance, s, long)")).alias("b"))
    return best.selectExpr(
        f"key AS {names}", f"item AS `{item}`", "bigint(b.s) AS start_word", "bigint(b.long) AS n_words", "b.distance AS distance", "-b.low AS similarity")


def first_shared_block(a: str, b: str, radius: int) -> str:
    """The number of the first block in which two fingerprints agree: each pair is kept once, without a shuffle."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    cases = [f"WHEN shiftrightunsigned({a} ^ {b}, {x}) & {(1 << (y - x)) - 1}L = 0 THEN {k}" for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
    return f"CASE {' '.join(cases)} END"
