"""Jaccard join on word n-grams by partitioning the universe.

Sets are grouped into size bands whose bounds grow by 4/3 (for a similarity of 0.75), so linked sets lie in one band or in
neighbours; every pair of neighbouring bands has its own partition of the universe of shingles into ``m`` ranges of their
hash. Two linked sets of x and y shingles differ in at most H = (x + y) / 7 of them, so of more than H segments that are not
empty one is the same in both: its hash is the signature. Per set and band pair:

* scheme 0, exact segments: enough where more than H segments are not empty;
* scheme 1, half as many segments with their one-deletion neighbourhoods, for sets that scheme 0 leaves short: a segment
  then covers two differences;
* scheme 2, every shingle by itself, for sets that even scheme 1 leaves short.

A pair is found by any scheme that is enough for one of both. Signatures travel packed, per shard of the signature space,
with the slack of their set (segments beyond H + 1). A shard turns small groups into pairs, counts common segments, and
reports large groups. A set allocates its tolerance away from large groups (they cost most) as far as its slack allows: a
set with more slack than such segments needs none of them, since its links appear elsewhere. Pairs with fewer common
segments than the slack demands cannot be links.

Sets that large groups leave short meet once more among themselves, by single shingles: the slack is then two thirds of the
set, so shared passages and lines no longer matter. What is still short consists of common shingles, like a large group of
near-copies. With one order of all shingles, rarest first, the first one that two linked sets share is among the H + 1 first
of both; so such sets meet in as many of their smallest large groups as they lack, in blocks: a matrix product gives all
overlaps of two blocks, and only links that connect something leave the task. Everything else is verified on whole texts.

Copies of one set are one class throughout. Defined results: null, empty or blank texts have no shingles and are linked with
nothing; a text of fewer than ``n`` words has one shingle. Rows without an id take no part (their component is null).
Repeated ids with different texts are separate sets. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyline.llm import vector
from tallyline.llm.components import components
from tallyline.session import pin

N = 5
# the similarity is 3/4 throughout: bands, H and the check are written for it
GROUP = 16  # larger groups of one signature are not turned into pairs at once
ENTRIES = 1_000_000  # signatures a task packs together
# sets of a large group that meet in a task come from two blocks of about this size
BLOCK_SETS = 1_000
BLOCK_SHINGLES = 1_000_000
SHARD_BYTES = 32_000_000  # of text whose signatures make a shard, which a task holds as a whole: a few million signatures
BROADCAST_IDS = 1_000_000  # candidates' ids are broadcast up to this many, else joined by a shuffle
SALT = np.uint64(0x9E3779B97F4A7C15)

BOUNDS = [1]
while BOUNDS[-1] < 2**40:
    BOUNDS.append(max(BOUNDS[-1] + 1, -(-BOUNDS[-1] * 4 // 3)))
BOUNDS = np.array(BOUNDS)


def unpacked(texts: list[bytes]) -> pa.Array:
    return pa.array([zlib.decompress(t).decode() for t in texts], pa.large_string())


def sets_of(texts: pa.Array):
    """The sorted distinct shingle hashes of every text."""
    for _, data, bounds in vector.pieces(texts):
        runs, first = vector.run_hashes(*vector.word_hashes(data, bounds), N)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(runs[a:b])


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as signed numbers; the first is the name of its class."""
    one, two = vector.mix(shingles + SALT).sum(dtype=np.uint64), np.bitwise_xor.reduce(vector.mix(shingles ^ SALT), initial=np.uint64(0))
    return int((vector.mix(one[None] + np.uint64(len(shingles))))[0].astype(np.int64)), int(two.astype(np.int64))


def segments(shingles: np.ndarray, m: int, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, start, sum) of the segments that are not empty."""
    number = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    total = np.add.reduceat(vector.mix(shingles), start)
    salt = number[start] * SALT + np.uint64(tag)
    return vector.mix(vector.mix(total) + salt), start, total


def signatures(shingles: np.ndarray, single: bool = False):
    """(tag, slack, signatures) per band pair and scheme; tag = 3 * band pair + scheme. A slack of -1 leaves nothing out."""
    n = len(shingles)
    band = int(np.searchsorted(BOUNDS, n, "right")) - 1
    for low in (band - 1, band):
        if low < 0:
            continue
        top = int(BOUNDS[low + 2]) - 1
        most = (n + min(top, 4 * n // 3)) // 7
        if most == 0:
            continue  # linked sets of these sizes are equal
        if single:
            yield 3 * low + 2, n - (most + 1), vector.mix(shingles + np.uint64(3 * low + 2))
            continue
        sig, _, _ = segments(shingles, -(-22 * top // 70) + 2, 3 * low)
        slack = len(sig) - (most + 1)
        yield 3 * low, max(slack, -1), sig
        if slack >= 0:
            continue
        m = top // 7 + 3
        sig, start, total = segments(shingles, m, 3 * low + 1)
        sizes = np.diff(np.append(start, n))
        own = np.repeat(np.arange(len(start)), sizes)
        number = (((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)) * SALT + np.uint64(3 * low + 1)
        less = vector.mix(vector.mix(total[own] - vector.mix(shingles)) + number)[sizes[own] > 1]
        yield 3 * low + 1, -1, np.concatenate([sig, less])
        if np.minimum(sizes, 2).sum() < most + 1:
            yield 3 * low + 2, -1, vector.mix(shingles + np.uint64(3 * low + 2))


PACKED = "shard int, low binary, high binary, counts binary, classes binary, tags binary, slacks binary"


def pack(batches, text: str, shards: int, single: bool = False):
    """Rows of PACKED: signatures (40 bits beside the shard) of all sets, ordered by set, cut by shard.

    ``single`` takes compressed texts and makes every shingle a signature.
    """
    sigs, owners, heads, held, seen = [], [], [], 0, set()

    def flush():
        sig, owner = np.concatenate(sigs), np.concatenate(owners)
        shard = ((sig >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        order = np.argsort(shard, kind="stable")
        sig, owner, shard = sig[order], owner[order], shard[order]
        classes, tags, slacks = (np.array(x, t) for x, t in zip(zip(*heads), (np.int64, np.uint8, np.int16)))
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        columns = [[] for _ in range(7)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine, counts = np.unique(owner[a:b], return_counts=True)
            packed = (
                int(shard[a]), (sig[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((sig[a:b] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8),
                counts.astype(np.uint32), classes[mine], tags[mine], slacks[mine])
            for column, value in zip(columns, packed):
                column.append(value if isinstance(value, int) else value.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 6)], [f.split()[0] for f in PACKED.split(", ")])

    for batch in batches:
        texts = batch.column(text)
        for shingles in sets_of(unpacked(texts.to_pylist()) if single else texts):
            if not len(shingles):
                continue
            name, _ = fingerprint(shingles)
            if name in seen:
                continue
            seen.add(name)
            for tag, slack, sig in signatures(shingles, single):
                sigs.append(sig)
                owners.append(np.full(len(sig), len(heads), np.int32))
                heads.append((name, tag, min(slack, 32_000)))
                held += len(sig)
            if held > ENTRIES:
                yield flush()
                sigs, owners, heads, held, seen = [], [], [], 0, set()
    if held:
        yield flush()


FOUND = "hot boolean, sig long, a long, b long, tag int, slack_a int, slack_b int, n int"


def meet(table: pa.Table, group: int = GROUP) -> pa.Table:
    """Groups of one shard: pairs of classes with their number of common signatures, and the members of large groups."""
    low, high, counts, classes, tags, slacks = (
        np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        for c, t in (("low", np.uint32), ("high", np.uint8), ("counts", np.uint32), ("classes", np.int64), ("tags", np.uint8), ("slacks", np.int16)))
    sig = high.astype(np.int64) << 32 | low
    own = np.repeat(np.arange(len(counts)), counts)
    del low, high
    order = np.argsort(sig, kind="stable")
    sig, own = sig[order], own[order]
    shared = np.zeros(len(sig), bool)
    same = sig[1:] == sig[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    sig, own = sig[shared], own[shared]
    order = np.lexsort((classes[own], sig))
    sig, own = sig[order], own[order]
    first = np.ones(len(sig), bool)
    first[1:] = (sig[1:] != sig[:-1]) | (classes[own][1:] != classes[own][:-1])
    sig, own = sig[first], own[first]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sig)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2, group + 1):
        at = start[size == k]
        i, j = np.triu_indices(k, 1)
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    left, right = own[np.concatenate(left)], own[np.concatenate(right)]
    a, b, tag = classes[left], classes[right], tags[left]
    order = np.lexsort((tag, b, a))
    a, b, tag, left, right = a[order], b[order], tag[order], left[order], right[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (tag[1:] != tag[:-1])])) if len(a) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(a)))
    hot = np.flatnonzero(np.repeat(size, size) > group)
    shard = int(table.column("shard")[0].as_py())
    columns = [
        np.concatenate([np.zeros(len(new), bool), np.ones(len(hot), bool)]), np.concatenate([np.zeros(len(new), np.int64), sig[hot] ^ (shard << 40)]),
        np.concatenate([a[new], classes[own[hot]]]), np.concatenate([b[new], np.zeros(len(hot), np.int64)]),
        np.concatenate([tag[new], tags[own[hot]]]).astype(np.int32), np.concatenate([slacks[left[new]], slacks[own[hot]]]).astype(np.int32),
        np.concatenate([slacks[right[new]], np.zeros(len(hot), np.int16)]).astype(np.int32), np.concatenate([times, np.ones(len(hot), np.int64)]).astype(np.int32)]
    return pa.table([pa.array(c) for c in columns], [f.split()[0] for f in FOUND.split(", ")])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links: 4 * common >= 3 * (x + y - common), in whole numbers."""
    left, right = texts.withColumnsRenamed({"class": "a", "packed": "packed_a"}), texts.withColumnsRenamed({"class": "b", "packed": "packed_b"})
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "packed_a", "packed_b")

    def check(batches):
        for batch in batches:
            known: dict = {}
            sides = [batch.column(c).to_pylist() for c in ("a", "b")]
            for ids, name in zip(sides, ("packed_a", "packed_b")):
                new = {i: p for i, p in zip(ids, batch.column(name).to_pylist()) if i not in known}
                known.update(zip(new, sets_of(unpacked(list(new.values())))))
            keep = []
            for i, j in zip(*sides):
                x, y = known[i], known[j]
                near = 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y))
                common = len(x) + len(y) - len(np.union1d(x, y)) if near else 0
                keep.append(4 * common >= 3 * (len(x) + len(y) - common))
            keep = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return joined.mapInArrow(check, "a long, b long")


def link_block(table: pa.Table) -> pa.Table:
    """Links inside one block of a large group, as few as connect what is linked. Overlaps come from a matrix product."""
    names = table.column("class").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = counts[ids] > 1
    number = np.cumsum(counts > 1) - 1
    row, ids = row[common], number[ids[common]]
    order = np.argsort(ids, kind="stable")
    row, ids = row[order], ids[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, 2048):
        part = slice(*np.searchsorted(ids, (low, low + 2048)))
        there = np.zeros((len(sets), 2048), np.float32)
        there[row[part], ids[part] - low] = 1
        both += there @ there.T
    linked = 7 * both.astype(np.int64) >= 3 * (sizes[:, None] + sizes[None, :])
    root = np.arange(len(sets))
    while True:
        lower = np.where(linked, root[None, :], len(sets)).min(1)
        lower = np.minimum(lower, root)
        if (lower == root).all():
            break
        root = lower
    apart = np.flatnonzero(root != np.arange(len(sets)))
    return pa.table({"a": names[apart], "b": names[root[apart]]})


def dense_links(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the sets (sig, class) of large groups. What hangs together is cut into blocks; every two blocks meet in one task."""

    def unpack(batches):
        for batch in batches:
            sets = [s.tobytes() for s in sets_of(unpacked(batch.column("packed").to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sets, pa.binary())], ["class", "shingles"])

    # sets that share a needed signature, directly or through others: every set travels once, not once per signature
    part = components(chosen.selectExpr("class AS a", "sig AS b")).selectExpr("node AS class", "root")
    wanted = texts.join(chosen.select("class").distinct(), "class", "left_semi").select("class", "packed")
    shingles = pin(wanted.mapInArrow(unpack, "class long, shingles binary"), "large-group-sets")
    placed = pin(shingles.selectExpr("class", "octet_length(shingles) div 8 AS length").join(part, "class"), "large-group-parts")
    sizes = placed.groupBy("root").agg(F.count("*").alias("size"), F.sum("length").alias("length")).where("size > 1")
    sizes = sizes.selectExpr("root", f"int(ceil(greatest(size / {BLOCK_SETS}D, length / {BLOCK_SHINGLES}D))) AS n")
    cut = placed.join(sizes, "root").selectExpr("root", "class", "n", "int(pmod(xxhash64(class), n)) AS block")
    cut = cut.selectExpr("root", "class", "block", "explode(sequence(0, n - 1)) AS other").selectExpr(
        "root", "class", "least(block, other) AS i", "greatest(block, other) AS j")
    return cut.join(shingles, "class").groupBy("root", "i", "j").applyInArrow(link_block, "a long, b long")


def classes_of(docs: DataFrame, key: str, text: str, carry_text: bool = False) -> DataFrame:
    """(id, n, class, other) of every row, with the packed text on demand."""
    kind = docs.schema[key].dataType.simpleString()

    def name(batches):
        for batch in batches:
            sets = list(sets_of(batch.column("text")))
            names = [fingerprint(s) for s in sets]
            columns = [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64())]
            titles = ["id", "n", "class", "other"]
            if carry_text:
                columns.append(pa.array([zlib.compress((t or "").encode(), 1) for t in batch.column("text").to_pylist()], pa.binary()))
                titles.append("packed")
            yield pa.RecordBatch.from_arrays(columns, titles)

    more = ", packed binary" if carry_text else ""
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(name, f"id {kind}, n long, class long, other long{more}")


def settle(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the groups of one round: pairs to verify, members of large groups (sig, class, tag), and what sets lack.

    ``lacks`` (class, tag, lack): a set needs so many of its large groups.
    """
    hot = found.where("hot").select("sig", F.col("a").alias("class"), "tag", F.col("slack_a").alias("slack"))
    taken = pin(hot.groupBy("class", "tag").agg(F.count("*").alias("h"), F.min("slack").alias("slack")), "large-groups")
    counted = found.where("NOT hot").groupBy("a", "b", "tag").agg(F.sum("n").alias("n"), F.min("slack_a").alias("slack_a"), F.min("slack_b").alias("slack_b"))
    for side in ("a", "b"):
        counted = counted.join(taken.selectExpr(f"class AS {side}", "tag", f"h AS h_{side}"), [side, "tag"], "left")
    # common segments outside large groups: at least the slack less what the set has in large groups, plus one
    need = "greatest(0, slack_a - coalesce(h_a, 0), slack_b - coalesce(h_b, 0)) + 1"
    pairs = pin(counted.where(f"n >= {need}").select("a", "b").distinct(), "pairs")
    return pairs, hot.select("sig", "class", "tag"), taken.where("h > slack").selectExpr("class", "tag", "if(slack < 0, h, h - slack) AS lack")


def join_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    vector.small_batches(spark)
    shards = vector.shard_count(docs, text, SHARD_BYTES)
    named = pin(classes_of(docs, key, text), "classes")
    real = named.where("n > 0 AND id IS NOT NULL")
    classes = pin(real.groupBy("n", "class", "other").agg(F.min("id").alias("rep")), "class-heads")

    def groups(packed: DataFrame) -> DataFrame:
        return pin(packed.groupBy("shard").applyInArrow(lambda t: meet(t, group), FOUND), "signature-groups")

    rows = docs.where(F.col(key).isNotNull()).select(F.col(text).alias("text"))
    pairs, _, lacks = settle(groups(rows.mapInArrow(lambda b: pack(b, "text", shards), PACKED)))
    short = pin(lacks.select("class").distinct(), "short-sets")

    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(short).distinct()
    ids = pin(wanted.join(classes, "class").select(F.col("rep").alias(key)).distinct(), "candidates")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    some = docs.select(key, text).join(ids, key, "left_semi")
    texts = pin(classes_of(some, key, text, carry_text=True).where("n > 0").select("class", "packed").dropDuplicates(["class"]), "candidate-texts")

    found = None
    if not short.isEmpty():
        again = texts.join(short, "class", "left_semi").select("packed")
        more, hot, lacks = settle(groups(again.mapInArrow(lambda b: pack(b, "packed", shards, True), PACKED)))
        pairs = pairs.union(more).distinct()
        # rarest shingles first, the same order for all sets: the first common shingle of a link is among those both sets need
        sizes = hot.groupBy("sig").agg(F.count("*").alias("size"))
        chosen = hot.join(lacks, ["class", "tag"]).join(sizes, "sig").selectExpr(
            "sig", "class", "lack", "row_number() OVER (PARTITION BY class, tag ORDER BY size, sig) AS nth").where("nth <= lack")
        chosen = pin(chosen.select("sig", "class"), "large-group-members")
        found = dense_links(chosen, texts)
    links = verify(pairs, texts)
    links = pin(links if found is None else links.union(found), "links-found")
    part = components(links)
    heads = classes.join(part.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    low = heads.groupBy("root").agg(F.min("rep").alias("component_id"))
    owner = heads.join(low, "root").select("n", "class", "other", "component_id")
    joined = named.join(owner, ["n", "class", "other"], "left")
    return joined.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
