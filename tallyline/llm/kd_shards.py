"""Shards of equal bytes by k-d tree partitioning.

Every document is a point of its metadata (language, source, length, id; each laid out on 2^24 places) weighted by its bytes. A
node of the tree that is to fill m shards is cut along the dimension in which its points spread widest, at the weighted
quantile that gives floor(m / 2) shards to the left; nodes of one shard are leaves. All nodes of a level are cut together: one
aggregate finds their extents, and the quantile is narrowed by histograms of at most WAYS buckets a node, over the place in the
dimension followed by a hash, so points that share a place (a source with a third of all rows) are cut like any others.

A document larger than 1 / BIG of a shard would spoil the cuts, and there are fewer than BIG x shards of them: these are dealt
first, largest first, to the emptiest shard, and the tree fills what they leave. Shards of the tree therefore differ by a few
hundredths; where single documents exceed a shard, no law can do better than a shard for each.

Rows get numbers once, in a written table, so the result is stable from then on; between runs, rows equal in all metadata may
swap places. Slots count through (shard, hash class) pieces of about SLOT_ROWS rows, so no shard is sorted as a whole.

Defined results: null text has no bytes, size OVERHEAD and checksum 0; null metadata lies at the first place; repeated rows are
separate rows. A text of any length is one row and never read into Python. Fewer rows than shards leave shards empty; an empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from tallyline.session import pin

SHARDS = 40
OVERHEAD = 16
DIMENSIONS = ("crc32(lang)", "crc32(source)", "log2(octet_length(text) + 1D)", "doc_id")
PLACES = 24  # bits of a place in a dimension
TIES = 39  # bits of the hash behind it
WAYS = 12  # bits of a histogram
BIG = 64
TOLERANCE = 500  # a cut is settled where no more than 1 / TOLERANCE of a shard is open
SLOT_ROWS = 50_000


def points(docs: DataFrame, key: str, text: str, dimensions: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """Stored rows: number, size, checksum, a hash for ties and the place in every dimension."""
    number = [F.expr(f"CASE WHEN abs({d}) < double('infinity') THEN double({d}) END").alias(f"__v{i}") for i, d in enumerate(dimensions)]
    rows = docs.select(
        F.col(key).alias("__key"), *[F.col(c).alias(f"__carry_{c}") for c in carry], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__bytes"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("__crc"), *number,
    ).withColumn("__row", F.monotonically_increasing_id())
    rows = pin(rows.withColumn("__size", F.col("__bytes") + OVERHEAD).drop("__bytes"), "points")
    names = [f"__v{i}" for i in range(len(dimensions))]
    ends = rows.agg(*[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max)]).first()
    placed = []
    for i, n in enumerate(names):
        low, high = ends[f"min{n}"], ends[f"max{n}"]
        scale = (2**PLACES - 1) / (high - low) if high is not None and high > low else 0.0
        placed.append(F.expr(f"coalesce(bigint(least(greatest(({n} - {low or 0.0!r}D) * {scale!r}D, 0D), {2**PLACES - 1}D)), 0L)").alias(f"d{i}"))
    tie = F.expr(f"xxhash64(__row, __crc) & {2**TIES - 1}L").alias("tie")
    return rows.select(*[c for c in rows.columns if c not in names], tie, *placed)


def deal_big(rows: DataFrame, total: int, shards: int) -> tuple[list[tuple[int, int]], list[int]]:
    """((row, shard) of the big rows, load of every shard): fewer than BIG x shards rows, the largest first."""
    big = rows.where(F.col("__size") * BIG * shards > total).select("__row", "__size").collect()
    loads, dealt = [0] * shards, []
    heap = [(0, s) for s in range(shards)]
    for r in sorted(big, key=lambda r: (-r["__size"], r["__row"])):
        load, s = heapq.heappop(heap)
        dealt.append((r["__row"], s))
        loads[s] = load + r["__size"]
        heapq.heappush(heap, (loads[s], s))
    return dealt, loads


def rooms(loads: list[int], rest: int) -> dict[int, float]:
    """What each shard takes of ``rest`` bytes so that all come to one level; shards above the level take nothing."""
    order = sorted(range(len(loads)), key=lambda s: (loads[s], s))
    level, filled = 0.0, 0
    for n, s in enumerate(order, 1):
        filled += loads[s]
        level = (rest + filled) / n
        if n == len(order) or level <= loads[order[n]]:
            break
    return {s: level - loads[s] for s in sorted(order[:n]) if level > loads[s]}


def cuts(keyed: DataFrame, goals: dict[int, float], tolerance: float) -> dict[int, int]:
    """For every node the key below which about ``goals`` bytes lie: histograms of the interval that holds the cut."""
    spark = keyed.sparkSession
    low, below, done = dict.fromkeys(goals, 0), dict.fromkeys(goals, 0), {}
    bits = PLACES + TIES
    while len(done) < len(goals):
        shift = max(0, bits - WAYS)
        open_ = spark.createDataFrame([(n, low[n], low[n] + (1 << bits) - 1) for n in goals if n not in done], "node int, low long, last long")
        counted = (
            keyed.join(F.broadcast(open_), "node").where("k >= low AND k <= last")
            .groupBy("node", F.expr(f"shiftright(k - low, {shift})").alias("bucket")).agg(F.sum("size").alias("bytes")).collect()
        )
        found: dict[int, list[tuple[int, int]]] = {}
        for r in counted:
            found.setdefault(r.node, []).append((r.bucket, r.bytes))
        for n in [n for n in goals if n not in done]:
            bucket, size = 0, 0
            for bucket, size in sorted(found.get(n, [(0, 0)])):
                if below[n] + size >= goals[n]:
                    break
                below[n] += size
            else:
                below[n] -= size  # the goal lies at the very end
            low[n] += bucket << shift
            if size <= tolerance or shift == 0:
                nearer = goals[n] - below[n] <= below[n] + size - goals[n]
                done[n] = low[n] if nearer else low[n] + (1 << shift)
        bits = shift
    return done


def tree(rows: DataFrame, room: dict[int, float], dimensions: int) -> DataFrame:
    """``rows`` with ``shard``: the leaf that takes each."""
    spark = rows.sparkSession
    nodes, next_ = {0: list(room)}, 1
    rows = rows.withColumn("node", F.lit(0))
    tolerance = max(room.values()) / TOLERANCE
    while open_ := {n: s for n, s in nodes.items() if len(s) > 1}:
        spans = rows.where(F.col("node").isin(list(open_))).groupBy("node").agg(*[F.expr(f"max(d{i}) - min(d{i})").alias(f"w{i}") for i in range(dimensions)]).collect()
        widest = {r.node: max(range(dimensions), key=lambda i: (r[f"w{i}"], -i)) for r in spans}
        along = spark.createDataFrame([(n, widest.get(n, 0)) for n in open_], "node int, dim int")
        key = f"shiftleft(array({', '.join(f'd{i}' for i in range(dimensions))})[dim], {TIES}) | tie"
        sizes = rows.join(F.broadcast(along), "node").selectExpr("node", f"{key} AS k", "__size AS size")
        held = {r.node: r.b for r in sizes.groupBy("node").agg(F.sum("size").alias("b")).collect()}
        goals = {n: held.get(n, 0) * sum(room[x] for x in s[: len(s) // 2]) / sum(room[x] for x in s) for n, s in open_.items()}
        found, split = cuts(sizes, goals, tolerance), []
        for n, s in open_.items():
            split.append((n, widest.get(n, 0), found[n], next_, next_ + 1))
            nodes |= {next_: s[: len(s) // 2], next_ + 1: s[len(s) // 2:]}
            del nodes[n]
            next_ += 2
        table = spark.createDataFrame(split, "node int, dim int, cut long, l int, r int")  # fewer rows than shards
        rows = rows.join(F.broadcast(table), "node", "left").withColumn("node", F.expr(f"CASE WHEN cut IS NULL THEN node WHEN ({key}) < cut THEN l ELSE r END")).drop("dim", "cut", "l", "r")
    leaves = spark.createDataFrame([(n, s[0]) for n, s in nodes.items()], "node int, shard int")
    return rows.join(F.broadcast(leaves), "node")


def slotted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: numbers without a gap from 0 in every shard."""
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("piece", F.pmod("tie", F.lit(max(1, -(-most // SLOT_ROWS)))))
    counts = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = pin(counts.selectExpr("shard", "piece", "sum(n) OVER (PARTITION BY shard ORDER BY piece) - n AS before"), "pieces")
    return rows.join(before, ["shard", "piece"]).withColumn("slot", F.expr("before + row_number() OVER (PARTITION BY shard, piece ORDER BY tie, __row) - 1"))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; ``carry`` adds columns of ``docs``.

    ``dimensions`` are numeric expressions over ``docs``. The law is ``bytes``: sizes near equal; the tree says nothing about
    another number of shards.
    """
    rows = points(docs, key, text, dimensions, carry)
    total = rows.agg(F.sum("__size")).first()[0] or 0
    dealt, loads = deal_big(rows, total, shards)
    spark = docs.sparkSession
    big = F.broadcast(spark.createDataFrame(dealt, "__row long, shard int"))
    rest = total - sum(loads)
    parts = [rows.join(big, "__row")]
    if rest:
        small = tree(rows.join(big, "__row", "left_anti"), rooms(loads, rest), len(dimensions))
        parts.append(small.select(*parts[0].columns))
    placed = pin(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), "sharded")
    return slotted(placed).select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"__carry_{c}").alias(c) for c in carry],
    )


def write_shards(placed: DataFrame, path: str, file_rows: int = 100_000) -> None:
    """Parquet files under ``shard=N``, each a stretch of slots in order."""
    dealt = placed.withColumn("__file", F.expr(f"slot div {file_rows}"))
    dealt.repartition("shard", "__file").sortWithinPartitions("shard", "slot").drop("__file").write.partitionBy("shard").parquet(path)
