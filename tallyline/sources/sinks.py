"""Writing tables: keyed upsert, full refresh, cached features, coverage manifest."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallyline.operators.dedupe import keep_last
from tallyline.session import drop_scratch, pin, scratch_path


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Last write wins per key: new rows beat old ones, later versions beat earlier ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["__new", *version]).drop("__new")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except Exception as error:  # noqa: BLE001 - only a missing or empty path means "no table yet"
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def upsert_table(new: DataFrame, path: str, keys: Sequence[str], version: Sequence[str], partition: str | None = None) -> None:
    """Merge a batch into a stored table.

    With a partition column, the partitions the batch falls into and those that hold one of its
    keys are read and rewritten, so a key whose partition value changes leaves its old place
    (finding them reads the keys of the table, no other column). The merged rows are staged in
    the shared folder first; a partition that loses all its rows is removed. Without a partition
    column the merged table is written beside the old one and takes its place by a rename.
    """
    spark = new.sparkSession
    if not _exists(spark, path):
        merged = keep_last(new, keys, version)
        (merged.write.partitionBy(partition) if partition else merged.write).parquet(path)
        return
    old = spark.read.parquet(path)
    if not partition:
        beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        upsert(old, new, keys, version).write.parquet(beside)
        _replace(spark, beside, path)
        return
    held = old.join(new.select(*keys).distinct(), list(keys), "left_semi").select(partition)
    touched = pin(held.union(new.select(F.col(partition).cast(old.schema[partition].dataType))).distinct(), "touched")
    same = F.col(partition).eqNullSafe(F.col("__p"))
    part = old.join(touched.withColumnRenamed(partition, "__p"), same, "left_semi")
    staged = scratch_path(spark, "upsert")
    upsert(part, new, keys, version).write.parquet(staged)
    merged = spark.read.parquet(staged)
    merged.write.mode("overwrite").partitionBy(partition).option("partitionOverwriteMode", "dynamic").parquet(path)
    # bounded by the partitions of the table
    for row in touched.join(merged.select(partition).distinct().withColumnRenamed(partition, "__p"), same, "left_anti").collect():
        value = "__HIVE_DEFAULT_PARTITION__" if row[0] is None else row[0]
        drop_scratch(spark, f"{path.rstrip('/')}/{partition}={value}")
    drop_scratch(spark, staged)


def _replace(spark: SparkSession, new: str, path: str) -> None:
    """Rename ``new`` to ``path``; the table that was there stays until the new one is in place."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files, before = of(path).getFileSystem(conf), f"{new}-before"
    if not (files.rename(of(path), of(before)) and files.rename(of(new), of(path))):
        raise OSError(f"could not rename {new} to {path}; the old table is at {before}")
    files.delete(of(before), True)
    spark.catalog.refreshByPath(path)


def refresh_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a table (or, with a partition column, the partitions the load contains)."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def latest_players(stats: DataFrame, version: Sequence[str]) -> DataFrame:
    """Player dimension: name and team of each player's latest stat row."""
    cols = ["player_id", "mlb_id", "name", "normalized_player_name", "pos", "team"]
    picked = keep_last(stats.select(*cols, *version), ["player_id"], version)
    return picked.select(*cols[:-1], F.col("team").alias("current_team"))


def cache_key(**parameters) -> str:
    """A key over every parameter that changes the content, half-lives included."""
    text = json.dumps(parameters, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:20]


def cached(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Reuse the stored table of this key, or build and store it."""
    path = f"{root.rstrip('/')}/{key}"
    if force or not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(*inputs: DataFrame) -> str:
    """A key over the files that tables are read from: path, size and time of change, from the scan's own metadata."""
    texts = []
    for df in inputs:
        files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
        texts.append([str(x) for x in files.agg(F.expr("count(1)"), F.expr("sum(cast(xxhash64(p, s, t) as decimal(38, 0)))"), F.expr("bit_xor(xxhash64(t, s, p))")).first()])
    return cache_key(files=texts)


def cached_from(spark: SparkSession, root: str, inputs: Sequence[DataFrame], build: Callable[[], DataFrame], force: bool = False, **parameters) -> DataFrame:
    """``cached`` under a key of the parameters and of the input files: changed inputs are noticed and built anew."""
    return cached(spark, root, cache_key(inputs=fingerprint(*inputs), **parameters), build, force)


def write_audited(df: DataFrame, path: str, audits: Mapping[str, str]) -> tuple[DataFrame, dict]:
    """Store ``df`` and return (the stored table, every audit's value).

    An audit is an aggregate over all rows as SQL text; all are taken from the pass that writes, so none needs a scan of its own.
    """
    seen = Observation()
    df.observe(seen, *[F.expr(f"{text} AS {name}") for name, text in audits.items()]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path), seen.get


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def missing_dates(seasons: DataFrame, seen: DataFrame, date: str = "game_date") -> DataFrame:
    """Requested days (end-exclusive spans) and whether anything was stored for them."""
    requested = seasons.select(
        F.explode(F.sequence("start", F.date_sub("end", 1))).alias("day")
    ).distinct()
    days = seen.select(F.col(date).alias("day")).distinct().withColumn("scraped", F.lit(True))
    return requested.join(days, "day", "left").select("day", F.coalesce("scraped", F.lit(False)).alias("scraped"))
