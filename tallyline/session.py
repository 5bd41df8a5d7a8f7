"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the operators are written for. All can be overridden by the cluster.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # split a hot join key even when that costs one more exchange further down
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # medians per game: keep hashing beyond the default of 128 groups before sorting instead
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
    # a join on (entity, segment) may reuse an exchange on (entity, segment) made by a window
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_scratch: str | None = None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared checkpoint folder.

    Only a session that is one process (master local) may do without one: it gets a folder of its own.
    """
    global _own_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the executors of {master} share")
        if _own_scratch is None:
            _own_scratch = tempfile.mkdtemp(prefix="tallyline-")
        root = _own_scratch
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def pin(df, label: str):
    """Cut the lineage by writing the rows to the shared folder and reading them back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(keys, buckets: int | None = None):
    """A way to store tables like ``pin``, dealt by ``keys`` into buckets and sorted: joins on the keys then need no exchange.

    Tables stored with the same keys and number of buckets (by default that of the shuffle partitions) meet bucket by bucket;
    a table stored otherwise is dealt out to the buckets alone. A table without all keys is stored plainly.
    """
    keys = list(keys)

    def store(df, label: str):
        if not set(keys) <= set(df.columns):
            return pin(df, label)
        spark = df.sparkSession
        number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"tallyline_{label.replace('-', '_')}_{uuid.uuid4().hex}"
        # one file per bucket: rows are dealt as the buckets are before they are written
        dealt = df.repartition(number, *keys)
        dealt.write.bucketBy(number, *keys).sortBy(*keys).option("path", scratch_path(spark, label)).saveAsTable(name)
        return spark.table(name)

    return store
