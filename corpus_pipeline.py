"""Corpus pipeline: quality, near-duplicates, benchmark decontamination, personal data, source mixing.

Every stage works on all rows its predecessor kept, and all but the last return the columns of ``documents``. Rows are told
apart by id and text, so repeated and null ids do no harm. What a stage drops is joined back by a broadcast up to
BROADCAST_IDS rows, else by a shuffle. Texts of any length go through every stage whole. An empty table of documents gives an
empty result of every stage; further columns of the documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.llm import decontaminate, importance, jaccard_join, mixing, pii
from tallyline.session import pin, tune

BROADCAST_IDS = 1_000_000


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", F.struct(F.col("doc_id"), F.xxhash64("text").alias("fp")))


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` semi or anti joined with ``rows`` (id, fp)."""
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows.hint("merge")
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["id"]) & (F.xxhash64(docs["text"]) == rows["fp"]), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling.

    Null and empty texts, and those too short for an n-gram, are the first to go. Without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.resample(docs, labels, carry=tuple(docs.columns)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Texts without words (null, empty, blank) and rows without an id are no duplicates of anything and stay.
    """
    found = pin(jaccard_join.join_similar(_marked(docs).select("__row", "text"), "__row").select("__row", "component_id"), "groups")
    gone = pin(found.where("__row <> component_id").selectExpr("__row.doc_id AS id", "__row.fp AS fp").distinct(), "near-duplicates")
    kept = _joined(docs, gone, "left_anti")
    # the same row more than once: one stays (texts without words are no group)
    twice = pin(found.where("__row = component_id").groupBy("__row").count().where("count > 1").selectExpr("__row.doc_id AS id", "__row.fp AS fp"), "repeated-rows")
    if twice.isEmpty():
        return kept
    one = _joined(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return _joined(kept, twice, "left_anti").union(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none; without items all stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(_marked(docs).select("__row", "text"), items, key="__row")
    gone = pin(found.selectExpr("__row.doc_id AS id", "__row.fp AS fp").distinct(), "contaminated")
    return _joined(docs, gone, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; null stays null."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order of training: documents by source, pass, block and place. A null source counts as ''."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = pin(docs, f"pipeline-{name}")
    return docs
