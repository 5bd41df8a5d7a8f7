"""Queries of the numbered operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import collision_ann, decontaminate, factor_machine, hard_negatives, importance, jaccard_join, kd_shards, licences, mixing, pii, spellings, suffix_dedup, url_filter
from tallyline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_url_filter")
def op1(spark, table):
    return url_filter.filter_urls(table("pages"))


@query("op10_licence_scan")
def op10(spark, table):
    return licences.scan_licences(table("documents"))


@query("op4_source_mixing", mixing.oracle())
def op4(spark, table):
    return mixing.mix_sources(table("documents"))


@query("op6_decontamination")
def op6(spark, table):
    return decontaminate.contaminated(table("documents"), table("benchmark"))


@query("op9_pii")
def op9(spark, table):
    return pii.digest(table("documents"))


@query("op3_quality_resampling")
def op3(spark, table):
    return importance.resample(table("documents"), table("labels"))


@query("op7_toxicity")
def op7(spark, table):
    held = factor_machine.held_out("doc_id")
    learned = table("labels").where(f"NOT ({held})")
    scored = factor_machine.score_toxicity(table("documents"), learned)
    return scored.selectExpr("doc_id", f"coalesce({held}, false) AS held_out", "score", "predicted")


@query("op5_nearest_vectors")
def op5(spark, table):
    rows = table("embeddings").select("vec_id", "embedding")
    return collision_ann.nearest(rows, rows.where("vec_id % 20 = 0"))


@query("op8_jaccard_join")
def op8(spark, table):
    return jaccard_join.join_similar(table("documents"))


@query("op2_suffix_dedup")
def op2(spark, table):
    return suffix_dedup.remove_repeats(table("documents")).drop("kept")


@query("op11_hard_negatives", hard_negatives.oracle())
def op11(spark, table):
    return hard_negatives.mine_negatives(hard_negatives.relabelled(table("embeddings")), "id % 100 = 0")


@query("op12_spelling_variants", spellings.oracle())
def op12(spark, table):
    return spellings.group_spellings(spellings.count_words(table("documents"), noise=spellings.NOISE))


@query("op13_sharding")
def op13(spark, table):
    return kd_shards.shard_documents(table("documents"))
