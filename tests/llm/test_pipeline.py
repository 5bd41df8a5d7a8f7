"""Every stage against brute force on what its predecessor kept."""

import re

import corpus_pipeline
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as groups
from test_pii import base_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # rows with odd values, and copies of whole rows
    odd = [(10_000, None, "en", "src0", None), (10_001, "", None, None, 0), (None, "the only one without an id here", "en", "src1", 3)]
    docs = docs.union(docs.where("doc_id IN (3, 7)")).union(spark.createDataFrame(odd, docs.schema))
    steps = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        path_docs = stage(spark, docs, SF)
        if name != "source_mixing":
            assert path_docs.columns == docs.columns
        docs = spark.createDataFrame(path_docs.collect(), path_docs.schema)
        steps.append(docs.toPandas())
    start, kept, unique, clean, redacted, mixed = steps
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good - set(kept.doc_id)) <= 0.05 * len(good)
    pairs = lambda df: [(None if i != i else int(i), t) for i, t in zip(df.doc_id, df.text)]
    heads = {i for i, n, low in groups(pairs(kept)) if low is None or str(low) == i}
    assert {str(i) for i, _ in pairs(unique)} == heads | ({"None"} if any(i is None for i, _ in pairs(kept)) else set())
    assert unique.doc_id.dropna().is_unique
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _ in leaks(pairs(unique), items)}
    assert {i for i, _ in pairs(clean)} == {i for i, _ in pairs(unique)} - bad
    assert len(redacted) == len(clean)
    before, after = dict(pairs(clean)), dict(pairs(redacted))
    for i, text in before.items():
        assert not [s for s in base_of(after[i]) if s[1] in (0, 1)] or not base_of(text)
        if not base_of(text) and not re.search(r"[0-9]{6}|@", text or ""):
            assert after[i] == text
    assert set(mixed.doc_id.dropna()) <= set(redacted.doc_id.dropna())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_no_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "source_mixing" or out.columns == none.columns)


def test_very_long_text_and_further_columns(spark):
    """One text of a million characters, its copy, and columns whose names the stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = " ".join(r.text for r in docs.collect()) + " "
    long = (long * (1_000_000 // len(long) + 1)) + "write to someone@mail3.example.com"
    more = spark.createDataFrame([(20_000, long, "en", "src0", len(long)), (20_001, long, "en", "src1", len(long))], docs.schema)
    docs = docs.union(more).selectExpr("*", "'x' AS id", "1 AS words", "2 AS n", "3 AS label", "doc_id AS fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality":
            continue  # few documents have labels here
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = {r.doc_id: r for r in out.where("doc_id >= 20000").collect()}
        assert set(kept) == ({20_000} if name == "near_duplicates" else set() if name == "decontamination" and not kept else {20_000, 20_001}), name
        if name == "personal_data":
            assert kept[20_000].text.endswith("write to <email>") and kept[20_000].n_chars == len(kept[20_000].text)
