from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as E
from trolley.llm import catalog


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert set(catalog.QUERIES()) | {"pipeline"} <= set(E.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES()) == list(range(1, 14))
    assert set(catalog.ORACLES()) <= set(catalog.QUERIES())


def test_stages_work_on_what_came_before(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == columns, name
        assert docs.where("n_chars <> length(text)").count() == 0, name
        after = docs.count()
        assert 0.5 * before < after <= before, name
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == before and "ids_sha256" in last.columns


def test_stages_on_edge_rows(spark, docs, sf):
    for _, stage in corpus_pipeline.STAGES:
        for own in (docs, docs.limit(0)):
            stage(spark, own, sf).collect()
