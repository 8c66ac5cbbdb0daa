from __future__ import annotations

import os

import pytest


@pytest.fixture
def docs(spark):
    """documents with null, empty, blank, repeated and very long texts, and extra columns of clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1, "x"),
        (2, None, "en", "a", 2, "x"),
        (3, "", None, "b", 3, None),
        (4, " \n\t ", "en", None, None, "x"),
        (5, "one", "en", "a", 5, "x"),
        (None, "No id here but some words all the same and a few more of them", "en", "a", 6, "x"),
        (7, "naïve Ünïcode – 日本語 <|endoftext|> 😀 don't", "de", "a", 7, "x"),
        (8, "word " * 30000, "en", "a", 8, "x"),
        (9, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1, "x"),
        (9, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string"
    return spark.createDataFrame(rows, schema).withColumnRenamed("slot", "Slot")


@pytest.fixture(scope="session")
def sf() -> str:
    return os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def texts(sf):
    import duckdb

    return duckdb.sql(f"select doc_id, text, lang from read_parquet('{sf}/documents.parquet') order by 1").fetchall()
