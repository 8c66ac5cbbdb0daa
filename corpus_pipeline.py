"""A corpus pipeline of the operators in ``trolley.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm import decontamination, line_dedup, near_dedup, quality
from trolley.llm.bpe import encode
from trolley.llm.shared import settle, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines one stays in the corpus; documents that lose all their lines go."""
    return _counted(line_dedup.dedupe(docs, keep_emptied=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8."""
    return near_dedup.dedupe(docs, size=5, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` are cut out of the texts."""
    return _counted(decontamination.remove(docs, table(spark, sf_dir, "benchmark")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's ids and the hash of what they decode to."""
    return encode(docs, ids=True, digest=True)


STAGES = [("quality", quality_rules), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("bpe", bpe)]

#: The stages work on signatures, suffix arrays and trained thresholds, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"pipeline-{name}")
    return docs
