from __future__ import annotations

from trolley.llm import line_dedup


def _texts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["text"] for r in line_dedup.dedupe(docs).collect()}


def test_short_lines_are_compared(spark):
    rows = [
        (1, "All rights reserved.\n\nx\n \nonly here"),
        (2, "all  rights reserved. \nX\n\ny"),
        (3, "x\nall rights\nx"),
    ]
    assert _texts(spark, rows) == {1: rows[0][1], 2: "\ny", 3: "all rights"}


def test_scripts_without_spaces(spark):
    line = "".join(chr(0x4E00 + 37 * k) for k in range(150))
    edited = line[:-1] + "あ"
    rows = [(1, f"{line}\n版权所有"), (2, f"版权所有\n{edited}\n他"), (3, line)]
    assert _texts(spark, rows) == {1: rows[0][1], 2: "他", 3: ""}
