from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    hit = {x for at in windows.values() if len(at) > 1 for k in at for x in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = re.findall(r"[#*$%&|<>]", text or "")
    return len(words), sum(map(len, words)), len(symbols), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("p,q,wanted", [([1, 1], [2, 2], 0.0), ([1, 0], [0, 3], 1.0), ([1, 1], [1, 0], 0.5579)])
def test_distance(p, q, wanted):
    assert Q.distance(np.array(p, float), np.array(q, float)) == pytest.approx(wanted, abs=1e-4)
    assert Q.distance(np.array(q, float), np.array(p, float)) == pytest.approx(wanted, abs=1e-4)


def test_query(spark, sf, texts):
    rows = {r["doc_id"]: r for r in Q.op6_quality(spark, sf).collect()}
    assert len(rows) == len(texts)
    for i, text, _ in texts:
        r, counts = rows[i], brute(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["base_failed"] and r["kept"])


def test_keeps_the_clean_and_rejects_the_odd(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{sf}/labels.parquet')").fetchall())
    rows = [r for r in Q.op6_quality(spark, sf).collect() if r["doc_id"] in labels]
    clean = [r["kept"] for r in rows if labels[r["doc_id"]] == 1 and not r["base_failed"]]
    odd = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean(clean) > 0.99 and np.mean(odd) < 0.1


def test_reference_counts_copies_once(spark):
    base = [(k, " ".join(f"w{(k * 7 + j) % 40}" for j in range(200)), "en") for k in range(60)]
    copies = [(1000 + k, " ".join(f"z{j}" for j in range(60)), "en") for k in range(200)]
    schema = "doc_id long, text string, lang string"
    rows = Q.measure(spark.createDataFrame(base + copies, schema), F.col("doc_id")).collect()
    apart = {r["key"]: r["word_distance"] for r in rows}
    assert max(apart[k] for k, _, _ in base) < 0.3 < apart[1000]


def test_edge_rows(docs):
    rows = Q.judge(Q.measure(docs, F.col("doc_id"))).collect()
    assert len(rows) == 10
    by = {r["key"]: r for r in rows}
    assert all(by[k]["n_words"] == 0 and by[k]["base_failed"] and not by[k]["kept"] for k in (2, 3, 4))
    assert by[8]["n_repeat_words"] == 30000 and not by[8]["kept"]
    assert by[9]["kept"] and by[None]["n_words"] == 15
    kept = Q.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 9, 9]
    assert Q.keep(docs.limit(0)).collect() == []
