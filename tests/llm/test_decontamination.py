from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    windows = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(name)
    out = []
    for text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_index_against_brute_force(seed):
    rnd = random.Random(seed)
    letters = ["a", "b", "c", "é", "Dd"][: rnd.randint(1, 5)]
    make = lambda n: " ".join(rnd.choice(letters) for _ in range(n))
    docs = [make(rnd.randint(0, 60)) for _ in range(rnd.randint(0, 8))]
    items = [(str(k), make(rnd.choice([0, 1, 2, 3, 9, 10, 11, 14]))) for k in range(rnd.randint(0, 5))]
    window = rnd.choice([2, 3, 10])
    own = [D.words_of(d) for d in docs]
    spans, names = D.find(own, D.Phrases([(n, D.words_of(t)) for n, t in items], window))
    got = [(len(a), sum(y - x for x, y in b), sorted(set(c))) for a, b, c in zip(own, spans, names)]
    assert got == brute(docs, items, window)


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 4, 400), 0)
    order = D.suffix_array(text)
    border = np.cumsum(text == 0)
    key = [[(0, int(border[k])) if text[k] == 0 else (1, int(text[k])) for k in range(s, len(text))] for s in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=key.__getitem__)
    bits = rng.integers(0, 2, 1000).astype(bool)
    at = np.arange(1001)
    assert np.array_equal(D.Bits(bits).rank(at), np.concatenate([[0], np.cumsum(bits)]))
    index = D.FmIndex(text, 4)
    assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))


def test_edge_rows(spark, docs):
    items = spark.createDataFrame(
        [(1, "QUICK brown, fox!"), (1, "lazy dog"), (2, None), (None, "one"), (3, ""), (4, "word " * 12)], "item_id long, text string"
    )
    rows = {(r["key"], r["n_words"]): r for r in D.search(docs, items, F.col("doc_id")).collect()}
    assert rows[1, 16]["items"] == ["1"] and [(s["first"], s["stop"]) for s in rows[1, 16]["spans"]] == [(1, 4), (7, 9)]
    assert rows[2, 0]["spans"] == [] and rows[5, 1]["items"] == [""]
    assert [(s["first"], s["stop"]) for s in rows[8, 30000]["spans"]] == [(0, 30000)]
    assert D.search(docs, items.limit(0), F.col("doc_id")).where(F.size("spans") > 0).count() == 0
    assert D.search(docs.limit(0), items, F.col("doc_id")).collect() == []


def test_removal(spark, docs):
    items = spark.createDataFrame([(1, "brown fox jumps")], "item_id long, text string")
    out = D.remove(docs, items)
    assert out.columns == docs.columns and out.count() == 10
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "The quick \n over the lazy dog and runs far away from here today"
    assert texts[2] is None and texts[3] == ""


def test_blocks_of_items_add_up(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {tuple(map(str, r)) for r in D.search(docs, items, F.col("doc_id")).drop("text").collect()}
    monkeypatch.setattr(D, "BLOCK_WORDS", 300)
    monkeypatch.setattr(D, "SHARD_BYTES", 5_000)
    assert whole == {tuple(map(str, r)) for r in D.search(docs, items, F.col("doc_id")).drop("text").collect()}


def test_query(spark, sf, texts):
    import duckdb

    items = [(str(a), b) for a, b in duckdb.sql(f"select * from read_parquet('{sf}/benchmark.parquet')").fetchall()]
    rows = {r["doc_id"]: r for r in D.op8_decontamination(spark, sf).collect()}
    for (i, _, _), (n, hit, names) in zip(texts, brute([t for _, t, _ in texts], items, 10), strict=True):
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert tuple(rows[i]) == (i, n, hit, len(names), sha, hit > 0)
    assert any(r["contaminated"] for r in rows.values())


def test_removal_takes_one_python_step(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, "brown fox jumps"), (2, "lazy dog")], "item_id long, text string")
    out = D.remove(docs, items)
    assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "The quick \n over the \n and runs far away from here today"
    monkeypatch.setattr(D, "BLOCK_WORDS", 1)
    assert {r["doc_id"]: r["text"] for r in D.remove(docs, items).collect()} == texts
