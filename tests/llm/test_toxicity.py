from __future__ import annotations

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trolley.llm import toxicity as T

#: Held-out accuracy is measured where the table has enough labels.
BIG = "/root/testdata/sf0.1"


def _model(vectors, terms=40):
    """Vectors: dense unit vectors of the examples."""
    model = T.Model(terms=[str(k) for k in range(terms)], weight=np.ones(terms))
    model.doc_ids, model.toxic = np.arange(len(vectors)) * 3, (np.arange(len(vectors)) % 2).astype(float)
    model.index(*_entries(vectors))
    return model


def _entries(vectors):
    owner, term = np.nonzero(vectors)
    return owner, term, vectors[owner, term]


def _vectors(rng, n, terms=40):
    x = rng.random((n, terms)) * (rng.random((n, terms)) < 0.15)
    return x / np.maximum(1e-9, np.sqrt((x * x).sum(1, keepdims=True)))


@pytest.mark.parametrize(("n", "first"), [(0, 8), (1, 8), (70, 1), (500, 1), (500, 8), (900, 3)])
def test_neighbours_are_exact(monkeypatch, n, first):
    monkeypatch.setattr(T, "FIRST", first)
    monkeypatch.setattr(T, "DENSE", 0.15 if n % 100 == 0 else 2.0)
    rng = np.random.default_rng(n)
    examples, queries = _vectors(rng, n), _vectors(rng, 120)
    best, who = _model(examples).nearest(*_entries(queries), 120)
    cosine = queries @ examples.T
    wanted = np.zeros((120, T.NEIGHBOURS))
    wanted[:, : min(n, T.NEIGHBOURS)] = -np.sort(-cosine, axis=1)[:, : T.NEIGHBOURS]
    assert np.allclose(best, wanted, atol=1e-8)
    for row in range(120):
        for c, w in zip(best[row], who[row]):
            assert c == 0 if w < 0 else abs(cosine[row, w] - c) < 1e-8


def test_ties_go_to_the_smaller_id():
    examples = np.zeros((100, 40))
    examples[:, 3] = 1
    model = _model(examples)
    model.doc_ids = model.doc_ids[::-1].copy()
    _, who = model.nearest(*_entries(examples[:2]), 2)
    assert who[0].tolist() == list(range(99, 99 - T.NEIGHBOURS, -1))


def test_left_out_examples_do_not_vote():
    rng = np.random.default_rng(5)
    examples = _vectors(rng, 90)
    _, who = _model(examples).nearest(*_entries(examples), 90, np.arange(90))
    assert all(k not in who[k] for k in range(90))


def test_near_copies_leave_the_smallest_id():
    words = [np.arange(20), np.arange(1, 21), np.arange(50, 70), np.arange(20), np.array([], np.int64), np.arange(49, 69)]
    ids, toxic = np.array([9, 4, 7, 1, 5, 8]), np.array([1, 1, 0, 0, 0, 0])
    assert T.without_copies(ids, toxic, words).tolist() == [1, 2, 3, 4]


def plain_counts(text) -> Counter:
    out = Counter(w.lower().strip(T._MARKS) for w in (text or "").split())
    out.pop("", None)
    return out


def test_term_counts():
    texts = ["", None, "One two, TWO (two) -- é É", "  ", "...", "a\tb\nc a"]
    owner, term, count, words = T.term_counts(pa.array(texts))
    got = [Counter() for _ in texts]
    for o, t, n in zip(owner, term, count):
        got[o][words[t].as_py()] = n
    assert got == [plain_counts(t) for t in texts]
    assert [len(x) for x in T.known_counts(pa.array(texts), pa.array(["two", "zzz"]))] == [1, 1, 1]
    assert len(T.term_counts(pa.array([], pa.string()))[0]) == 0


def brute_model(docs, labels):
    """Weights and unit vectors of all labelled documents outside the fold, from the definitions."""
    counts = {d: plain_counts(t) for d, t in docs}
    train = sorted(d for d in labels if d in counts and zlib.crc32(str(d).encode()) % 5)
    of: Counter = Counter()
    for c in counts.values():
        of.update(c.keys())
    share = sum(labels[d] for d in train) / len(train)
    n, bad = Counter(), Counter()
    for d in train:
        n.update(counts[d].keys())
        bad.update(k for k in counts[d] if labels[d])
    weight = {}
    for t in n:
        deviation = (bad[t] - n[t] * share) / math.sqrt(n[t] * share * (1 - share) + 1)
        weight[t] = (math.log((1 + len(docs)) / (1 + of[t])) + 1) * (deviation**2 + T.PLAIN_WEIGHT)

    def vector(d):
        own = {t: (1 + math.log(k)) * weight[t] for t, k in counts[d].items() if t in weight}
        norm = math.sqrt(sum(x * x for x in own.values()))
        return {t: x / norm for t, x in own.items()}

    return train, vector


def test_whole_query_against_brute_force(spark, sf, texts, monkeypatch):
    """Neighbours and scores' order of every document equal those of all cosines, computed from the definitions."""
    monkeypatch.setattr(T, "without_copies", lambda ids, toxic, terms: np.arange(len(ids)))
    labels = dict(duckdb.sql(f"select doc_id, toxic from read_parquet('{sf}/labels.parquet')").fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = T.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    train, vector = brute_model([(i, t) for i, t, _ in texts], labels)
    assert sorted(model.doc_ids.tolist()) == train
    examples = {d: vector(d) for d in train}
    rows = {r["key"]: r for r in T.score(docs, model, F.col("doc_id")).collect()}
    for i, _, _ in texts:
        own = vector(i)
        cosine = {d: sum(x * e.get(t, 0.0) for t, x in own.items()) for d, e in examples.items()}
        wanted = sorted(((-round(c, 9), d) for d, c in cosine.items() if c > 0))[:3]
        got = rows[i]["nearest"]
        assert len(got) == len(wanted)
        assert all(abs(g["cosine"] + c) < 1e-8 and abs(cosine[g["doc_id"]] + c) < 1e-8 for g, (c, _) in zip(got, wanted))
    assert len({round(r["score"], 6) for r in rows.values()}) > 100


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    known = dict(duckdb.sql(f"select doc_id, toxic from read_parquet('{BIG}/labels.parquet')").fetchall())
    rows = [r for r in T.op9_toxicity(spark, BIG).collect() if r["doc_id"] in known]
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    y, p, s = (np.array(x, float) for x in zip(*[(known[r["doc_id"]], r["predicted"], r["score"]) for r in out]))
    assert (y == p).mean() > 0.96 and p[y == 0].mean() < 0.02 and p[y == 1].mean() > 0.85
    assert abs(s.mean() - y.mean()) < 0.03  # calibrated in the mean
    assert docs.count() == 10_000 and labels.count() > 0


def test_model_ignores_held_out_labels(spark):
    rows = [(k, "you utter scoundrel of a thing" if k % 3 == 0 else f"a fine day number {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    labels = [(k, int(k % 3 == 0)) for k in range(300)]
    wrong = [(k, 1 - y if k in held else y) for k, y in labels]
    schema = "doc_id long, toxic int"
    models = [T.learn(docs, spark.createDataFrame(x, schema)) for x in (labels, wrong)]
    assert models[0].terms == models[1].terms and models[0].slope == models[1].slope


def test_edge_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        model = T.learn(docs, own)
        rows = T.score(docs, model, F.col("doc_id")).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert T.score(docs.limit(0), model, F.col("doc_id")).collect() == []
    assert T.learn(docs.limit(0), labels).terms == []
