from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.llm import resampling


def words_of(text) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def runs(text) -> list[int]:
    w = words_of(text)
    return [crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute(rows, target) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) of every row."""
    s, t = Counter(), Counter()
    own = [runs(x) for _, x in rows]
    for f in own:
        s.update(f)
    for x in target:
        t.update(runs(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for (i, x), f in zip(rows, own):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [r for r, (_, x) in zip(out, rows) if len(words_of(x)) >= 20]
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=repr)


def _rows(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdeé09") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    shared = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9))) for _ in range(15)]
    out = []
    for i in range(n):
        lines = [rnd.choice(shared) if rnd.random() < 0.7 else rnd.choice(pool).upper() for _ in range(rnd.randint(0, 14))]
        out.append((i, rnd.choice(["\n", "\n\n", "\n-\n", "\r\n", " \n\t"]).join(lines)))
    return out


def _got(spark, rows, target):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = resampling.score(docs, spark.createDataFrame([(x,) for x in target], "text string"), F.col("doc_id"))
    return sorted((tuple(r) for r in out.select("key", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("chunk", [1 << 21, 30])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    rows = _rows(chunk, 300)
    assert _got(spark, rows, ["abc de\nab", "", None]) == brute(rows, ["abc de\nab", "", None])


def test_cross_features_and_line_features_are_all_features():
    for i, text in _rows(3, 200):
        lines = text.encode().translate(resampling._WORDS).split(b"\n")
        inside, counts, words = resampling.line_features(lines)
        assert counts.sum() == len(inside) and words.sum() == len(words_of(text))
        assert Counter(inside.tolist()) + Counter(resampling.cross_features(lines)) == Counter(runs(text))


def test_edge_rows(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(50, "same words in every row " * 9)] * 21
    assert _got(spark, rows, ["the quick brown fox"]) == brute(rows, ["the quick brown fox"])
    assert _got(spark, rows, []) == brute(rows, [])
    assert _got(spark, [], ["a b"]) == []


def test_drawn_documents_keep_their_columns(spark):
    rows = _rows(5, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("text as Key", "*", "1 as rank", "'x' as n_words", "2 as rid", "struct(3 as a) as lines")
    target = spark.createDataFrame([("abc de ab",)], "text string")
    out = resampling.resample(docs, target)
    assert out.columns == docs.columns
    drawn = {r[0] for r in brute(rows, ["abc de ab"]) if r[4]}
    assert {r["doc_id"] for r in out.collect()} == drawn and drawn
    assert resampling.resample(docs.limit(0), target).collect() == []


def test_the_draw_follows_the_target(spark):
    rnd = random.Random(1)
    near, far = "river stone bridge harbour mill".split(), "price offer order shipping discount".split()
    rows = [(i, " ".join(rnd.choice(near if i % 4 == 0 else far) for _ in range(30))) for i in range(600)]
    got = _got(spark, rows, [" ".join(rnd.choice(near) for _ in range(500))])
    drawn = [r[0] for r in got if r[4]]
    assert len(drawn) == 30 and all(i % 4 == 0 for i in drawn)


def test_ranks_over_many_partitions(spark):
    values = np.random.default_rng(1).integers(0, 50, 5000).tolist()
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "row long, score long").repartition(7)
    out = resampling.ranked(rows, [F.desc("score"), F.asc("row")], F.expr("n * 37 div 100")).collect()
    wanted = sorted(range(5000), key=lambda k: (-values[k], k))[: 5000 * 37 // 100]
    assert [r["row"] for r in sorted(out, key=lambda r: r["rank"])] == wanted
    assert sorted(r["rank"] for r in out) == list(range(1, len(wanted) + 1))


def test_query(spark, sf, texts):
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in resampling.op12_resampling(spark, sf).collect()), key=repr)
    assert got == brute([(i, t) for i, t, _ in texts], target)
