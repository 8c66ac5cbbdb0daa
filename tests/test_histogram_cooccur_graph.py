"""Histograms against numpy; co-occurrence against brute force; graph tables."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from trolley.operators import cooccur, graph, histogram
from trolley.operators.items import item_counts
from trolley.plans.study import Study

RULE_SCHEMA = "antecedent array<string>, consequent array<string>, confidence double, lift double, support double"


def hist_counts(spark, values, bins=20):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = sorted(histogram.histogram(df, "v", bins).collect(), key=lambda r: r["bin"])
    return rows


def test_small_histograms(spark):
    assert [r["count"] for r in hist_counts(spark, [0, 1, 2, 3, 4], 4)] == [1, 1, 1, 2]
    rows = hist_counts(spark, [2, 2], 20)
    assert [r["bin"] for r in rows if r["count"]] == [10]
    assert rows[0]["bin_lo"] == 1.5 and rows[-1]["bin_hi"] == 2.5
    assert hist_counts(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_histogram_matches_numpy(spark, seed):
    rnd = random.Random(seed)
    values = [rnd.random() * 3 + 0.7 for _ in range(500)] + [0.7, 3.7]
    counts, edges = np.histogram(values, bins=20)
    rows = hist_counts(spark, values)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["bin_lo"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[-1]["bin_hi"] == edges[-1]


def test_histogram_on_edges_matches_numpy(spark):
    values = [i / 20 for i in range(21)] + [0.1 * k for k in range(11)]
    counts, _ = np.histogram(values, bins=20)
    assert [r["count"] for r in hist_counts(spark, values)] == counts.tolist()


@pytest.fixture(scope="module")
def small(spark):
    s = Study(spark, "/root/testdata/sf0.001")
    yield s
    s.release()


@pytest.mark.parametrize("top_n", [2, 5, 10, 20, 100])
def test_cooccurrence_brute_force(small, top_n):
    baskets = [set(r["items"]) for r in small.baskets.collect()]
    counts = {}
    for b in baskets:
        for i in b:
            counts[i] = counts.get(i, 0) + 1
    top = [i for i, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:top_n]]
    exp = {(a, b): (0 if a == b else sum(1 for s in baskets if a in s and b in s)) for a in top for b in top}
    got = {
        (r["item_1"], r["item_2"]): r["n"]
        for r in cooccur.cooccurrence_matrix(small.baskets, small.item_counts, top_n).collect()
    }
    assert got == exp
    # symmetric, zero diagonal, equals 2-itemset freq where frequent
    sets = {tuple(r["items"]): r["freq"] for r in small.mined.itemsets.collect()}
    for (a, b), n in got.items():
        assert got[(b, a)] == n
        if a < b and (a, b) in sets:
            assert sets[(a, b)] == n
    pairs = cooccur.top_item_pairs(small.baskets, small.item_counts, top_n).collect()
    rank = {it: k for k, it in enumerate(top)}
    brute = sorted(
        ((exp[(a, b)], rank[a], rank[b], a, b) for a, b in itertools.combinations(top, 2) if exp[(a, b)] > 0),
        key=lambda t: (-t[0], t[1], t[2]),
    )[:10]
    assert [(r["item_1"], r["item_2"], r["frequency"]) for r in pairs] == [(a, b, n) for n, _, _, a, b in brute]
    assert pairs[0]["pair"] == f"{pairs[0]['item_1']} & {pairs[0]['item_2']}"


def test_cooccurrence_few_items_and_empty(spark, make_baskets):
    b = make_baskets([["a", "b"], ["a", "b", "c"]])
    got = {(r["item_1"], r["item_2"]): r["n"] for r in cooccur.cooccurrence_matrix(b, item_counts(b)).collect()}
    assert len(got) == 9 and got[("a", "b")] == 2 and got[("a", "c")] == 1 and got[("c", "c")] == 0
    e = make_baskets([])
    assert cooccur.cooccurrence_matrix(e, item_counts(e)).count() == 0
    assert cooccur.top_item_pairs(e, item_counts(e)).count() == 0


def test_graph_tables(spark):
    rules = spark.createDataFrame(
        [
            (["a"], ["b"], 0.5, 3.0, 0.1),
            (["b", "a"], ["c"], 0.5, 2.0, 0.1),
            (["d"], ["a"], 0.5, 1.0, 0.1),
        ],
        RULE_SCHEMA,
    )
    nodes = {r["node"]: (r["type"], r["size"]) for r in graph.rule_graph_nodes(rules).collect()}
    assert nodes == {
        "a": ("item", 25),
        "b": ("item", 25),
        "c": ("item", 25),
        "d": ("item", 25),
        "a, b": ("itemset", 35),
    }
    edges = graph.rule_graph_edges(rules).collect()
    assert {(e["src"], e["dst"]) for e in edges} == {("a", "b"), ("a, b", "c"), ("d", "a")}
    assert all(e["norm_confidence"] == 0.5 and e["colour_bucket"] == 5 for e in edges)
    top = [e for e in edges if e["src"] == "a"][0]
    assert top["width"] == 7.5
    assert top["hover"] == "a → b<br>Lift: 3.00<br>Confidence: 0.50<br>Support: 0.100"


def test_graph_normalisation(spark):
    rules = spark.createDataFrame(
        [(["a"], ["b"], 0.2, 3.0, 0.1), (["c"], ["d"], 0.6, 2.0, 0.1), (["e"], ["f"], 1.0, 1.5, 0.1)],
        RULE_SCHEMA,
    )
    got = {e["src"]: (e["norm_confidence"], e["colour_bucket"]) for e in graph.rule_graph_edges(rules, 2).collect()}
    assert got == {"a": (0.0, 0), "c": (1.0, 10)}


def test_histograms_sum_to_rule_count(small):
    rules = small.mined.rules
    total = rules.count()
    for measure in ("lift", "confidence", "support"):
        rows = histogram.histogram(rules, measure).collect()
        assert len(rows) == 20 and sum(r["count"] for r in rows) == total


def test_graph_label_collision_keeps_item_type(spark):
    # An item literally named "a, b" and the itemset {a, b} share one label.
    rules = spark.createDataFrame(
        [(["a", "b"], ["c"], 0.5, 3.0, 0.1), (["a, b"], ["d"], 0.5, 2.0, 0.1)],
        RULE_SCHEMA,
    )
    nodes = {r["node"]: r["type"] for r in graph.rule_graph_nodes(rules).collect()}
    assert nodes["a, b"] == "item"
    assert {k for k, v in nodes.items() if v == "itemset"} == set()


def test_one_edge_for_each_pair_of_labels(spark):
    rows = [(["a, b"], ["c"], 0.5, 2.0, 0.1), (["a", "b"], ["c"], 0.4, 1.5, 0.2)]
    rules = spark.createDataFrame(rows, "antecedent array<string>, consequent array<string>, confidence double, lift double, support double")
    edges = graph.rule_graph_edges(rules).collect()
    assert [(e["src"], e["dst"], e["weight"], e["support"]) for e in edges] == [("a, b", "c", 1.5, 0.2)]
