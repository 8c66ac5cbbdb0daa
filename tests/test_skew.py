"""A basket holding a third of all rows, and an item in most baskets."""

from __future__ import annotations

import random

from trolley.functions.quantile import exact_median
from trolley.operators import cooccur
from trolley.operators.baskets import from_lines
from trolley.operators.items import item_counts
from trolley.operators.mining import MiningParams, mine


def test_hot_basket_and_hot_item(spark):
    rnd = random.Random(9)
    rows = [(0, f"Item{rnd.randint(0, 29)} ") for _ in range(2000)]  # hot basket: a third of the rows
    for b in range(1, 800):
        rows += [(b, "hot")] + [(b, f"item{rnd.randint(0, 29)}") for _ in range(rnd.randint(0, 4))]
    lines = spark.createDataFrame(rows, "basket long, item string").repartition(6)
    baskets = from_lines(lines, "basket", "item")

    expected = {}
    for b, it in rows:
        expected.setdefault(b, set()).add(it.strip().lower())
    expected = {b: s for b, s in expected.items() if len(s) >= 2}
    got = {r["basket_id"]: set(r["items"]) for r in baskets.collect()}
    assert got == expected

    counts = item_counts(baskets)
    brute = {}
    for s in expected.values():
        for i in s:
            brute[i] = brute.get(i, 0) + 1
    assert {r["item"]: r["count"] for r in counts.collect()} == brute

    top = [i for i, _ in sorted(brute.items(), key=lambda kv: (-kv[1], kv[0]))[:10]]
    cells = {(r["item_1"], r["item_2"]): r["n"] for r in cooccur.cooccurrence_matrix(baskets, counts).collect()}
    for a in top:
        for b in top:
            n = 0 if a == b else sum(1 for s in expected.values() if a in s and b in s)
            assert cells[(a, b)] == n

    res = mine(baskets, MiningParams(0.05, 0.3))
    sets = {tuple(r["items"]): r["freq"] for r in res.itemsets.collect()}
    assert sets[("hot",)] == sum(1 for s in expected.values() if "hot" in s)
    res.unpersist()


def test_median_of_mostly_equal_values(spark):
    vals = [5.0] * 3000 + [1.0] * 10 + [9.0] * 2
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert exact_median(df, "x", num_partitions=8).first()[0] == 5.0
