"""Item statistics, share table, rule filters, search, insight, statistics."""

from __future__ import annotations

import pytest

from trolley.operators import items as I
from trolley.operators import rules as R

RULE_SCHEMA = "antecedent array<string>, consequent array<string>, confidence double, lift double, support double"


def counts_frame(spark, pairs):
    return spark.createDataFrame(pairs, "item string, count long")


def test_share_with_others(spark):
    counts = counts_frame(spark, [(f"i{k:02d}", 100 - k) for k in range(12)])
    rows = sorted(I.top_item_share(counts).collect(), key=lambda r: r["rank"])
    assert [r["item"] for r in rows] == [f"i{k:02d}" for k in range(10)] + ["Others"]
    assert rows[-1]["count"] == (100 - 10) + (100 - 11)
    assert sum(r["percent_of_top"] for r in rows) == pytest.approx(100.0)


def test_share_without_others(spark):
    counts = counts_frame(spark, [(f"i{k}", 10 - k) for k in range(8)])
    rows = I.top_item_share(counts).collect()
    assert len(rows) == 8 and all(r["item"] != "Others" for r in rows)


def test_top_items_tie_by_name(spark):
    counts = counts_frame(spark, [("b", 5), ("a", 5), ("c", 7)])
    assert [(r["rank"], r["item"]) for r in I.top_items(counts).collect()] == [(1, "c"), (2, "a"), (3, "b")]


def test_item_statistics(spark, make_baskets):
    b = make_baskets([["a", "b"], ["a", "c"], ["a", "b", "c"]])
    st = I.item_statistics(I.item_counts(b)).first()
    assert st["total_occurrences"] == 7 and st["unique_items"] == 3
    assert st["avg_occurrence"] == pytest.approx(7 / 3)
    assert (st["most_frequent_item"], st["most_frequent_count"]) == ("a", 3)
    assert (st["least_frequent_top_item"], st["least_frequent_top_count"]) == ("c", 2)


def test_empty_overview_and_statistics(spark, make_baskets):
    b = make_baskets([])
    c = I.item_counts(b)
    empty_rules = spark.createDataFrame([], RULE_SCHEMA)
    empty_sets = spark.createDataFrame([], "items array<string>, freq long")
    ov = I.overview(b, c, empty_sets, empty_rules).first()
    assert ov["transactions"] == 0 and ov["avg_basket_size"] is None and ov["total_rules"] == 0
    st = I.item_statistics(c).first()
    assert st["unique_items"] == 0 and st["avg_occurrence"] is None
    assert I.basket_size_distribution(b).count() == 0
    assert I.top_item_share(c).count() == 0


def sample_rules(spark):
    return spark.createDataFrame(
        [
            (["whole milk"], ["a%b"], 0.5, 2.0, 0.1),
            (["a%b"], ["whole milk"], 0.4, 2.0, 0.1),
            (["x", "y"], ["z"], 0.9, 0.5, 0.02),
            (["z"], ["x"], 0.3, 1.0, 0.05),
            (["q"], ["r"], 0.3, None, 0.05),
        ],
        RULE_SCHEMA,
    )


def test_search_is_literal_and_case_folded(spark):
    rules = sample_rules(spark)
    got = {(r["antecedent"], r["consequent"]) for r in R.search(rules, "%").collect()}
    assert got == {("whole milk", "a%b"), ("a%b", "whole milk")}
    assert R.search(rules, "MILK").count() == 2
    assert R.search(rules, "_").count() == 0


def test_filters_switch_off_at_zero(spark):
    rules = sample_rules(spark)
    assert R.explore(rules, min_lift=0.0, min_support=0.0).count() == 5  # null lift survives
    assert R.explore(rules, min_lift=1.0, min_support=0.0).count() == 3
    assert R.explore(rules).count() == 3  # default: lowest support
    assert R.explore(rules, min_lift=1.0, min_support=0.06).count() == 2
    cnt = R.explore_count(rules, min_lift=1.0, min_support=0.06).first()
    assert (cnt["shown"], cnt["total"]) == (2, 5)


def test_rule_insight_texts(spark):
    rules = sample_rules(spark)
    hi = R.rule_insight(rules, rule="whole milk → a%b", min_lift=0).first()
    assert hi["insight"] == (
        "Customers who buy **whole milk** are **2.0x** more likely to also buy **a%b** compared to random chance."
    )
    assert hi["confidence_text"] == "Confidence means: 50.0% of customers who bought whole milk also bought a%b"
    eq = R.rule_insight(rules, rule="z → x", min_lift=0).first()
    assert eq["insight"] == "Items **z** and **x** are independent of each other."
    lo = R.rule_insight(rules, rule="x, y → z", min_lift=0).first()
    assert lo["insight"] == "Customers who buy **x, y** are less likely to buy **z**."
    assert R.rule_insight(rules, rule="nothing → here", min_lift=0).count() == 0


def test_top_rules_order_and_labels(spark):
    rules = sample_rules(spark)
    got = [(r["antecedent"], r["consequent"]) for r in R.top_rules(rules, 3).collect()]
    assert got == [("a%b", "whole milk"), ("whole milk", "a%b"), ("z", "x")]
    lab = R.top_rules_labelled(rules, 1).first()
    assert lab["rule"] == "a%b → whole milk"


def test_median_is_exact(spark):
    rules = spark.createDataFrame([([str(v)], ["c"], 0.5, float(v), 0.1) for v in (1, 2, 4, 9)], RULE_SCHEMA)
    st = R.rule_statistics(rules).first()
    assert st["lift_median"] == 3.0
    assert st["lift_mean"] == 4.0 and st["lift_min"] == 1.0 and st["lift_max"] == 9.0


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_exact_median_matches_spark_percentile(spark, n):
    import random

    from pyspark.sql import functions as F

    from trolley.functions.quantile import exact_median

    rnd = random.Random(n)
    vals = [float(rnd.randint(0, 50)) for _ in range(n)]  # many ties
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    want = df.select(F.median("x")).first()[0]
    assert exact_median(df, "x").first()[0] == want
