"""Every operator on empty input returns an empty frame or null aggregates."""

from __future__ import annotations

from trolley.operators import cooccur, graph, histogram, items, rules
from trolley.operators.mining import MiningParams, mine, sweep

RULE_SCHEMA = "antecedent array<string>, consequent array<string>, confidence double, lift double, support double"


def test_rule_operators_on_no_rules(spark):
    r = spark.createDataFrame([], RULE_SCHEMA)
    for df in (
        rules.top_rules(r),
        rules.top_rules_labelled(r),
        rules.explore(r),
        rules.search(r, "x"),
        rules.rule_insight(r),
        rules.support_confidence_points(r),
        histogram.histogram(r, "lift"),
        graph.rule_graph_nodes(r),
        graph.rule_graph_edges(r),
    ):
        assert df.count() == 0
    cnt = rules.explore_count(r).first()
    assert (cnt["shown"], cnt["total"]) == (0, 0)
    st = rules.rule_statistics(r).first()
    assert all(v is None for v in st.asDict().values())


def test_pipeline_on_no_baskets(spark, make_baskets):
    b = make_baskets([])
    res = mine(b, MiningParams(0.1, 0.1))
    assert res.n_baskets == 0
    c = items.item_counts(b)
    assert items.top_items(c).count() == 0
    assert rules.top_itemsets(res.itemsets).count() == 0
    assert cooccur.top_item_pairs(b, c).count() == 0
    rows = sweep(b, [(0.1, 0.1), (0.2, 0.5)], mined=res).collect()
    assert sorted((r["n_itemsets"], r["n_rules"]) for r in rows) == [(0, 0), (0, 0)]
