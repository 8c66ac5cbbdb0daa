"""Rule-graph tables for the top-R rules by lift.

Nodes are keyed by label. Every item of either side is an ``item`` node; a
side with more than one item is also an ``itemset`` node under its sorted
label. A label reached both ways keeps ``item`` (first type wins, and items
are added first). Edges join the two side labels and carry lift (weight),
confidence and support, plus the styling columns: confidence min-max
normalised over the drawn edges (0.5 when all equal), an 11-step colour
bucket ``int(norm × 10)``, width ``lift × 2.5`` and hover text.

The top-R frame is bounded by R (≤ 50 in the dashboard); its min/max come in
as one scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.fixed import COLOUR_STEPS, EDGE_HOVER, ITEM_NODE_SIZE, ITEMSET_NODE_SIZE, NODE_ITEM, NODE_ITEMSET
from trolley.fixed import DEFAULT_GRAPH_RULES as DEFAULT_TOP_RULES
from trolley.fixed import EDGE_WIDTH_SCALE as WIDTH_SCALE
from trolley.functions.formatting import fixed
from trolley.functions.labels import item_label
from trolley.operators.rules import rule_order


def _top(rules: DataFrame, r: int) -> DataFrame:
    return rules.orderBy(*rule_order()).limit(r)


def rule_graph_nodes(rules: DataFrame, top_rules: int = DEFAULT_TOP_RULES) -> DataFrame:
    """``(node, type, size)`` for the graph of the top-R rules."""
    top = _top(rules, top_rules)
    sides = top.select(F.explode(F.array(F.col("antecedent"), F.col("consequent"))).alias("side"))
    items = sides.select(F.explode("side").alias("node"), F.lit(NODE_ITEM).alias("type"))
    sets = sides.where(F.size("side") > 1).select(item_label("side").alias("node"), F.lit(NODE_ITEMSET).alias("type"))
    # "item" < "itemset": min keeps the first type a label was given.
    nodes = items.unionByName(sets).groupBy("node").agg(F.min("type").alias("type"))
    return nodes.select(
        "node",
        "type",
        F.when(F.col("type") == NODE_ITEM, F.lit(ITEM_NODE_SIZE)).otherwise(F.lit(ITEMSET_NODE_SIZE)).alias("size"),
    )


def rule_graph_edges(rules: DataFrame, top_rules: int = DEFAULT_TOP_RULES) -> DataFrame:
    """``(src, dst, weight, confidence, support, norm_confidence, colour_bucket,
    width, hover)`` for the top-R rules; one edge for each pair of labels.

    Of rules with the same labels the last in rule order (the lowest lift,
    then confidence, then support) gives the edge."""
    found = _top(rules, top_rules).select(
        item_label("antecedent").alias("src"), item_label("consequent").alias("dst"), F.struct("lift", "confidence", "support").alias("m")
    )
    top = found.groupBy("src", "dst").agg(F.min("m").alias("m")).select("src", "dst", "m.*")
    span = top.agg(
        F.struct(
            F.coalesce(F.min("confidence"), F.lit(0.0)).alias("lo"),
            F.coalesce(F.max("confidence"), F.lit(1.0)).alias("hi"),
        ).alias("span")
    ).scalar()
    spanned = top.select("src", "dst", "lift", "confidence", "support", span.alias("span"))
    lo, hi = F.col("span.lo"), F.col("span.hi")
    norm = F.when(hi - lo > 0, (F.col("confidence") - lo) / (hi - lo)).otherwise(F.lit(0.5))
    normed = spanned.select("src", "dst", "lift", "confidence", "support", norm.alias("norm"))
    hover = F.format_string(
        EDGE_HOVER,
        F.col("src"),
        F.col("dst"),
        fixed(F.col("lift"), 2),
        fixed(F.col("confidence"), 2),
        fixed(F.col("support"), 3),
    )
    return normed.select(
        "src",
        "dst",
        F.col("lift").alias("weight"),
        "confidence",
        "support",
        F.col("norm").alias("norm_confidence"),
        F.floor(F.col("norm") * F.lit(COLOUR_STEPS - 1)).cast("int").alias("colour_bucket"),
        (F.col("lift") * F.lit(WIDTH_SCALE)).alias("width"),
        hover.alias("hover"),
    )
