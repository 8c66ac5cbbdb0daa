"""Rule tables: top-k, explorer filters, search, insight text, statistics.

All are projections, filters, top-k or one-row aggregates over the mined
rules; scalars a filter needs (such as the lowest support) enter as scalar
subqueries, evaluated once and inlined, never as a join of every rule with a
one-row table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.fixed import (
    BUBBLE_SCALE,
    CONFIDENCE_TEXT,
    DEFAULT_MIN_LIFT,
    INSIGHT_ABOVE,
    INSIGHT_BELOW,
    INSIGHT_EQUAL,
    TOP_ITEMSETS,
    TOP_RULES,
    TOP_RULES_CHART,
)
from trolley.functions.formatting import fixed, percent
from trolley.functions.labels import item_label, items_contain, rule_label
from trolley.functions.quantile import exact_median


def rule_order() -> list[Column]:
    """Lift descending, then the labels (mirror rules tie in theory but not in bits)."""
    return [F.col("lift").desc_nulls_last(), item_label("antecedent").asc(), item_label("consequent").asc()]


def labelled(rules: DataFrame) -> DataFrame:
    """``(antecedent, consequent, support, confidence, lift)`` with text labels."""
    return rules.select(
        item_label("antecedent").alias("antecedent"),
        item_label("consequent").alias("consequent"),
        "support",
        "confidence",
        "lift",
    )


def top_rules(rules: DataFrame, k: int = TOP_RULES) -> DataFrame:
    """The k rules of highest lift, labelled."""
    return labelled(rules.orderBy(*rule_order()).limit(k))


def top_rules_labelled(rules: DataFrame, k: int = TOP_RULES_CHART) -> DataFrame:
    """``(rule, lift)`` for the k rules of highest lift; ``rule`` is ``"a, b → c"``."""
    return rules.orderBy(*rule_order()).limit(k).select(
        rule_label("antecedent", "consequent").alias("rule"), "lift"
    )


def top_itemsets(itemsets: DataFrame, k: int = TOP_ITEMSETS) -> DataFrame:
    """``(items, freq)``: the k most frequent itemsets (ties by label)."""
    return (
        itemsets.select(item_label("items").alias("items"), "freq")
        .orderBy(F.col("freq").desc(), F.col("items").asc())
        .limit(k)
    )


def explore_filter(
    rules: DataFrame,
    min_lift: float = DEFAULT_MIN_LIFT,
    min_support: float | None = None,
    search: str = "",
) -> Column:
    """Explorer predicate: lift and support thresholds (0 switches one off)
    and a case-folded literal substring search on either side.

    ``min_support=None`` is the explorer default: the lowest rule support.
    """
    cond = F.lit(True)
    if min_lift > 0:
        cond = cond & (F.col("lift") >= F.lit(float(min_lift)))
    if min_support is None:
        # Every support is at least the lowest one; only a null passes no threshold.
        cond = cond & F.col("support").isNotNull()
    elif min_support > 0:
        cond = cond & (F.col("support") >= F.lit(float(min_support)))
    if search:
        needle = search.lower()
        cond = cond & (items_contain("antecedent", needle) | items_contain("consequent", needle))
    return cond


def explore(
    rules: DataFrame,
    min_lift: float = DEFAULT_MIN_LIFT,
    min_support: float | None = None,
    search: str = "",
) -> DataFrame:
    """Rules passing the explorer filters, labelled."""
    return labelled(rules.where(explore_filter(rules, min_lift, min_support, search)))


def explore_count(
    rules: DataFrame,
    min_lift: float = DEFAULT_MIN_LIFT,
    min_support: float | None = None,
    search: str = "",
) -> DataFrame:
    """One row ``(shown, total)``: one pass over the rules."""
    cond = explore_filter(rules, min_lift, min_support, search)
    return rules.agg(F.count_if(cond).alias("shown"), F.count(F.lit(1)).alias("total"))


def search(rules: DataFrame, needle: str) -> DataFrame:
    """Rules with an item containing ``needle`` (case-folded, literal), no thresholds."""
    return explore(rules, min_lift=0.0, min_support=0.0, search=needle)


def rule_insight(
    rules: DataFrame,
    rule: str | None = None,
    min_lift: float = DEFAULT_MIN_LIFT,
    min_support: float | None = None,
    search: str = "",
) -> DataFrame:
    """Details of one explorer rule: the one labelled ``rule``, or the first
    in explorer order. ``(rule, antecedent, consequent, support, confidence,
    lift, insight, confidence_text)``."""
    picked = rules.where(explore_filter(rules, min_lift, min_support, search))
    if rule is not None:
        picked = picked.where(rule_label("antecedent", "consequent") == F.lit(rule))
    picked = picked.orderBy(*rule_order()).limit(1)
    a = item_label("antecedent")
    c = item_label("consequent")
    insight = (
        F.when(
            F.col("lift") > 1,
            F.format_string(
                INSIGHT_ABOVE,
                a,
                fixed(F.col("lift"), 1),
                c,
            ),
        )
        .when(F.col("lift") == 1, F.format_string(INSIGHT_EQUAL, a, c))
        .otherwise(F.format_string(INSIGHT_BELOW, a, c))
    )
    text = F.format_string(CONFIDENCE_TEXT, percent(F.col("confidence"), 1), a, c)
    return picked.select(
        rule_label("antecedent", "consequent").alias("rule"),
        a.alias("antecedent"),
        c.alias("consequent"),
        "support",
        "confidence",
        "lift",
        insight.alias("insight"),
        text.alias("confidence_text"),
    )


def support_confidence_points(rules: DataFrame) -> DataFrame:
    """Scatter points: support, confidence, lift and bubble size ``lift × 50``."""
    return labelled(rules).withColumn("bubble_size", F.col("lift") * F.lit(BUBBLE_SCALE))


def rule_statistics(rules: DataFrame) -> DataFrame:
    """One row: mean/median/min/max of lift; mean/min/max of confidence and support."""
    median = exact_median(rules, "lift").scalar()
    aggs = [F.avg("lift").alias("lift_mean"), median.alias("lift_median")]
    for m in ("lift", "confidence", "support"):
        if m != "lift":
            aggs.append(F.avg(m).alias(f"{m}_mean"))
        aggs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return rules.agg(*aggs)
