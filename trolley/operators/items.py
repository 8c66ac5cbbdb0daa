"""Item and basket statistics.

Counts are hash aggregations with map-side partial aggregation, so a hot item
or basket is combined before the shuffle. Top-k is ``orderBy().limit()``
(``TakeOrderedAndProject``: each task keeps k rows); ranks within such a
k-row frame come from its sorted array. Ties are broken by the item name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.fixed import OTHERS, TOP_ITEMS, TOP_SHARE


def item_counts(baskets: DataFrame) -> DataFrame:
    """``(item, count)``: number of baskets holding the item."""
    return baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count"))


def popularity_order():
    return [F.col("count").desc(), F.col("item").asc()]


def top_items(counts: DataFrame, k: int = TOP_ITEMS) -> DataFrame:
    """``(rank, item, count)`` for the k most frequent items (ties by name).

    The k rows of the top-k are gathered into one sorted array (bounded by
    k) and numbered by position, rather than ranked by an unpartitioned window.
    """
    top = counts.orderBy(*popularity_order()).limit(k)
    row = F.struct((-F.col("count")).alias("order"), F.col("item").alias("item"), F.col("count").alias("count"))
    gathered = top.agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return gathered.select(F.posexplode("rows").alias("pos", "row")).select(
        (F.col("pos") + 1).alias("rank"),
        F.col("row.item").alias("item"),
        F.col("row.count").alias("count"),
    )


def item_statistics(counts: DataFrame, k: int = TOP_ITEMS) -> DataFrame:
    """One row: total occurrences, unique items, mean occurrences per item,
    most frequent item, least frequent item within the top k."""
    ranked = top_items(counts, k)
    ends = ranked.agg(
        F.struct(
            F.min_by("item", "rank").alias("most_frequent_item"),
            F.min_by("count", "rank").alias("most_frequent_count"),
            F.max_by("item", "rank").alias("least_frequent_top_item"),
            F.max_by("count", "rank").alias("least_frequent_top_count"),
        ).alias("ends")
    ).scalar()
    totals = counts.agg(
        F.sum("count").cast("long").alias("total_occurrences"),
        F.count(F.lit(1)).alias("unique_items"),
    )
    return totals.select("total_occurrences", "unique_items", ends.alias("ends")).select(
        "total_occurrences",
        "unique_items",
        F.try_divide(F.col("total_occurrences").cast("double"), F.col("unique_items")).alias("avg_occurrence"),
        *[
            F.col("ends").getField(f).alias(f)
            for f in ("most_frequent_item", "most_frequent_count", "least_frequent_top_item", "least_frequent_top_count")
        ],
    )


def top_item_share(counts: DataFrame, k: int = TOP_SHARE, pool: int = TOP_ITEMS) -> DataFrame:
    """Top-k items plus ``Others`` (ranks k+1 … pool, only when its count > 0),
    each with its percentage of the top-``pool`` total.

    ``(rank, item, count, percent_of_top)``; ``Others`` has rank k+1.
    """
    ranked = top_items(counts, pool)
    folded = (
        ranked.select(
            F.least(F.col("rank"), F.lit(k + 1)).alias("rank"),
            F.when(F.col("rank") <= k, F.col("item")).otherwise(F.lit(OTHERS)).alias("item"),
            "count",
        )
        .groupBy("rank", "item")
        .agg(F.sum("count").cast("long").alias("count"))
        .where(F.col("count") > 0)
    )
    total = ranked.select(F.sum("count")).scalar()
    return folded.select(
        "rank",
        "item",
        "count",
        (F.col("count") * F.lit(100.0) / total).alias("percent_of_top"),
    )


def basket_size_distribution(baskets: DataFrame) -> DataFrame:
    """``(basket_size, count)`` ordered by size."""
    return (
        baskets.select(F.size("items").cast("long").alias("basket_size"))
        .groupBy("basket_size")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("basket_size")
    )


def overview(baskets: DataFrame, counts: DataFrame, itemsets: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: transactions, unique items, mean basket size, rules, itemsets."""
    return baskets.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.avg(F.size("items")).alias("avg_basket_size"),
    ).select(
        "transactions",
        counts.select(F.count(F.lit(1))).scalar().alias("unique_items"),
        "avg_basket_size",
        rules.select(F.count(F.lit(1))).scalar().alias("total_rules"),
        itemsets.select(F.count(F.lit(1))).scalar().alias("total_itemsets"),
    )
