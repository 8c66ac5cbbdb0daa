"""Co-occurrence of the top-N items.

No pairs are emitted per basket and no self-join is made. Each basket becomes,
in a narrow projection, the sorted positions of the top items it holds;
baskets are counted per distinct array of positions (a hash aggregation
combined map-side), and only these distinct arrays are spread into position
pairs and summed. The code is the same for every N; what is shuffled are
distinct arrays and one partial row per task and pair. The N × N cells come
from the top items themselves, with 0 where no basket holds a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.fixed import DEFAULT_TOP_N, TOP_PAIRS
from trolley.functions.labels import pair_label
from trolley.operators.items import popularity_order


def _top_array(counts: DataFrame, n: int):
    """Scalar subquery: the top-n items as an array in popularity order."""
    top = counts.orderBy(*popularity_order()).limit(n)
    return top.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), F.col("item").alias("item")))),
            lambda s: s.getField("item"),
        ).alias("top")
    ).scalar()


def _pair_counts(baskets: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """``(pos_1, pos_2, item_1, item_2, n)`` for every ordered pair of top
    positions, diagonal 0; there are as many positions as items, at most n."""
    if n < 1:
        raise ValueError("top_n must be positive")
    top = _top_array(counts, n)
    # Project the scalar once so that it is not repeated for every item.
    holding = baskets.select("items", top.alias("top"))
    at = F.transform("items", lambda i: F.array_position("top", i).cast("int") - 1)
    held = F.array_sort(F.filter(at, lambda p: p >= 0))
    # Baskets holding the same top items are counted once.
    distinct = holding.select(held.alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("cnt"))
    sides = distinct.select("cnt", "held", F.explode("held").alias("pos_1"))
    sides = sides.select("cnt", "pos_1", F.explode("held").alias("pos_2")).where("pos_1 <> pos_2")
    sums = sides.groupBy("pos_1", "pos_2").agg(F.sum("cnt").alias("n"))
    rows = baskets.sparkSession.range(1).select(top.alias("top"))
    rows = rows.select("top", F.posexplode("top").alias("pos_1", "item_1"))
    cells = rows.select("pos_1", "item_1", F.posexplode("top").alias("pos_2", "item_2"))
    return cells.join(sums, ["pos_1", "pos_2"], "left").select(
        "pos_1", "pos_2", "item_1", "item_2", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def cooccurrence_matrix(baskets: DataFrame, counts: DataFrame, top_n: int = DEFAULT_TOP_N) -> DataFrame:
    """Square, symmetric ``(item_1, item_2, n)`` over the top-N items, zero diagonal."""
    return _pair_counts(baskets, counts, top_n).select("item_1", "item_2", "n")


def top_item_pairs(baskets: DataFrame, counts: DataFrame, top_n: int = DEFAULT_TOP_N, k: int = TOP_PAIRS) -> DataFrame:
    """``(item_1, item_2, pair, frequency)``: the k most frequent pairs among
    the top-N items with count > 0; ``item_1`` is the more popular item.
    Ties keep popularity order of the pair."""
    cells = _pair_counts(baskets, counts, top_n).where((F.col("pos_1") < F.col("pos_2")) & (F.col("n") > 0))
    return (
        cells.orderBy(F.col("n").desc(), "pos_1", "pos_2")
        .limit(k)
        .select("item_1", "item_2", pair_label("item_1", "item_2").alias("pair"), F.col("n").alias("frequency"))
    )
