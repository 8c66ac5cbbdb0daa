"""Frequent itemsets and association rules by pattern growth.

Single-item counts are reduced across the cluster; baskets shrink to their
frequent items (at most ``mean basket size / min_support`` of them) and equal
ones become one row with a count. Patterns then grow by one item a level: a
row is a pattern, what follows it in a basket, and the baskets alike. No task
holds an item's baskets, and the work follows different baskets, not all.
Where a bound on an item's baskets is asked for, Spark ML's FP-growth mines
the projections. Rules are a join of itemsets with their antecedents.

A mined result answers stricter thresholds by filtering and looser ones by
counting what it doesn't know yet (``MiningResult.filtered``, ``loosened``).

Measures, with N the number of baskets mined (null ``items`` rows are skipped
and leave N):

* ``confidence = freq(A ∪ C) / freq(A)``
* ``lift = confidence / (freq(C) / N)``
* ``support = freq(A ∪ C) / N``

The minimum count is ``ceil(min_support × N)`` (inclusive); consequents have
one item.
"""

from __future__ import annotations

import functools
import logging
import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.fixed import DEFAULT_MIN_CONFIDENCE, DEFAULT_MIN_SUPPORT
from trolley.session import materialize

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class MiningParams:
    """Thresholds; any value in (0, 1] is accepted.

    ``max_group_rows``: an item in more baskets than this is projected out
    before FP-growth, so no item group is as large as its baskets.
    """

    min_support: float = DEFAULT_MIN_SUPPORT
    min_confidence: float = DEFAULT_MIN_CONFIDENCE
    num_partitions: int | None = None
    max_group_rows: int | None = None

    def __post_init__(self) -> None:
        for name in ("min_support", "min_confidence"):
            v = getattr(self, name)
            if not (isinstance(v, (int, float)) and 0 < v <= 1):
                raise ValueError(f"{name} must be in (0, 1], got {v!r}")
        if self.num_partitions is not None and self.num_partitions < 1:
            raise ValueError("num_partitions must be positive")
        if self.max_group_rows is not None and self.max_group_rows < 1:
            raise ValueError("max_group_rows must be positive")

    def min_count(self, n_baskets: int) -> int:
        """Smallest frequency a frequent itemset needs (same double arithmetic as FP-growth)."""
        return int(math.ceil(self.min_support * n_baskets))


@dataclass
class MiningResult:
    """Mined tables; ``itemsets(items, freq)`` and
    ``rules(antecedent, consequent, confidence, lift, support)``; arrays sorted."""

    itemsets: DataFrame
    rules: DataFrame
    n_baskets: int
    params: MiningParams

    def unpersist(self) -> None:
        for df in (self.itemsets, self.rules):
            df.unpersist(blocking=False)

    def filtered(self, min_support: float, min_confidence: float) -> "MiningResult":
        """The result at stricter thresholds, without re-mining.

        Itemsets and rules are monotone in both thresholds: an itemset is kept
        when ``freq >= ceil(s × N)``; a rule when its union is frequent, i.e.
        ``round(support × N) >= ceil(s × N)``, and ``confidence >= c``.
        """
        p = MiningParams(min_support, min_confidence, self.params.num_partitions)
        if min_support < self.params.min_support or min_confidence < self.params.min_confidence:
            raise ValueError("can only tighten thresholds of a mined result")
        k = p.min_count(self.n_baskets)
        itemsets = self.itemsets.where(F.col("freq") >= F.lit(k))
        rules = self.rules.where(
            (F.round(F.col("support") * F.lit(float(self.n_baskets))) >= F.lit(k))
            & (F.col("confidence") >= F.lit(min_confidence))
        )
        return MiningResult(itemsets, rules, self.n_baskets, p)

    def loosened(
        self, baskets: DataFrame, item_counts: DataFrame, min_support: float, min_confidence: float, items_col: str = "items"
    ) -> "MiningResult":
        """The result at looser thresholds, counting only itemsets that aren't known yet.

        baskets: those that were mined; item_counts: ``(item, count)`` over them.
        """
        p = MiningParams(min_support, min_confidence, self.params.num_partitions)
        if min_support > self.params.min_support:
            raise ValueError("the support is stricter than that of the mined result")
        itemsets = _extended(self.itemsets, baskets, item_counts, p.min_count(self.n_baskets), items_col)
        rules = materialize(rules_of(itemsets, self.n_baskets, min_confidence))
        return MiningResult(itemsets, rules, self.n_baskets, p)


def mine(baskets: DataFrame, params: MiningParams, items_col: str = "items", checkpoint: bool = True) -> MiningResult:
    """Mine ``baskets`` (rows of unique-item arrays) for itemsets and rules.

    An uncached input is persisted for the passes made over it. Both
    outputs are materialised (checkpointed when the cluster names a checkpoint
    folder): the rules table is an RDD-backed scan that pruning and pushdown
    cannot reach into, and recomputing it would re-run the mining.
    """
    # A cached input (the usual case: a study's baskets) is read from the cache on each pass.
    owned = None
    level = baskets.storageLevel
    if level.useMemory or level.useDisk:
        data = baskets
    else:
        data = owned = baskets.select(items_col).persist(StorageLevel.MEMORY_AND_DISK)
    # One pass: N, and the mean basket size that bounds the frequent items
    # (item frequencies sum to N × mean, so at most mean / min_support items
    # can reach the minimum count).
    stats = data.where(F.col(items_col).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.size(items_col)).alias("mean")
    ).first()
    n, mean = stats["n"], stats["mean"] or 0.0
    log.info(
        "mining %d baskets (mean size %.2f): min count %d, at most %d frequent items",
        n,
        mean,
        params.min_count(n),
        int(mean / params.min_support),
    )

    if params.max_group_rows:
        itemsets = _projected(data, params, n, items_col)
        rules = materialize(rules_of(itemsets, n, params.min_confidence), reliable=checkpoint)
        if owned is not None:
            owned.unpersist(blocking=False)
        return MiningResult(itemsets, rules, n, params)

    itemsets = _grown(data, params, n, items_col, checkpoint)
    rules = materialize(rules_of(itemsets, n, params.min_confidence), reliable=checkpoint)
    if owned is not None:
        owned.unpersist(blocking=False)
    return MiningResult(itemsets, rules, n, params)


def _grown(data: DataFrame, params: MiningParams, n: int, items_col: str, checkpoint: bool) -> DataFrame:
    """(items, freq) of all itemsets of the minimum count, level by level.

    A row of a level is (items, rest, n): a frequent itemset, the items that
    stand after it in ``n`` baskets and may extend it. Extensions are counted
    before rows of the next level are made, and only frequent ones make any.
    """
    least, num_partitions = params.min_count(n), params.num_partitions
    col = F.col(items_col)
    is_set = F.size(F.array_distinct(col)) == F.size(col)
    given = F.when(~is_set, F.raise_error(F.lit("items of a basket must be unique"))).otherwise(col)
    given = data.where(col.isNotNull()).select(given.alias("items"))
    counts = given.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    counts = materialize(counts.where(F.col("freq") >= least), reliable=False)
    found = [counts.select(F.array("item").alias("items"), "freq")]
    keep = counts.agg(F.collect_set("item")).scalar()  # at most mean basket size / min_support items
    held = given.select(F.sort_array(F.array_intersect("items", keep)).alias("rest")).where(F.size("rest") > 1)
    held = held.groupBy("rest").agg(F.count(F.lit(1)).alias("n"))
    held = materialize(held.repartition(num_partitions, "rest") if num_partitions else held, reliable=False)
    kept = [counts, held]

    def extended(rows: DataFrame, items: Column) -> DataFrame:
        """Rows of the next level: each item of ``rest`` joins the itemset, and those after it stay."""
        each = rows.select(items.alias("before"), "rest", "n", F.posexplode("rest").alias("pos", "item"))
        left = F.slice("rest", F.col("pos") + 2, F.size("rest"))
        made = each.select(F.concat("before", F.array("item")).alias("items"), left.alias("rest"), "n")
        return made.where(F.size("rest") > 0)

    rows = extended(held, F.slice("rest", 1, 0))
    while True:
        more = rows.select("items", F.explode("rest").alias("item"), "n").groupBy("items", "item")
        more = materialize(more.agg(F.sum("n").alias("freq")).where(F.col("freq") >= least), reliable=False)
        kept.append(more)
        if more.isEmpty():
            break
        found.append(more.select(F.concat("items", F.array("item")).alias("items"), "freq"))
        if len(found) > 2:  # those of one item come from ``held`` at once
            rows = materialize(rows.groupBy("items", "rest").agg(F.sum("n").alias("n")), reliable=False)
            kept.append(rows)
        may = more.groupBy("items").agg(F.collect_list("item").alias("may"))
        rows = rows.join(may, "items").select("items", F.array_intersect("rest", "may").alias("rest"), "n")
        rows = extended(rows, F.col("items"))
    # Items are in order as they joined.
    itemsets = materialize(functools.reduce(DataFrame.unionByName, found), reliable=checkpoint)
    for df in kept:
        df.unpersist(blocking=False)
    return itemsets


def _projected(data: DataFrame, params: MiningParams, n: int, items_col: str) -> DataFrame:
    """(items, freq) as FP-growth finds them, with oversized items projected out first.

    FP-growth's task for an item holds the prefixes of all baskets with it, and
    no setting splits that. So an item h in more than ``max_group_rows``
    baskets is taken out: itemsets with h are those of the baskets that hold
    it, mined without it, each with h added, and the rest are mined without h.
    Inside the first, FP-growth's tasks are pairs (h, next item).
    """
    least = params.min_count(n)
    items = data.where(F.col(items_col).isNotNull()).select(F.col(items_col).alias("items"))
    counts = items.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # At most (mean basket size) * baskets / max_group_rows items.
    heavy = counts.where(F.col("n") > params.max_group_rows).orderBy(F.desc("n"), "item").collect()
    found = []
    out = F.array().cast(items.schema["items"].dataType)
    for h in [*heavy, None]:
        own = items.where(F.array_contains("items", h["item"])) if h else items
        out_now = F.concat(out, F.array(F.lit(h["item"]))) if h else out
        size = h["n"] if h else n
        if size >= least > 0:
            fp = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / size))
            if params.num_partitions:
                fp = fp.setNumPartitions(params.num_partitions)
            rest = own.select(F.array_except("items", out_now).alias("items")).persist(StorageLevel.MEMORY_AND_DISK)
            sets = fp.fit(rest).freqItemsets.select("items", F.col("freq").cast("long").alias("freq"))
            if h:
                none = F.array().cast(items.schema["items"].dataType).alias("items")
                sets = sets.unionByName(data.sparkSession.range(1).select(none, F.lit(size).cast("long").alias("freq")))
                sets = sets.select(F.concat("items", F.array(F.lit(h["item"]))).alias("items"), "freq")
            found.append(materialize(sets.select(F.sort_array("items").alias("items"), "freq")))
            rest.unpersist(blocking=False)
        out = out_now
    if not found:
        return items.select("items", F.lit(0).cast("long").alias("freq")).limit(0)
    return functools.reduce(DataFrame.unionByName, found)


def _candidates(frequent: DataFrame, size: int) -> DataFrame:
    """(items): sets of ``size`` items all whose subsets of one item less are among ``frequent`` (sets of size - 1, sorted)."""
    head, tail = F.slice("items", 1, size - 2), F.get("items", F.lit(size - 2))
    sets = frequent.select(head.alias("head"), tail.alias("tail"))
    pairs = sets.join(sets.select("head", F.col("tail").alias("other")), "head").where("tail < other")
    made = pairs.select(F.concat("head", F.array("tail", "other")).alias("items"))
    if size == 2:
        return made
    # The two sets that made a candidate are frequent; the others leave out one item of the head.
    left_out = F.explode(F.slice("items", 1, size - 2)).alias("out")
    subsets = made.select("items", left_out).select("items", F.array_remove("items", F.col("out")).alias("subset"))
    known = subsets.join(frequent.select(F.col("items").alias("subset")), "subset")
    return known.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size - 2).select("items")


def _extended(known: DataFrame, baskets: DataFrame, item_counts: DataFrame, least: int, items_col: str) -> DataFrame:
    """(items, freq) of all itemsets with ``least`` baskets or more, from those ``known`` at a higher count.

    Level by level: candidates are joined from the frequent sets one item
    smaller, known or new; those that are known need no counting. A candidate
    meets the baskets of its rarest item, so a hot item brings its baskets
    into play only for sets of items that are as frequent.
    """
    counts = item_counts.where(F.col("count") >= least).select("item", "count")
    counts = materialize(counts)
    keep = counts.agg(F.collect_set("item")).scalar()  # at most mean basket size / min_support items
    held = baskets.select(F.sort_array(F.array_intersect(items_col, keep)).alias("items")).where(F.size("items") > 1)
    # Equal baskets are compared once.
    held = materialize(held.groupBy("items").agg(F.count(F.lit(1)).alias("n")))
    found = counts.select(F.array("item").alias("items"), F.col("count").cast("long").alias("freq"))
    level, size = found, 1
    while True:
        size += 1
        old = known.where(F.size("items") == size).select("items", "freq")
        new = _candidates(level, size).join(old, "items", "left_anti")
        rarest = new.select("items", F.explode("items").alias("item")).join(counts, "item")
        rarest = rarest.groupBy("items").agg(F.min_by("item", F.struct("count", "item")).alias("item"))
        by_item = held.select(F.col("items").alias("basket"), "n", F.explode("items").alias("item"))
        by_item = by_item.where(F.size("basket") >= size)
        met = by_item.join(rarest, "item").where(F.size(F.array_except("items", "basket")) == 0)
        counted = met.groupBy("items").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
        level = materialize(old.unionByName(counted.select("items", "freq")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return materialize(found)


def rules_of(itemsets: DataFrame, n_baskets: int, min_confidence: float) -> DataFrame:
    """Rules ``(antecedent, consequent, confidence, lift, support)`` of itemsets closed under subsets; one item as consequent."""
    n = F.lit(float(n_baskets))
    own = itemsets.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("item"))
    own = own.select(F.array_remove("items", F.col("item")).alias("antecedent"), F.array("item").alias("consequent"), "freq")
    of = lambda side: itemsets.select(F.col("items").alias(side), F.col("freq").cast("double").alias(f"{side}_freq"))
    own = own.join(of("antecedent"), "antecedent").join(of("consequent"), "consequent")
    confidence = F.col("freq") / F.col("antecedent_freq")
    rules = own.select("antecedent", "consequent", confidence.alias("confidence"), "consequent_freq", "freq")
    return rules.where(F.col("confidence") >= min_confidence).select(
        "antecedent",
        "consequent",
        "confidence",
        (F.col("confidence") / (F.col("consequent_freq") / n)).alias("lift"),
        (F.col("freq") / n).alias("support"),
    )


def sweep(
    baskets: DataFrame,
    settings: list[tuple[float, float]],
    items_col: str = "items",
    mined: MiningResult | None = None,
) -> DataFrame:
    """Itemset and rule counts at several ``(min_support, min_confidence)`` settings.

    Mines once at the loosest setting (or reuses ``mined``) and derives every
    other setting by filtering, in one aggregation pass per table:
    ``(min_support, min_confidence, n_itemsets, n_rules)``.
    """
    if not settings:
        raise ValueError("settings must not be empty")
    lo_s = min(s for s, _ in settings)
    lo_c = min(c for _, c in settings)
    if mined is None:
        mined = mine(baskets, MiningParams(lo_s, lo_c), items_col)
    elif mined.params.min_support > lo_s or mined.params.min_confidence > lo_c:
        raise ValueError("the mined result is stricter than the loosest setting")
    n = float(mined.n_baskets)

    def key(i: int) -> str:
        return f"s{i}"

    set_counts = mined.itemsets.agg(
        *[
            F.count_if(F.col("freq") >= F.lit(MiningParams(s, c).min_count(mined.n_baskets))).alias(key(i))
            for i, (s, c) in enumerate(settings)
        ]
    )
    rule_counts = mined.rules.agg(
        *[
            F.count_if(
                (F.round(F.col("support") * F.lit(n)) >= F.lit(MiningParams(s, c).min_count(mined.n_baskets)))
                & (F.col("confidence") >= F.lit(c))
            ).alias(key(i))
            for i, (s, c) in enumerate(settings)
        ]
    )

    sets = set_counts.select(F.struct("*")).scalar()
    rows = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("min_support"),
                F.lit(float(c)).alias("min_confidence"),
                F.col("sets").getField(key(i)).cast("long").alias("n_itemsets"),
                F.col(key(i)).cast("long").alias("n_rules"),
            )
            for i, (s, c) in enumerate(settings)
        ]
    )
    # A row for each setting as given, repeated ones too.
    return rule_counts.select("*", sets.alias("sets")).select(F.inline(rows))
