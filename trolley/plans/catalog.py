"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Baskets are orders (``l_orderkey``) of part brands (``lower(trim(p_brand))``),
mined at support 0.005 and confidence 0.1 (``DEFAULT_SPEC``). Arrays are
returned as sorted ``"a, b"`` labels so results compare as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.fixed import DEFAULT_MIN_CONFIDENCE, DEFAULT_MIN_SUPPORT
from trolley.functions.labels import item_label
from trolley.operators import baskets as B
from trolley.operators import cooccur, graph, histogram, items, rules
from trolley.operators.mining import sweep
from trolley.plans.study import DEFAULT_SPEC, BasketSpec, study
from trolley.session import shared_path
from trolley.sources import sinks, tables
from trolley.sources.wide_csv import read_wide_csv

# Parameters of the registered queries.
SWEEP_SETTINGS = [(0.005, 0.1), (0.01, 0.2), (0.02, 0.3), (0.05, 0.5)]
# Cells of a row in the chunked wide layout.
CHUNK_WIDTH = 64
# Support of the mined tables that the loosened ones start from.
LOOSER_FROM = 0.01
SEARCH_NEEDLE = "Brand#3"
# All three explorer filters at once: lift, an explicit support floor, search.
EXPLORE_MIN_LIFT, EXPLORE_MIN_SUPPORT, EXPLORE_NEEDLE = 1.0, 0.006, "BRAND#1"
EVENT_SPEC = BasketSpec(source="events", item="event_type", min_support=0.02, min_confidence=0.3)
TYPE_SPEC = BasketSpec(source="orders", item="p_type", min_support=0.005, min_confidence=0.1)
NAME_SPEC = BasketSpec(source="orders", item="p_name", min_support=0.005, min_confidence=0.1)
# The dashboard's own default thresholds (0.02 / 0.3) on the same baskets;
# derived from the default study's mined tables without re-mining.
DEFAULTS_SPEC = BasketSpec(
    source="orders", item="p_brand", min_support=DEFAULT_MIN_SUPPORT, min_confidence=DEFAULT_MIN_CONFIDENCE
)

Query = Callable[[SparkSession, str], DataFrame]


def _orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines laid out wide (``basket``, ``Item(s)``, ``Item 1`` …, in
    line order); built once per study (its width is one aggregate job)."""

    def build(_s) -> DataFrame:
        lines = tables.order_lines(spark, sf_dir, "p_brand")
        return B.to_wide(lines, "basket", "item", ["line", "item"])

    return study(spark, sf_dir).memo("orders_wide", build)


def fold_wide_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines laid out wide and folded back:
    ``(basket_id, n_items, items)``, raw item text."""
    folded = B.fold_wide(_orders_wide(spark, sf_dir), id_col="basket")
    return folded.select(
        "basket_id",
        F.size("items").cast("long").alias("n_items"),
        F.array_join("items", ", ").alias("items"),
    )


def wide_csv_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide-CSV path end to end: order lines written as a wide CSV (one
    row per order: ``basket``, ``Item(s)``, ``Item 1`` …) into a fresh folder
    under the shared checkpoint folder, read back with the wide-CSV reader,
    folded and cleaned: ``(basket_id, basket_size, items)``. The CSV is
    written once per study and removed when the study is released."""

    def build(s) -> DataFrame:
        folder = shared_path(spark, "wide-csv")
        s.folders.append(folder)
        sinks.write_csv(_orders_wide(spark, sf_dir), folder)
        back = read_wide_csv(spark, folder)
        cleaned = B.clean(B.fold_wide(back, id_col="basket"))
        return cleaned.select(
            "basket_id", F.size("items").cast("long").alias("basket_size"), item_label("items").alias("items")
        )

    return study(spark, sf_dir).memo("wide_csv_baskets", build)


def clean_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = study(spark, sf_dir).baskets
    return b.select("basket_id", F.size("items").cast("long").alias("basket_size"), item_label("items").alias("items"))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study(spark, sf_dir)
    return items.overview(s.baskets, s.item_counts, s.mined.itemsets, s.mined.rules)


def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir).item_counts


def top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = items.top_items(study(spark, sf_dir).item_counts)
    return t.select(F.col("rank").cast("long").alias("rank"), "item", "count")


def item_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.item_statistics(study(spark, sf_dir).item_counts)


def top10_item_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = items.top_item_share(study(spark, sf_dir).item_counts)
    return t.select(F.col("rank").cast("long").alias("rank"), "item", "count", "percent_of_top")


def basket_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.basket_size_distribution(study(spark, sf_dir).baskets)


def _itemsets(spec: BasketSpec) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        fi = study(spark, sf_dir, spec).mined.itemsets
        return fi.select(item_label("items").alias("items"), F.size("items").cast("long").alias("size"), "freq")

    return q


def _rules(spec: BasketSpec) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sinks.rules_export_frame(study(spark, sf_dir, spec).mined.rules)

    return q


frequent_itemsets = _itemsets(DEFAULT_SPEC)
association_rules = _rules(DEFAULT_SPEC)


def _at_defaults(spark: SparkSession, sf_dir: str):
    return study(spark, sf_dir).mined.filtered(DEFAULTS_SPEC.min_support, DEFAULTS_SPEC.min_confidence)


def frequent_itemsets_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    fi = _at_defaults(spark, sf_dir).itemsets
    return fi.select(item_label("items").alias("items"), F.size("items").cast("long").alias("size"), "freq")


def association_rules_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rules_export_frame(_at_defaults(spark, sf_dir).rules)


def _loosened(spark: SparkSession, sf_dir: str):
    """Mined at twice the study's support, then loosened to it: no second fit."""

    def build(s):
        return s.mined.filtered(LOOSER_FROM, 0.5).loosened(
            s.baskets, s.item_counts, DEFAULT_SPEC.min_support, DEFAULT_SPEC.min_confidence
        )

    return study(spark, sf_dir).memo("loosened", build)


def frequent_itemsets_loosened(spark: SparkSession, sf_dir: str) -> DataFrame:
    fi = _loosened(spark, sf_dir).itemsets
    return fi.select(item_label("items").alias("items"), F.size("items").cast("long").alias("size"), "freq")


def association_rules_loosened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rules_export_frame(_loosened(spark, sf_dir).rules)


def mine_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study(spark, sf_dir)
    return sweep(s.baskets, SWEEP_SETTINGS, mined=s.mined)


def top_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.top_itemsets(study(spark, sf_dir).mined.itemsets)


def top_rules_by_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.top_rules(study(spark, sf_dir).mined.rules)


def top_rules_by_lift_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.top_rules_labelled(study(spark, sf_dir).mined.rules)


def explore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.explore(study(spark, sf_dir).mined.rules)


def explore_rules_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.explore_count(study(spark, sf_dir).mined.rules)


def explore_rules_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.explore(study(spark, sf_dir).mined.rules, EXPLORE_MIN_LIFT, EXPLORE_MIN_SUPPORT, EXPLORE_NEEDLE)


def search_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.search(study(spark, sf_dir).mined.rules, SEARCH_NEEDLE)


def rule_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_insight(study(spark, sf_dir).mined.rules)


def support_confidence_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.support_confidence_points(study(spark, sf_dir).mined.rules)


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = study(spark, sf_dir).memo("rule_statistics", lambda s: rules.rule_statistics(s.mined.rules))
    rounded = {"lift_mean", "lift_median", "confidence_mean", "support_mean"}
    return st.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in st.columns])


def _histogram(measure: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return histogram.histogram(study(spark, sf_dir).mined.rules, measure)

    q.__name__ = f"{measure}_histogram"
    return q


def cooccurrence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study(spark, sf_dir)
    return cooccur.cooccurrence_matrix(s.baskets, s.item_counts)


def cooccurrence_matrix_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix at the slider's largest setting (20 items)."""
    s = study(spark, sf_dir)
    return cooccur.cooccurrence_matrix(s.baskets, s.item_counts, 20)


def top_item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study(spark, sf_dir)
    return cooccur.top_item_pairs(s.baskets, s.item_counts)


def rule_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rule_graph_nodes(study(spark, sf_dir).mined.rules)


def rule_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rule_graph_edges(study(spark, sf_dir).mined.rules)


def rule_graph_edges_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph at the slider's largest setting (50 rules)."""
    return graph.rule_graph_edges(study(spark, sf_dir).mined.rules, 50)


def _exported(name: str, write, schema: str) -> Query:
    """A table written as one CSV file once per study, at a fresh path under the
    shared checkpoint folder, and read back."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        def build(s) -> DataFrame:
            path = shared_path(spark, name) + ".csv"
            s.folders.append(path)
            write(s.mined, path)
            return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)

        return study(spark, sf_dir).memo(name, build)

    q.__name__ = name
    return q


export_rules = _exported(
    "export_rules",
    lambda mined, path: sinks.export_rules(mined.rules, path, single=True),
    "antecedent string, consequent string, confidence double, lift double, support double",
)
export_itemsets = _exported(
    "export_itemsets",
    lambda mined, path: sinks.export_itemsets(mined.itemsets, path, single=True),
    "items string, freq bigint",
)


def wide_cells_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows with padded, blank, missing and tabbed cells, counts below
    the number of cells and rows left empty, made from ``lineitem`` by line
    number and flags, folded and cleaned: ``(basket_id, n_items, items)``."""
    line = F.col("l_linenumber")
    wide = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + line).cast("long").alias("basket"),
        (line % 5).cast("string").alias("Item(s)"),
        F.concat(F.lit("  "), "l_returnflag", F.lit(" ")).alias("Item 1"),
        F.when(line % 3 == 0, "NA").otherwise(F.concat(F.lit("Line "), line.cast("string"))).alias("Item 2"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("\t"), "l_linestatus")).alias("Item 3"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("Item 4"),
    )
    cleaned = B.clean(B.fold_wide(wide, id_col="basket"), min_size=1)
    return cleaned.select(
        "basket_id", F.size("items").cast("long").alias("n_items"), item_label("items").alias("items")
    )


def fold_wide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as one long basket, in rows of ``CHUNK_WIDTH`` cells and folded back:
    ``(basket_id, chunk, n_items, items)``."""

    def build(_s) -> DataFrame:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
            "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("item")
        )
        wide = B.to_wide_chunks(lines, "l_suppkey", "item", ["l_orderkey", "l_linenumber", "item"], CHUNK_WIDTH)
        return B.fold_chunks(wide, "l_suppkey")

    folded = study(spark, sf_dir).memo("wide_chunks", build)
    return folded.select(
        "basket_id", "chunk", F.size("items").cast("long").alias("n_items"), F.array_join("items", ", ").alias("items")
    )


def QUERIES() -> dict[str, Query]:
    return {
        "fold_wide_baskets": fold_wide_baskets,
        "wide_csv_baskets": wide_csv_baskets,
        "wide_cells_with_gaps": wide_cells_with_gaps,
        "fold_wide_chunks": fold_wide_chunks,
        "clean_baskets": clean_baskets,
        "overview": overview,
        "item_counts": item_counts,
        "top_items": top_items,
        "item_statistics": item_statistics,
        "top10_item_share": top10_item_share,
        "basket_size_distribution": basket_size_distribution,
        "frequent_itemsets": frequent_itemsets,
        "association_rules": association_rules,
        "mine_sweep": mine_sweep,
        "top_itemsets": top_itemsets,
        "top_rules_by_lift": top_rules_by_lift,
        "top_rules_by_lift_labelled": top_rules_by_lift_labelled,
        "explore_rules": explore_rules,
        "explore_rules_count": explore_rules_count,
        "explore_rules_searched": explore_rules_searched,
        "search_rules": search_rules,
        "rule_insight": rule_insight,
        "support_confidence_points": support_confidence_points,
        "rule_statistics": rule_statistics,
        "lift_histogram": _histogram("lift"),
        "confidence_histogram": _histogram("confidence"),
        "support_histogram": _histogram("support"),
        "cooccurrence_matrix": cooccurrence_matrix,
        "cooccurrence_matrix_top20": cooccurrence_matrix_top20,
        "top_item_pairs": top_item_pairs,
        "rule_graph_nodes": rule_graph_nodes,
        "rule_graph_edges": rule_graph_edges,
        "rule_graph_edges_top50": rule_graph_edges_top50,
        "export_rules": export_rules,
        "export_itemsets": export_itemsets,
        # Same operators at the dashboard's default thresholds, and on other
        # baskets: long itemsets (part types), many items (part names) and
        # baskets that hold every item (user events).
        "frequent_itemsets_defaults": frequent_itemsets_defaults,
        "association_rules_defaults": association_rules_defaults,
        # The default thresholds again, reached from a stricter result.
        "frequent_itemsets_loosened": frequent_itemsets_loosened,
        "association_rules_loosened": association_rules_loosened,
        "frequent_itemsets_part_types": _itemsets(TYPE_SPEC),
        "association_rules_part_types": _rules(TYPE_SPEC),
        "frequent_itemsets_part_names": _itemsets(NAME_SPEC),
        "association_rules_part_names": _rules(NAME_SPEC),
        "frequent_itemsets_events": _itemsets(EVENT_SPEC),
        "association_rules_events": _rules(EVENT_SPEC),
    }
