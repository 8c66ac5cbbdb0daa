"""Column-level helpers (pure Spark expressions, no UDFs)."""

from trolley.functions.labels import (
    item_label,
    items_contain,
    normalize_item,
    pair_label,
    rule_label,
)

__all__ = ["item_label", "items_contain", "normalize_item", "pair_label", "rule_label"]
