"""Item normalisation, labels and search predicates as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trolley.fixed import ITEM_SEPARATOR, PAIR_SEPARATOR, RULE_ARROW


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_item(c: Column | str) -> Column:
    """Trim spaces (only spaces: a tab stays) and lower-case one item."""
    return F.lower(F.trim(_col(c)))


def item_label(items: Column | str) -> Column:
    """Set label ``"a, b"``: items sorted, joined with ``", "``."""
    return F.array_join(F.sort_array(_col(items)), ITEM_SEPARATOR)


def rule_label(antecedent: Column | str, consequent: Column | str) -> Column:
    """Rule label ``"a, b → c"``."""
    return F.concat(item_label(antecedent), F.lit(RULE_ARROW), item_label(consequent))


def pair_label(first: Column | str, second: Column | str) -> Column:
    """Pair label ``"a & b"``."""
    return F.concat_ws(PAIR_SEPARATOR, _col(first), _col(second))


def items_contain(items: Column | str, needle: str) -> Column:
    """Any item contains ``needle`` as a literal substring (no pattern syntax)."""
    lit = F.lit(needle)
    return F.exists(_col(items), lambda x: F.contains(x, lit))
