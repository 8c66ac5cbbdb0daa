"""Number-to-text with Python's fixed-point rounding.

``format_string("%.1f")`` rounds the shortest decimal form half-up
(``1.25 → 1.3``); Python's ``f"{x:.1f}"`` and DuckDB's ``printf`` round the
exact binary value, ties to even (``1.25 → 1.2``, ``2.675 → 2.67`` at two
places). ``format_number`` rounds the same way as Python; its thousands
separators are removed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column, digits: int) -> Column:
    """``f"{x:.{digits}f}"``."""
    return F.regexp_replace(F.format_number(c, digits), ",", "")


def percent(c: Column, digits: int) -> Column:
    """``f"{x:.{digits}%}"``: ``x × 100`` in fixed point, then ``%``."""
    return F.concat(fixed(c * F.lit(100.0), digits), F.lit("%"))
