"""Equal-width histograms (numpy ``histogram(values, bins)`` semantics).

Bins run from the minimum to the maximum, the last one closed; when all values
are equal the range is ``[v - 0.5, v + 0.5]``. Edges are ``lo + i × step`` with
``step = (hi - lo) / bins`` and the last edge exactly ``hi``; a value goes to
``floor((v - lo) × bins / (hi - lo))``, then moves down one bin when it lies
below that bin's lower edge and up one when it reaches the next edge (except
in the last bin) — the same rounding-safe placement numpy applies.

The range comes in as one scalar subquery, projected once; counting is a
grouped aggregation with at most ``bins`` groups (partial counts map-side, so
a bin holding most values is combined before the shuffle); the grid of bins
is built from one aggregate row and left-joined, so empty bins are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.fixed import HISTOGRAM_BINS as DEFAULT_BINS


def _range(col: str) -> Column:
    """Aggregate struct ``(lo, hi)`` of the histogram range (null when no rows)."""
    c = F.col(col)
    return F.struct(
        F.when(F.max(c) > F.min(c), F.min(c)).otherwise(F.min(c) - F.lit(0.5)).alias("lo"),
        F.when(F.max(c) > F.min(c), F.max(c)).otherwise(F.max(c) + F.lit(0.5)).alias("hi"),
    )


def _edge(lo: Column, hi: Column, i: Column, bins: int) -> Column:
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i >= F.lit(bins), hi).otherwise(i.cast("double") * step + lo)


def histogram(values: DataFrame, col: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """``(bin, bin_lo, bin_hi, count)`` for ``bins`` bins of ``col``;
    empty when there are no values."""
    if bins < 1:
        raise ValueError("bins must be positive")
    # The range enters once as a column; each later step reads columns, so
    # neither the subquery nor the arithmetic is repeated in the plan.
    span = values.agg(_range(col).alias("b")).scalar()
    ranged = values.where(F.col(col).isNotNull()).select(F.col(col).alias("v"), span.alias("b"))
    lo, hi, v = F.col("b.lo"), F.col("b.hi"), F.col("v")
    first = F.least(F.floor((v - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int"), F.lit(bins - 1))
    step1 = ranged.select("v", "b", first.alias("first"))
    down = F.when(v < _edge(lo, hi, F.col("first"), bins), F.col("first") - 1).otherwise(F.col("first"))
    step2 = step1.select("v", "b", down.alias("down"))
    d = F.col("down")
    placed = F.when((v >= _edge(lo, hi, d + 1, bins)) & (d != F.lit(bins - 1)), d + 1).otherwise(d)
    counts = step2.select(placed.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = (
        values.agg(F.count(F.col(col)).alias("n"), _range(col).alias("b"))
        .where(F.col("n") > 0)
        .select("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    )
    return grid.join(counts, "bin", "left").select(
        "bin",
        _edge(lo, hi, F.col("bin"), bins).alias("bin_lo"),
        _edge(lo, hi, F.col("bin") + 1, bins).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count"),
    )
