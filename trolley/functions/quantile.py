"""Exact median by selection, without sorting or shuffling the column.

A quantile sketch (``percentile_approx``, merged map-side) gives values of
known ranks up to an error; those next to the middle ranks, with a margin above
the error, bracket them. A second sketch of the values inside that bracket
narrows it once more. The values left, counted by distinct value, are a
``GRID``-th of a ``GRID``-th of the column (about ``4 * n / GRID ** 2``, fewer
with ties), and the count of values below the bracket turns their running
counts into ranks, so the result is exact. The same plan serves every size, and
building it runs nothing.

Interpolation follows Spark's ``percentile``: for an even count the median is
``0.5 × lower + 0.5 × upper``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks asked of a sketch, and its accuracy (rank errors are under 1 / ACCURACY of the values).
GRID, ACCURACY = 200, 10_000


def _bracket(values: DataFrame, lo: Column | None = None, hi: Column | None = None) -> Column:
    """struct(n, lo, hi) as a scalar: how many values there are, and two of those
    from ``lo`` to ``hi`` (default: all) that the middle ranks lie between."""
    own = F.col("v") if lo is None else F.when(F.col("v").between(lo, hi), F.col("v"))
    under = F.lit(False) if lo is None else F.col("v") < lo
    found = values.select("v", own.alias("own"), under.alias("under")).agg(
        F.count("v").alias("n"),
        F.count_if("under").alias("below"),
        F.count("own").alias("inside"),
        F.min("own").alias("least"),
        F.max("own").alias("most"),
        F.percentile_approx("own", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("q"),
    )

    def at(rank: Column, margin: int) -> Column:
        share = F.when(F.col("inside") > 0, (rank - F.col("below")) * GRID / F.col("inside"))
        return F.floor(share).cast("int") + margin

    lower, upper = _middle(F.col("n"))
    found = found.select("n", "least", "most", "q", at(lower - 1, -2).alias("low"), at(upper, 3).alias("high"))
    # The ends are the least and the most, whatever the sketch has for them.
    below = F.when(F.col("low") > 0, F.get("q", F.col("low"))).otherwise(F.col("least"))
    above = F.when(F.col("high") < GRID, F.get("q", F.col("high"))).otherwise(F.col("most"))
    return found.select(F.struct("n", below.alias("lo"), above.alias("hi"))).scalar()


def _middle(n: Column) -> tuple[Column, Column]:
    """Ranks (from 1) of the two middle ones of ``n`` values; the same one twice if ``n`` is odd."""
    return F.floor((n + 1) / 2), F.floor(n / 2) + 1


def exact_median(values: DataFrame, col: str, num_partitions: int | None = None) -> DataFrame:
    """One row, one column ``median`` (null when there are no values).

    num_partitions: into how many the values left at the end are counted."""
    v = values.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    first = _bracket(v)
    second = _bracket(v, first["lo"], first["hi"])
    # All values below the bracket are one group, the first.
    left = v.where(F.col("v") <= second["hi"]).select(F.when(F.col("v") >= second["lo"], F.col("v")).alias("v"))
    left = (left.repartition(num_partitions, "v") if num_partitions else left).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    left = left.select("v", F.sum("c").over(Window.orderBy(F.asc_nulls_first("v"))).alias("rank"))
    lower, upper = _middle(second["n"])
    ends = (F.when(F.col("rank") >= rank, F.col("v")).alias(name) for name, rank in (("lower", lower), ("upper", upper)))
    return left.select(*ends).agg((F.lit(0.5) * F.min("lower") + F.lit(0.5) * F.min("upper")).alias("median"))
