"""trolley — market-basket analytics on Spark DataFrames.

Baskets are built from long (basket, item) tables or wide one-row-per-basket
tables, mined for frequent itemsets and association rules by
pattern growth, and summarised into the tables an analyst works from (item and
basket statistics, top-k itemsets and rules, rule filters and explanations,
distributions, co-occurrence and rule-graph tables).

Every operator takes and returns Spark DataFrames; nothing is collected to the
driver except scalars of bounded size.
"""

from trolley.operators.baskets import clean, fold_wide, from_lines
from trolley.operators.mining import MiningParams, MiningResult, mine, sweep
from trolley.plans.study import BasketSpec, Study, study, wide_csv_study
from trolley.sources.wide_csv import read_wide_csv

__all__ = [
    "BasketSpec",
    "MiningParams",
    "MiningResult",
    "Study",
    "clean",
    "fold_wide",
    "from_lines",
    "mine",
    "read_wide_csv",
    "study",
    "sweep",
    "wide_csv_study",
]
