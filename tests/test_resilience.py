"""Losing cached blocks after a study is built: views re-read the checkpoint
files instead of re-running the scan, the join or the mining."""

from __future__ import annotations

from trolley.plans import catalog
from trolley.plans.study import study

SF = "/root/testdata/sf0.001"


def test_views_survive_dropped_caches(spark):
    before = {
        name: sorted(map(tuple, catalog.QUERIES()[name](spark, SF).collect()))
        for name in ("overview", "top_rules_by_lift", "cooccurrence_matrix")
    }
    s = study(spark, SF)
    # Drop every cached block of the study (as if the executors holding them were lost).
    for df in (s.baskets, s.item_counts, s.mined.itemsets, s.mined.rules):
        df.unpersist(blocking=True)
    for df in (s.baskets, s.mined.itemsets, s.mined.rules):
        lineage = df.rdd.toDebugString().decode()
        assert "ReliableCheckpointRDD" in lineage
        assert "FileScan" not in lineage and "FPGrowth" not in lineage
    after = {name: sorted(map(tuple, catalog.QUERIES()[name](spark, SF).collect())) for name in before}
    assert after == before
