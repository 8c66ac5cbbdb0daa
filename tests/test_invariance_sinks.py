"""Invariance under repartitioning / row order, and the export sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trolley.operators.baskets import from_lines
from trolley.operators.mining import MiningParams, mine
from trolley.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def _rules(res):
    return sorted(
        (tuple(r["antecedent"]), tuple(r["consequent"]), r["confidence"], r["lift"], r["support"])
        for r in res.rules.collect()
    )


def test_repartition_and_shuffle_invariance(spark):
    lines = tables.order_lines(spark, SF)
    a = mine(from_lines(lines, "basket", "item"), MiningParams(0.01, 0.2))
    shuffled = lines.repartition(7).orderBy(F.rand(11))
    b = mine(from_lines(shuffled, "basket", "item"), MiningParams(0.01, 0.2, num_partitions=3))
    assert _rules(a) == _rules(b)
    assert sorted(map(tuple, a.itemsets.collect())) == sorted(map(tuple, b.itemsets.collect()))
    a.unpersist()
    b.unpersist()


def test_export_round_trip(spark, tmp_path):
    lines = tables.order_lines(spark, SF)
    res = mine(from_lines(lines, "basket", "item"), MiningParams(0.01, 0.2))
    out = str(tmp_path / "rules_csv")
    sinks.export_rules(res.rules, out)
    back = spark.read.option("header", True).option("inferSchema", True).csv(out)
    assert back.columns == ["antecedent", "consequent", "confidence", "lift", "support"]
    assert back.count() == res.rules.count()
    frame = sinks.rules_export_frame(res.rules)
    assert sorted(r["antecedent"] + "|" + r["consequent"] for r in back.collect()) == sorted(
        r["antecedent"] + "|" + r["consequent"] for r in frame.collect()
    )
    pq = str(tmp_path / "itemsets_pq")
    sinks.export_itemsets(res.itemsets, pq, fmt="parquet")
    assert spark.read.parquet(pq).schema["items"].dataType.simpleString() == "array<string>"
    csv = str(tmp_path / "itemsets_csv")
    sinks.export_itemsets(res.itemsets, csv)
    assert spark.read.option("header", True).csv(csv).count() == res.itemsets.count()
    res.unpersist()


def test_rules_parquet_keeps_arrays(spark, tmp_path):
    lines = tables.order_lines(spark, SF)
    res = mine(from_lines(lines, "basket", "item"), MiningParams(0.01, 0.2))
    out = str(tmp_path / "rules_pq")
    sinks.export_rules(res.rules, out, fmt="parquet")
    back = spark.read.parquet(out)
    assert back.schema["antecedent"].dataType.simpleString() == "array<string>"
    assert sorted(map(tuple, back.select("confidence", "lift", "support").collect())) == sorted(
        map(tuple, res.rules.select("confidence", "lift", "support").collect())
    )
    res.unpersist()


def test_views_invariant_under_repartitioning(spark):
    from trolley.operators import cooccur, histogram, items
    from trolley.plans.study import Study

    lines = tables.order_lines(spark, SF)
    shuffled = lines.repartition(5).orderBy(F.rand(3))
    params = MiningParams(0.01, 0.2)

    def views(frame):
        s = Study.of_baskets(from_lines(frame, "basket", "item"), params)
        out = {
            "counts": items.item_counts(s.baskets),
            "share": items.top_item_share(s.item_counts),
            "cooccur": cooccur.cooccurrence_matrix(s.baskets, s.item_counts),
            "hist": histogram.histogram(s.mined.rules, "lift"),
        }
        got = {k: sorted(map(tuple, v.collect())) for k, v in out.items()}
        s.release()
        return got

    assert views(lines) == views(shuffled)


def test_one_csv_file(spark, tmp_path):
    """One file with one header, its rows in the parts' order; written anew, refused, left, and without rows."""
    import csv as python_csv

    import pytest

    rows = [(f'say "{k}", twice\nor more', k, None if k % 3 else 0.5 * k) for k in range(100)]
    frame = spark.createDataFrame(rows, "label string, n long, x double").coalesce(1).repartition(5, "n").sortWithinPartitions("n")
    path = tmp_path / "rules.csv"
    sinks.write_csv_file(frame, str(path))
    assert path.is_file() and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["rules.csv"]
    with open(path, newline="") as file:
        got = list(python_csv.reader(file))
    assert got[0] == ["label", "n", "x"] and len(got) == 101
    assert sorted((a, int(n), float(x) if x else None) for a, n, x in got[1:]) == sorted(rows, key=lambda r: r[0])
    sinks.write_csv_file(frame.limit(0), str(path))
    assert path.read_text() == "label,n,x\n"
    sinks.write_csv_file(frame, str(path), mode="ignore")
    assert path.read_text() == "label,n,x\n"
    with pytest.raises(FileExistsError):
        sinks.write_csv_file(frame, str(path), mode="error")
