"""A study over a wide CSV: the dashboard's own input path."""

from __future__ import annotations

from trolley.operators import cooccur, items, rules
from trolley.operators.mining import MiningParams
from trolley.plans.study import wide_csv_study


def test_wide_csv_study(spark, tmp_path):
    body = "Item(s),Item 1,Item 2,Item 3\n" + "".join(
        [
            "2,Milk,Bread,\n",
            "2,milk ,bread,\n",
            "3,Milk,Bread,Eggs\n",
            "2,Milk,Eggs,\n",
            "2,Bread,Eggs,\n",
            "1,Tea,,\n",
        ]
    )
    path = tmp_path / "groceries.csv"
    path.write_text(body)
    s = wide_csv_study(spark, str(path), MiningParams(0.2, 0.5))
    ov = items.overview(s.baskets, s.item_counts, s.mined.itemsets, s.mined.rules).first()
    assert (ov["transactions"], ov["unique_items"], ov["total_itemsets"], ov["total_rules"]) == (5, 3, 7, 8)
    top = rules.top_rules(s.mined.rules, 1).first()
    assert top["lift"] < 1  # the five-basket set: every rule has lift below 1
    pairs = cooccur.top_item_pairs(s.baskets, s.item_counts).collect()
    assert [(p["item_1"], p["item_2"], p["frequency"]) for p in pairs][0] == ("bread", "milk", 3)
    s.release()


def test_release_removes_written_folders(spark):
    import os

    from trolley.plans import catalog
    from trolley.plans.study import study

    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES()["wide_csv_baskets"](spark, sf).count() > 0
    s = study(spark, sf)
    folders = list(s.folders)
    assert folders and all(os.path.exists(f.removeprefix("file:")) for f in folders)
    s.release()
    assert not any(os.path.exists(f.removeprefix("file:")) for f in folders)


def test_studies_of_other_thresholds_share_baskets(spark):
    from trolley.plans.study import BasketSpec, release_all, study

    sf = "/root/testdata/sf0.001"
    a = study(spark, sf, BasketSpec(min_support=0.05, min_confidence=0.2))
    b = study(spark, sf, BasketSpec(min_support=0.02, min_confidence=0.5))
    other = study(spark, sf, BasketSpec(item="p_type"))
    assert a is not b and a.baskets is b.baskets and a.item_counts is b.item_counts
    assert other.baskets is not a.baskets
    release_all()


def test_wide_csv_study_options(spark, tmp_path):
    from trolley.operators.mining import MiningParams
    from trolley.plans.study import wide_csv_study

    p = tmp_path / "lines.csv"
    p.write_text('Item(s),Item 1,Item 2\n2,"a\nb",c\nbad,d,e\n2,f,g\n')
    s = wide_csv_study(spark, str(p), MiningParams(0.1, 0.1), multi_line=True, on_bad_count="drop")
    assert sorted(r["items"] for r in s.baskets.collect()) == [["a\nb", "c"], ["f", "g"]]
    s.release()


def test_a_table_written_anew_is_seen(spark, tmp_path):
    """The same folder with other files gives another study; the old one's tables are released."""
    from trolley.plans.study import BasketSpec, release_all, study

    def write(rows):
        spark.createDataFrame(rows, "user_id long, event_type string").write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))

    spec = BasketSpec(source="events", item="event_type", min_support=0.1, min_confidence=0.1)
    write([(1, "a"), (1, "b"), (2, "a"), (2, "b")])
    first = study(spark, str(tmp_path), spec)
    assert first.mined.n_baskets == 2 and study(spark, str(tmp_path), spec) is first
    write([(1, "a"), (1, "c"), (2, "c"), (2, "a"), (3, "a"), (3, "c")])
    second = study(spark, str(tmp_path), spec)
    assert second is not first and second.mined.n_baskets == 3
    assert sorted(r["item"] for r in second.item_counts.collect()) == ["a", "c"]
    release_all()
