"""Plan properties that must hold at any scale."""

from __future__ import annotations

import pytest

from trolley.plans import catalog
from tools.plan_inspect import execute, is_final, operator_counts, read_schemas
from trolley.plans.study import Study

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES()))
def test_no_cartesian_or_nested_loop_join(spark, name):
    df = catalog.QUERIES()[name](spark, SF)
    execute(df)
    assert is_final(df)
    assert operator_counts(df)["nested_loop"] == 0


def test_an_unexecuted_plan_is_not_final(spark):
    df = spark.range(10).groupBy("id").count()
    assert not is_final(df)
    df.write.format("noop").mode("overwrite").save()  # another execution, not this plan's
    assert not is_final(df)
    execute(df)
    assert is_final(df)


def test_basket_build_is_one_shuffle_over_pruned_scans(spark):
    from trolley.operators.baskets import from_lines
    from trolley.sources.tables import order_lines

    # min_size=3: a plan no test caches, so the cache manager cannot stand in for it.
    b = from_lines(order_lines(spark, SF), "basket", "item", min_size=3)
    execute(b)
    assert is_final(b)
    c = operator_counts(b)
    assert c["shuffle"] == 1 and c["scan"] == 2 and c["nested_loop"] == 0
    wanted = {"l_orderkey:bigint", "l_partkey:bigint", "p_partkey:bigint", "p_brand:string"}
    for schema in read_schemas(b):
        assert set(schema.removeprefix("struct<").removesuffix(">").split(",")) <= wanted, schema


def test_cooccurrence_has_no_nested_loop(spark):
    s = Study(spark, SF)
    from trolley.operators.cooccur import cooccurrence_matrix

    df = cooccurrence_matrix(s.baskets, s.item_counts)
    execute(df)
    assert is_final(df)
    c = operator_counts(df)
    assert c["nested_loop"] == 0
    s.release()


def test_wide_cells_are_read_once(spark):
    """One cell expression in the whole plan: filters bring no second copy of it."""
    from trolley.plans.catalog import wide_cells_with_gaps

    df = wide_cells_with_gaps(spark, SF)
    execute(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("raise_error") <= 2 and plan.upper().count(" INSET ") + plan.upper().count(" IN (") <= 4
    assert plan.count("slice(") == 1


def test_median_neither_sorts_nor_shuffles_the_column(spark):
    from trolley.functions.quantile import exact_median

    values = spark.range(5000).selectExpr("cast(id * 7 % 1001 as double) as x")
    df = exact_median(values, "x")
    assert df.first()[0] == values.selectExpr("percentile(x, 0.5)").first()[0]
    plan = df._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "REPARTITION" not in plan
