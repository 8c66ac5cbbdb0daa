"""Every registered query against its DuckDB twin (small scale factor)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from trolley.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    return float(repr(v)) if isinstance(v, float) and not math.isnan(v) else v


def _rows(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES()) == set(oracle.ORACLES())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = df.collect()
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    exp = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(got, df.columns) == _rows(exp, ocols)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = dict(zip(ocols, (str(d[1]) for d in res.description)))
    assert spark_types == duck_types


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns == ["antecedent", "consequent", "support", "confidence", "lift"]
