"""Wide-CSV fold and cleaning semantics (one rule per fixture row)."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trolley.operators.baskets import bad_count_rows, clean, fold_wide, from_lines
from trolley.sources.wide_csv import read_wide_csv

HEADER = "Item(s),Item 1,Item 2,Item 3\n"


def fold_csv(spark, tmp_path, body, name="t.csv", **kw):
    p = tmp_path / name
    p.write_text(HEADER + body)
    wide = read_wide_csv(spark, str(p))
    return fold_wide(wide, **kw)


def folded_rows(df):
    return sorted(tuple(r["items"]) for r in df.collect())


def test_fold_rules(spark, tmp_path):
    body = (
        "2,Milk, milk ,\n"
        "3,Bread,NA,Eggs\n"
        "1,Butter,Jam,\n"
        "3,tea\t,TEA,\n"
        '2," ",coffee,\n'
        "2,null,none,x\n"
        '3,"ham, cheese",Bread,Bread\n'
        "0,a,b,\n"
        "-1,a,b,\n"
        "2.0,a,b,\n"
    )
    got = folded_rows(fold_csv(spark, tmp_path, body))
    assert got == sorted(
        [
            ("Milk", " milk "),
            ("Bread", "Eggs"),
            ("Butter",),
            ("tea\t", "TEA"),
            (" ", "coffee"),
            ("none",),
            ("ham, cheese", "Bread", "Bread"),
            ("a", "b"),
        ]
    )


def test_clean_rules(spark, tmp_path):
    body = (
        "2,Milk, milk ,\n"
        "3,Bread,NA,Eggs\n"
        "1,Butter,Jam,\n"
        "3,tea\t,TEA,\n"
        '2," ",coffee,\n'
        "2,null,none,x\n"
        '3,"ham, cheese",Bread,Bread\n'
        "2.0,a,b,\n"
    )
    folded = fold_csv(spark, tmp_path, body)
    got = sorted(tuple(r["items"]) for r in clean(folded).collect())
    assert got == sorted(
        [
            ("bread", "eggs"),
            ("tea", "tea\t"),
            ("", "coffee"),
            ("bread", "ham, cheese"),
            ("a", "b"),
        ]
    )
    dropped = sorted(tuple(r["items"]) for r in clean(folded, drop_blank=True).collect())
    assert ("", "coffee") not in dropped and len(dropped) == 4


def test_short_row_is_filled(spark, tmp_path):
    got = folded_rows(fold_csv(spark, tmp_path, "2,a,b\n"))
    assert got == [("a", "b")]


@pytest.mark.parametrize(
    "body",
    [
        ",a,b,\n",  # missing count
        "x,a,b,\n",  # count not a number
        "NaN,a,b,\n",  # count is a missing word
        "nan,a,b,\n",  # idem
        "4,a,b,c\n",  # count above the item columns
        "2,a,b,c,d\n",  # more cells than the header
    ],
)
def test_bad_rows_raise(spark, tmp_path, body):
    with pytest.raises(PySparkException):
        fold_csv(spark, tmp_path, body).collect()


def test_bad_count_can_be_dropped(spark, tmp_path):
    got = folded_rows(fold_csv(spark, tmp_path, ",a,b,\nx,a,b,\n2,c,d,\n", on_bad_count="drop"))
    assert got == [("c", "d")]
    p = tmp_path / "t.csv"
    assert bad_count_rows(read_wide_csv(spark, str(p))).count() == 2


def test_checks_survive_pruning(spark, tmp_path):
    # Counting rows only must still evaluate the row checks.
    with pytest.raises(PySparkException):
        fold_csv(spark, tmp_path, "4,a,b,c\n").count()


def test_from_lines_equals_clean_of_collected(spark):
    lines = spark.createDataFrame(
        [(1, " A"), (1, "a"), (1, "b"), (2, "x"), (2, None), (3, "p"), (3, "Q "), (3, "q")],
        "basket long, item string",
    )
    got = sorted((r["basket_id"], tuple(r["items"])) for r in from_lines(lines, "basket", "item").collect())
    raw = lines.groupBy(F.col("basket").alias("basket_id")).agg(F.collect_list("item").alias("items"))
    exp = sorted((r["basket_id"], tuple(r["items"])) for r in clean(raw).collect())
    assert got == exp == [(1, ("a", "b")), (3, ("p", "q"))]


def test_gap_in_item_columns_is_rejected(spark, tmp_path):
    p = tmp_path / "gap.csv"
    p.write_text("Item(s),Item 1,Item 3\n2,a,b\n")
    with pytest.raises(ValueError):
        fold_wide(read_wide_csv(spark, str(p)))


def test_to_wide_is_as_wide_as_the_largest_basket(spark):
    from trolley.operators.baskets import to_wide

    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")], "basket long, line int, item string")
    wide = to_wide(lines, "basket", "item", ["line"])
    rows = {r["basket"]: (r["Item(s)"], r["Item 1"], r["Item 2"], r["Item 3"]) for r in wide.collect()}
    assert rows == {1: (3, "a", "b", "c"), 2: (1, "d", None, None)}


def test_quoted_newline_needs_multi_line(spark, tmp_path):
    p = tmp_path / "ml.csv"
    p.write_text('Item(s),Item 1,Item 2\n2,"whole\nmilk",bread\n2,tea,jam\n')
    folded = fold_wide(read_wide_csv(spark, str(p), multi_line=True))
    assert folded_rows(folded) == sorted([("whole\nmilk", "bread"), ("tea", "jam")])


@pytest.mark.parametrize("body", ["2,a,b,c,\n", '2,"x,y",b,,\n'])
def test_empty_extra_cell_is_an_error_like_pandas(spark, tmp_path, body):
    with pytest.raises(PySparkException):
        fold_csv(spark, tmp_path, body).collect()


def test_quoted_commas_and_doubled_quotes(spark, tmp_path):
    got = folded_rows(fold_csv(spark, tmp_path, '2,"x,y",b,\n3,"q""r",s,t\n'))
    assert got == sorted([("x,y", "b"), ('q"r', "s", "t")])


def test_csv_round_trip_with_quotes_and_commas(spark, tmp_path):
    from trolley.sources.sinks import write_csv

    wide = spark.createDataFrame(
        [(1, 2, 'say "hi"', "a, b", None), (2, 3, "x", "y", "z")],
        "basket long, `Item(s)` int, `Item 1` string, `Item 2` string, `Item 3` string",
    )
    out = str(tmp_path / "rt")
    write_csv(wide, out)
    back = fold_wide(read_wide_csv(spark, out), id_col="basket")
    assert sorted((r["basket_id"], tuple(r["items"])) for r in back.collect()) == [
        (1, ('say "hi"', "a, b")),
        (2, ("x", "y", "z")),
    ]


def test_clean_drops_null_items(spark):
    df = spark.createDataFrame([(1, ["A", None, "b"]), (2, [None, "x"]), (3, None)], "basket_id long, items array<string>")
    got = sorted((r["basket_id"], tuple(r["items"])) for r in clean(df).collect())
    assert got == [(1, ("a", "b"))]


def test_from_lines_keeps_text_basket_ids(spark):
    lines = spark.createDataFrame(
        [("T1", "a"), ("T1", "b"), ("T2", "a"), ("T2", "c"), (None, "x"), (None, "y")], "basket string, item string"
    )
    got = sorted((r["basket_id"], tuple(r["items"])) for r in from_lines(lines, "basket", "item").collect())
    assert got == [("T1", ("a", "b")), ("T2", ("a", "c"))]


def test_to_wide_takes_a_very_long_basket(spark):
    from trolley.operators.baskets import to_wide

    lines = spark.range(5000).selectExpr("1L as basket", "id as line", "concat('i', id) as item")
    wide = to_wide(lines, "basket", "item", ["line"])
    row = wide.select("`Item(s)`", "`Item 1`", "`Item 5000`").first()
    assert tuple(row) == (5000, "i0", "i4999")


def test_a_quote_inside_a_field_opens_nothing(spark, tmp_path):
    """Inch marks are plain characters: the row has one cell too many."""
    p = tmp_path / "inch.csv"
    p.write_text('Item(s),Item 1,Item 2,Item 3\n2,a,b,\n3,5" a,6" b,c,d\n')
    with pytest.raises(Exception, match="more cells than the header"):
        fold_wide(read_wide_csv(spark, str(p))).collect()
    p.write_text('Item(s),Item 1,Item 2,Item 3\n3,5" a,6" b,c\n1,"say ""x, y""",,\n')
    got = [r["items"] for r in fold_wide(read_wide_csv(spark, str(p))).collect()]
    assert got == [['5" a', '6" b', "c"], ['say "x, y"']]


@pytest.mark.parametrize("cell", ["2d", "0x1p1", "inf", "-inf", "nan", "1e400", "two", ""])
def test_counts_that_are_no_decimal_numbers(spark, cell):
    rows = spark.createDataFrame([(cell, "a", "b"), ("2.0", "c", "d"), (" 1e0 ", "e", "f")], "`Item(s)` string, `Item 1` string, `Item 2` string")
    with pytest.raises(Exception, match="not a number"):
        fold_wide(rows).collect()
    got = sorted(r["items"] for r in fold_wide(rows, on_bad_count="drop").collect())
    assert got == [["c", "d"], ["e"]]


def test_chunked_wide_rows(spark):
    """Long, short, null and single-line baskets, equal lines and null items, in rows of five cells."""
    from trolley.operators.baskets import CHUNK_COLUMN, clean, clean_chunks, fold_chunks, to_wide_chunks

    rows = [(1, k, f" Item {k % 40} ") for k in range(503)] + [(2, 0, "a"), (2, 0, "a"), (2, 1, None), (3, 0, "x")]
    rows += [(None, k, "n") for k in range(7)]
    lines = spark.createDataFrame(rows, "basket long, line long, item string").repartition(6)
    wide = to_wide_chunks(lines, "basket", "item", ["line", "item"], 5)
    assert [c for c in wide.columns if c.startswith("Item ")] == [f"Item {k}" for k in range(1, 6)]
    got = {}
    for r in wide.collect():
        cells = [r[f"Item {k}"] for k in range(1, 6)][: r["Item(s)"]]
        assert r["Item(s)"] <= 5
        got.setdefault(r["basket"], {})[r[CHUNK_COLUMN]] = cells
    flat = {b: [x for k in range(len(c)) for x in c[k]] for b, c in got.items()}
    assert all(len(x) == 5 for c in got.values() for k, x in c.items() if k + 1 < len(c))
    order = lambda r: (r[1], r[2] is not None, r[2] or "")
    assert flat == {b: [r[2] for r in sorted((r for r in rows if r[0] == b), key=order)] for b in (1, 2, 3, None)}
    chunks = fold_chunks(wide, "basket")
    whole = spark.createDataFrame([(b, [x for x in xs if x is not None]) for b, xs in flat.items() if b is not None], "basket_id long, items array<string>")
    key = lambda r: (r["basket_id"], tuple(r["items"]))
    assert sorted(map(key, clean_chunks(chunks).collect())) == sorted(map(key, clean(whole).collect()))
    assert to_wide_chunks(lines.limit(0), "basket", "item", ["line"], 5).collect() == []
