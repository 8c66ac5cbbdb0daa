"""Basket construction.

Three ways in, one way out: every function returns ``(basket_id, items)``
where ``items`` is an ``array<string>``.

* ``from_lines`` — long ``(basket, item)`` rows, normalised per row and
  de-duplicated while grouping (``collect_set`` merges map-side, so a hot
  basket is reduced before the shuffle and its array is bounded by the number
  of distinct items, not by its rows).
* ``fold_wide`` — one row per basket with a count column and ``Item 1`` …
  ``Item k`` columns (the reference's CSV layout). Narrow: no shuffle.
* ``fold_chunks`` — the same for baskets too long for a row, laid out in rows
  of a fixed width (``to_wide_chunks``).
* ``clean`` — trims, lower-cases, de-duplicates and keeps baskets with more
  than one item; set semantics, items stored sorted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.fixed import COUNT_COLUMN, ITEM_COLUMN_PATTERN, MIN_BASKET_SIZE, NA_WORDS
from trolley.functions.labels import normalize_item
from trolley.session import materialize

EXTRA_COLUMN = "_extra"
DECIMAL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def missing_to_null(c: Column) -> Column:
    """Null out a cell that is one of the missing-value words."""
    return F.when(~c.isin(*NA_WORDS), c)


def item_columns(df: DataFrame) -> list[str]:
    """``Item 1`` … ``Item k`` in numeric order, taken from the frame's header.

    The numbers must run 1 … k without a gap: a count reaching a missing
    column is an error in the dashboard, so a gap in the header is one here.
    """
    found = []
    for name in df.columns:
        m = re.fullmatch(ITEM_COLUMN_PATTERN, name)
        if m:
            found.append((int(m.group(1)), name))
    found.sort()
    numbers = [k for k, _ in found]
    if numbers != list(range(1, len(found) + 1)):
        raise ValueError(f"item columns must be numbered 1..k without gaps, got {numbers}")
    return [name for _, name in found]


def item_count(c: Column) -> Column:
    """``int(x)`` semantics for the count cell: ``'2.0'`` is 2; whatever is not
    a decimal number (text, a missing word, ``inf``, ``2d``, ``0x1p1``) or does
    not fit an integer is null."""
    text = missing_to_null(c.cast("string"))
    return F.when(text.rlike(DECIMAL), text.try_cast("double").try_cast("int"))


def fold_wide(
    wide: DataFrame,
    count_col: str = COUNT_COLUMN,
    item_cols: list[str] | None = None,
    id_col: str | None = None,
    on_bad_count: str = "raise",
    id_type: str | None = "long",
) -> DataFrame:
    """Fold wide rows into ``(basket_id, items)``.

    ``basket_id`` is ``id_col`` cast to ``id_type`` (``None`` keeps its type;
    a CSV reads every column as text), or a generated id without ``id_col``.

    Only the first ``count`` item columns are read; missing cells (null or an
    NA word) are skipped; rows left with no item are dropped. A count that is
    missing or not a number raises (``on_bad_count="raise"``) or drops the row
    (``"drop"``). A count above the number of item columns, or a non-empty cell
    past the last header column (``_extra``), raises. The checks live inside
    the ``items`` expression so that column pruning cannot remove them.
    """
    if on_bad_count not in ("raise", "drop"):
        raise ValueError("on_bad_count must be 'raise' or 'drop'")
    cols = item_cols if item_cols is not None else item_columns(wide)
    n = item_count(F.col(f"`{count_col}`"))
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in cols]) if cols else F.array().cast("array<string>")

    def read(n: Column) -> Column:
        items = F.when(
            n > F.lit(len(cols)),
            F.raise_error(F.concat(F.lit(f"item count above the {len(cols)} item columns: "), n.cast("string"))),
        )
        if EXTRA_COLUMN in wide.columns:
            items = items.when(
                F.col(EXTRA_COLUMN).isNotNull(),
                F.raise_error(F.lit("row has more cells than the header")),
            )
        if on_bad_count == "raise":
            items = items.when(
                n.isNull(),
                F.raise_error(
                    F.concat(
                        F.lit("item count is not a number: "),
                        F.coalesce(F.col(f"`{count_col}`").cast("string"), F.lit("null")),
                    )
                ),
            )
        given = F.slice(cells, 1, F.greatest(n, F.lit(0)))
        return items.otherwise(F.filter(given, lambda x: missing_to_null(x).isNotNull()))

    # The count is a lambda's variable, so it is read from its cell once.
    items = F.transform(F.array(n), read)

    if id_col:
        basket_id = F.col(f"`{id_col}`").cast(id_type) if id_type else F.col(f"`{id_col}`")
    else:
        basket_id = F.monotonically_increasing_id()
    return wide.select(basket_id.alias("basket_id"), _if(items, lambda x: F.size(x) > 0).alias("items"))


def _if(values: Column, keep) -> Column:
    """The one element of ``values``, for rows where ``keep`` holds for it.

    A generator and no filter behind a projection, which Catalyst would push
    below it together with a second copy of the expression.
    """
    return F.explode(F.filter(values, keep))


def bad_count_rows(wide: DataFrame, count_col: str = COUNT_COLUMN) -> DataFrame:
    """Rows whose count cell is missing or not a number: what
    ``fold_wide(on_bad_count="drop")`` leaves out, for reporting."""
    return wide.where(item_count(F.col(f"`{count_col}`")).isNull())


def clean(
    baskets: DataFrame,
    items_col: str = "items",
    min_size: int = MIN_BASKET_SIZE,
    drop_blank: bool = False,
) -> DataFrame:
    """Trim + lower-case every item, drop null items, keep distinct items,
    keep baskets with at least ``min_size`` items. Items come out sorted (set
    semantics)."""
    items = F.array_distinct(F.filter(F.transform(F.col(items_col), normalize_item), lambda x: x.isNotNull()))
    if drop_blank:
        items = F.filter(items, lambda x: x != F.lit(""))
    others = [c for c in baskets.columns if c != items_col]
    kept = _if(F.array(F.sort_array(items)), lambda x: F.size(x) >= min_size)
    return baskets.select(*others, kept.alias(items_col))


def from_lines(
    lines: DataFrame,
    basket_col: str,
    item_col: str,
    min_size: int = MIN_BASKET_SIZE,
    drop_blank: bool = False,
) -> DataFrame:
    """Clean baskets from long ``(basket, item)`` rows (the basket column keeps
    its type; rows without a basket or an item are skipped).

    Equal to ``clean`` of the collected raw baskets, but the normalisation runs
    per row and duplicates are dropped during the (map-side combined)
    aggregation, so no raw per-basket list is ever built.
    """
    rows = lines.select(
        F.col(basket_col).alias("basket_id"),
        normalize_item(F.col(item_col)).alias("item"),
    ).where(F.col("basket_id").isNotNull() & F.col("item").isNotNull())
    if drop_blank:
        rows = rows.where(F.col("item") != F.lit(""))
    return (
        rows.groupBy("basket_id")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .where(F.size("items") >= min_size)
    )


def to_wide(lines: DataFrame, basket_col: str, item_col: str, order_cols: list[str]) -> DataFrame:
    """Lay long rows out as the wide layout (``Item(s)``, ``Item 1`` …).

    One aggregation gathers a basket's cells in order; it is materialised, the
    width is its largest basket, and every cell is read by index. A row of the
    wide layout holds its whole basket, whatever its length.
    """
    cells = F.sort_array(F.collect_list(F.struct(*order_cols, F.col(item_col).alias("cell"))))
    rows = materialize(lines.groupBy(basket_col).agg(F.transform(cells, lambda x: x["cell"]).alias("cells")))
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    return rows.select(
        basket_col,
        F.size("cells").cast("long").alias(COUNT_COLUMN),
        *[F.get("cells", F.lit(p - 1)).alias(f"Item {p}") for p in range(1, width + 1)],
    )


CHUNK_COLUMN = "Chunk"


def to_wide_chunks(lines: DataFrame, basket_col: str, item_col: str, order_cols: list[str], width: int) -> DataFrame:
    """``to_wide`` for baskets of any size: rows of at most ``width`` cells, numbered from 0 in each basket
    (``Chunk``), each with its own ``Item(s)`` and ``Item 1`` … ``Item width``.

    Lines are range-partitioned by basket and order, so a hot basket spreads
    over tasks; a line's place is its place in its partition plus the basket's
    lines in earlier partitions, from one count for each (basket, partition).
    No task and no row holds a basket.
    """
    if width < 1:
        raise ValueError("width must be positive")
    own = lines.select(F.col(basket_col).alias("b"), F.col(item_col).alias("cell"), F.struct(*order_cols).alias("o"))
    # Equal lines part by a number that is fixed once.
    held = materialize(own.withColumn("row", F.monotonically_increasing_id()))
    ranged = materialize(held.repartitionByRange("b", "o", "row").withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part", "b").orderBy("o", "row"))
    counts = ranged.groupBy("b", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("b", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = before.select(F.col("b").alias("b_"), F.col("part").alias("part_"), "before")
    same = F.col("b").eqNullSafe(F.col("b_")) & (F.col("part") == F.col("part_"))
    placed = ranged.withColumn("inside", inside).join(before, same)
    place = F.col("before") + F.col("inside") - 1
    placed = placed.select("b", F.floor(place / width).alias("chunk"), (place % width).cast("int").alias("at"), "cell")
    cells = F.transform(F.sort_array(F.collect_list(F.struct("at", "cell"))), lambda x: x["cell"])
    rows = placed.groupBy("b", "chunk").agg(cells.alias("cells"))
    return rows.select(
        F.col("b").alias(basket_col),
        F.col("chunk").alias(CHUNK_COLUMN),
        F.size("cells").cast("long").alias(COUNT_COLUMN),
        *[F.get("cells", F.lit(k)).alias(f"Item {k + 1}") for k in range(width)],
    )


def fold_chunks(wide: DataFrame, id_col: str, **options) -> DataFrame:
    """``fold_wide`` of ``to_wide_chunks``' rows: ``(basket_id, chunk, items)``; options are ``fold_wide``'s.

    The chunks of a basket stay apart; ``clean_chunks`` joins them without a raw list of the whole basket.
    """
    key = F.struct(F.col(f"`{id_col}`").alias("basket_id"), F.col(f"`{CHUNK_COLUMN}`").cast("long").alias("chunk"))
    name = "_basket_chunk"
    folded = fold_wide(wide.withColumn(name, key), id_col=name, id_type=None, **options)
    return folded.select("basket_id.basket_id", "basket_id.chunk", "items")


def clean_chunks(chunks: DataFrame, min_size: int = MIN_BASKET_SIZE, drop_blank: bool = False) -> DataFrame:
    """Clean baskets of ``(basket_id, chunk, items)``: what ``clean`` makes of each whole basket."""
    lines = chunks.select("basket_id", F.explode("items").alias("item"))
    return from_lines(lines, "basket_id", "item", min_size, drop_blank)
