"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are dealt to blocks, the number of rows that each block sends to each
shard is drawn exactly (multivariate hypergeometric, as a uniform permutation
of all rows would make it), each block is permuted and cut by its matrix row,
rows are exchanged, and each shard is permuted again. Shard sizes differ by
one at most and every assignment with these sizes is equally likely.

Everything is DataFrame and SQL functions. Blocks and the parts in which a
shard is permuted hold about ``ROWS_PER_BLOCK`` rows whatever the table's size,
so no task sorts a whole shard; they follow hashes of row numbers, not of
values, so copies and hot keys don't meet in one task.

Defined results: null ids and texts, repeated rows and ties are rows like any
other; an empty table gives an empty result; all columns stay, except that
``shard``, ``slot`` replace columns of these names (compared without case).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trolley.llm.shared import free_name, settle, table

#: Rows of a block, and of a part of a shard, on average.
ROWS_PER_BLOCK = 2048
#: Children drawn for one node of the tree of blocks (a power of two, 2 ** FAN_BITS).
FAN_BITS = 5
SEED = 20261


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) that the key decides."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *key), 11)
    return (bits + F.lit(0.5)) / F.lit(float(2**53))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The good ones among ``draws`` of ``total`` rows, ``good`` of them good, as the uniform ``u`` decides.

    Inverts the distribution from its mode outwards, each weight from the one
    before. Terms 12 standard deviations out are under the resolution of ``u``
    and left out, so the work follows the deviation, not the counts.
    """
    t, g, n = (x.cast("double") for x in (total, good, draws))
    share = g / F.greatest(t, F.lit(1.0))
    given = F.struct(
        t.alias("t"), g.alias("g"), n.alias("n"), u.alias("u"),
        F.floor((n + 1) * (g + 1) / (t + 2)).alias("mode"),
        F.greatest(F.lit(0.0), n - (t - g)).alias("low"),
        F.least(g, n).alias("high"),
        F.ceil(F.sqrt(n * share * (1 - share)) * 12 + 12).alias("far"),
    )

    def outwards(f: Column) -> Column:
        def weights(up: bool) -> Callable[[Column, Column], Column]:
            def ratio(i: Column) -> Column:
                """Weight of the number after the i-th from the mode, over that of the i-th."""
                if up:
                    k = f["mode"] + i
                    return (f["g"] - k) * (f["n"] - k) / ((k + 1) * (f["t"] - f["g"] - f["n"] + k + 1))
                k = f["mode"] - i
                return k * (f["t"] - f["g"] - f["n"] + k) / ((f["g"] - k + 1) * (f["n"] - k + 1))

            return lambda a, i: _let(a["w"] * ratio(i), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s")))

        def steps(up: bool) -> Column:
            bound = f["high"] - f["mode"] if up else f["mode"] - f["low"]
            count = F.least(f["far"], bound).cast("int")
            return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

        def summed(up: bool) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
            return F.aggregate(steps(up), start, weights(up))["s"]

        def passed(up: bool, start: Column, target: Column) -> Column:
            """How many numbers out from the mode the summed weights pass the target."""

            def step(a: Column, i: Column) -> Column:
                grown = _let(
                    weights(up)(a, i),
                    lambda x: F.struct(
                        x["w"].alias("w"), x["s"].alias("s"), (a["j"] + F.when(a["s"] > target, 0).otherwise(1)).alias("j")
                    ),
                )
                return F.when(a["s"] > target, a).otherwise(grown)

            zero = F.struct(F.lit(1.0).alias("w"), start.alias("s"), F.lit(0).alias("j"))
            return F.aggregate(steps(up), zero, step)["j"]

        return _let(
            F.struct(summed(True).alias("up"), summed(False).alias("down")),
            lambda sums: _let(
                f["u"] * (sums["up"] + sums["down"] + 1),
                lambda target: F.when(
                    target <= sums["up"] + 1, f["mode"] + passed(True, F.lit(1.0), target)
                ).otherwise(f["mode"] - passed(False, sums["up"] + 1, target)),
            ),
        ).cast("long")

    return _let(given, outwards)


def _drawn(seed: int, level: int) -> Column:
    """For one node of the tree: by child, the rows it sends to each shard.

    Columns: node, caps (the node's rows by shard), kids (its rows by child).
    """
    none = F.array().cast("array<bigint>")

    def child(state: Column, kid: Column) -> Column:
        def one(b: Column, s: Column) -> Column:
            cap = F.get(state["caps"], s)
            u = _uniform(seed, F.lit(level), F.col("node"), state["at"], s)
            return _let(
                hypergeometric(b["total"], cap, b["left"], u),
                lambda x: F.struct(
                    (b["left"] - x).alias("left"), (b["total"] - cap).alias("total"), F.concat(b["row"], F.array(x)).alias("row")
                ),
            )

        total = F.aggregate(state["caps"], F.lit(0).cast("long"), lambda p, q: p + q)
        zero = F.struct(kid.alias("left"), total.alias("total"), none.alias("row"))
        row = F.aggregate(F.sequence(F.lit(0), F.size(state["caps"]) - 1), zero, one)["row"]
        return _let(
            row,
            lambda r: F.struct(
                F.zip_with(state["caps"], r, lambda p, q: p - q).alias("caps"),
                (state["at"] + 1).alias("at"),
                F.concat(state["rows"], F.array(r)).alias("rows"),
            ),
        )

    start = F.struct(F.col("caps"), F.lit(0).alias("at"), F.array().cast("array<array<bigint>>").alias("rows"))
    return F.aggregate("kids", start, child)["rows"]


def communication_matrix(counts: DataFrame, sizes: list[int], bits: int, seed: int = SEED) -> DataFrame:
    """(block, sends): how many rows each block sends to each shard.

    counts: (block, n) for block numbers under 2 ** bits; sizes: rows of each
    shard, which add up to those of all blocks. Drawn down a tree of blocks,
    ``2 ** FAN_BITS`` children at a time; nodes of one level are independent rows.
    """
    spark = counts.sparkSession
    empty = "cast(array() as array<bigint>)"
    tree = spark.range(1).select(
        F.col("id").alias("node"), F.expr(f"array({', '.join(f'{n}L' for n in sizes)})" if sizes else empty).alias("caps")
    )
    done = 0
    while done < bits:
        step = min(FAN_BITS, bits - done)
        kids = counts.groupBy(F.shiftright("block", bits - done - step).alias("kid")).agg(F.sum("n").alias("n"))
        kids = kids.groupBy(F.shiftright("kid", step).alias("node")).agg(
            F.collect_list(F.struct((F.col("kid") % 2**step).cast("int").alias("at"), "n")).alias("found")
        )
        kids = kids.select(
            "node",
            F.expr(
                f"transform(sequence(0, {2**step - 1}), i -> coalesce(get(filter(found, x -> x.at = i), 0).n, 0L))"
            ).alias("kids"),
        )
        drawn = tree.join(kids, "node").select("node", _drawn(seed, done).alias("rows"))
        tree = drawn.select("node", F.posexplode("rows").alias("at", "caps"))
        tree = tree.select((F.col("node") * 2**step + F.col("at")).alias("node"), "caps")
        done += step
    return tree.select(F.col("node").alias("block"), F.col("caps").alias("sends"))


def _part(bits: int, seed: int, row: str) -> Column:
    """The first ``bits`` bits of the row's hash."""
    if not bits:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(row)), 64 - bits)


def shard(df: DataFrame, shards: int = 16, seed: int = SEED, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    The seed and the rows decide the result, together with the order in which
    Spark lists the input: that order is fixed once, in a table in the shared
    folder, so that retried tasks deal alike.
    """
    if shards < 1 or rows_per_block < 1:
        raise ValueError("shards and rows_per_block are 1 or more")
    out = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    row = free_name(df, "row")
    held = df.select(*[F.col(f"`{c}`") for c in out])
    held = settle(held.withColumn(row, F.monotonically_increasing_id()), "shard-rows")
    n = held.count()
    bits = max(0, (max(1, n // rows_per_block) - 1).bit_length())
    block, rank, sends = (free_name(held, x) for x in ("block", "rank", "sends"))
    blocked = held.withColumn(block, _part(bits, seed, row))
    counts = blocked.groupBy(F.col(block).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix(counts, sizes, bits, seed + 1)
    # For each block, the rank at which each shard's rows end.
    ends = F.expr(
        "aggregate(sends, named_struct('s', 0L, 'e', cast(array() as array<bigint>)), "
        "(a, x) -> named_struct('s', a.s + x, 'e', concat(a.e, array(a.s + x)))).e"
    )
    matrix = matrix.select(F.col("block").alias(block), ends.alias(sends))
    inside = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed + 2), F.col(row)), row)
    dealt = blocked.withColumn(rank, F.row_number().over(inside)).join(matrix, block)
    dealt = dealt.withColumn("shard", F.expr(f"size(filter(`{sends}`, e -> e < `{rank}`))")).drop(block, rank, sends)
    dealt = settle(dealt, "shard-dealt")

    part, offset = free_name(dealt, "part"), free_name(dealt, "offset")
    per = max(0, (max(1, n // shards // rows_per_block) - 1).bit_length())
    parted = dealt.withColumn(part, _part(per, seed + 3, row))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("shard", part).agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("shard", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    again = Window.partitionBy("shard", part).orderBy(F.xxhash64(F.lit(seed + 4), F.col(row)), row)
    placed = parted.withColumn("slot", F.row_number().over(again)).join(offsets, ["shard", part])
    slot = (F.col(offset) + F.col("slot") - 1).cast("long").alias("slot")
    return placed.select(*[F.col(f"`{c}`") for c in out], "shard", slot)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
