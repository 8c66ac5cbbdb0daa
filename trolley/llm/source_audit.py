"""Divergence of sources by products of one-hot level matrices.

Within a language every kept term has a count in each source (0 if it doesn't
occur), and what a pair of sources adds to its divergence there depends on the
two counts only. So the terms are the rows of a 0/1 matrix with a column for
each (source, count level); the product of its transpose with itself holds,
for each pair of sources, how many terms have each pair of levels: their joint
table. Each cell is priced once and multiplied by its terms.

Only levels over 0 are columns. With m the terms of a source at a level, V all
terms and f(a, b) the price, the sum over all terms is

    sum J[a,b] (f(a,b) - f(a,0) - f(0,b) + f(0,0))
    + sum m[a] (f(a,0) - f(0,0)) + sum m[b] (f(0,b) - f(0,0)) + V f(0,0)

so absent terms cost nothing. Rows are dealt to blocks of about ``BLOCK_TERMS``
terms of one size class (terms of like total share their levels, so blocks have
few columns) and sources to blocks of ``BLOCK_SOURCES``; a task multiplies one
block of rows by a pair of source blocks, in tiles, and sends one number for
each pair of sources. Products count at most a block's terms, which float32
holds exactly; all else is in integers.

Defined results: null text, lang and source are the empty string; repeated
rows count again; ids and other columns are not read; a source without terms
is a source with counts of 0; where a language keeps no term all its pairs
have value 0; a language of one source has no pairs; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trolley.llm import near
from trolley.llm.shared import settle, table

#: Documents of its language that a kept term is in, at least.
MIN_DOCS = 3
#: Shares are integers of this unit.
UNIT = 1_000_000_000
#: Terms reported for each source.
TOP_TERMS = 200
#: Terms of a block of rows on average, sources of a block of columns, columns of one tile's product at most.
BLOCK_TERMS, BLOCK_SOURCES, TILE_COLUMNS = 4096, 64, 1024
#: Distinct terms by source that a task counts before it hands them on.
FLUSH_TERMS = 300_000
#: Parts in which a source's terms are ranked first.
SALTS = 32

#: A-Z in lower case; other ASCII characters but a-z part terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) over the task's documents; a null term for each source."""
    found: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
    names = ["lang", "source", "term", "n", "docs"]

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in found.items():
            terms = [None, *(t.decode("utf-8", "replace") for t in times)]
            arrays = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string())]
            arrays += [pa.array([0, *times.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, times)], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)
        found.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            times, docs = found.setdefault((lang, source), (Counter(), Counter()))
            own = Counter(text.encode("utf-8", "replace").translate(_TERMS).split())
            held -= len(times)
            times.update(own)
            docs.update(own.keys())
            held += len(times) + 1
            if held > FLUSH_TERMS:
                yield from flush()
                held = 0
    yield from flush()


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division in steps of 1000, so that nothing overflows."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def joint_tables(
    column: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = TILE_COLUMNS
) -> Iterator[tuple[np.ndarray, ...]]:
    """Cells (i, j, n) of the product of a one-hot matrix's columns ``left`` with its columns ``right``, tile by tile.

    column, row: where the matrix has ones, sorted by row; left, right: for
    each column whether it is a factor on that side. A tile is as many rows as
    have ``most`` columns at most (or one row).
    """
    cuts = np.concatenate([np.flatnonzero(np.diff(row, prepend=-1)), [len(row)]]) if len(row) else np.array([0])
    stack = [(0, len(cuts) - 1)]
    while stack:
        first, last = stack.pop()
        if first >= last:
            continue
        a, b = cuts[first], cuts[last]
        used, own = np.unique(column[a:b], return_inverse=True)
        if len(used) > most and last - first > 1:
            middle = (first + last) // 2
            stack += [(first, middle), (middle, last)]
            continue
        hot = np.zeros((last - first, len(used)), np.float32)
        hot[np.repeat(np.arange(last - first), np.diff(cuts[first : last + 1])), own] = 1
        i, j = np.flatnonzero(left[used]), np.flatnonzero(right[used])
        product = hot[:, i].T @ hot[:, j]
        x, y = np.nonzero(product)
        yield used[i[x]], used[j[y]], product[x, y].astype(np.int64)


def _priced(width: int, tile: int):
    """Function of one block of rows: what it adds to each pair of two blocks of ``width`` sources, both ways round.

    Rows with ``cells``: a term's (source, count, total of the source).
    Rows with ``n``: how many terms a source has at a level (level null: only that the source exists).
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, x, y = (k.as_py() for k in key[:3])
        v = rows.column("v")[0].as_py()
        cells = rows.column("cells").combine_chunks()
        margin = cells.is_null().to_numpy(zero_copy_only=False)
        out: dict[tuple[int, int], int] = {}

        def added(g: np.ndarray, h: np.ndarray, values: np.ndarray) -> None:
            wide = int(h.max()) + 1
            keys, place = np.unique(g * wide + h, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, values)
            for k, s in zip(keys.tolist(), sums.tolist()):
                pair = k // wide, k % wide
                out[pair] = out.get(pair, 0) + s

        if margin.any():
            own = rows.filter(pa.array(margin)).to_pydict()
            at = np.array(own["g"], np.int64)
            level = np.array([c or 0 for c in own["level"]], np.int64)
            total, n = np.array(own["total"], np.int64), np.array(own["n"], np.int64)
            sources, first, place = np.unique(at, return_index=True, return_inverse=True)
            empty = total[first] + v
            zero = share(np.zeros(len(sources), np.int64), empty) if v else None
            for k, g in enumerate(sources.tolist()):
                others = np.flatnonzero((sources // width == (y if g // width == x else x)) & (sources != g))
                if x != y and g // width == y or not len(others):
                    continue
                mine, theirs = place == k, np.isin(place, others)
                values = np.zeros((2, len(others)), np.int64)
                if v:
                    both = ((zero[k], zero[others]), (zero[others], zero[k]))
                    values += v * np.stack([price(p, q) for p, q in both])
                    p = share(level[mine], total[mine] + v)[:, None]
                    values[0] += (n[mine][:, None] * (price(p, zero[others]) - price(zero[k], zero[others]))).sum(0)
                    values[1] += (n[mine][:, None] * (price(zero[others], p) - price(zero[others], zero[k]))).sum(0)
                    q, to = share(level[theirs], total[theirs] + v), np.searchsorted(others, place[theirs])
                    zeros = zero[others][to]
                    np.add.at(values[0], to, n[theirs] * (price(zero[k], q) - price(zero[k], zeros)))
                    np.add.at(values[1], to, n[theirs] * (price(q, zero[k]) - price(zeros, zero[k])))
                for h, there, back in zip(sources[others].tolist(), *values.tolist()):
                    out[g, h] = out.get((g, h), 0) + there
                    if x != y:
                        out[h, g] = out.get((h, g), 0) + back
        if not margin.all():
            lists = cells.filter(pa.array(~margin))
            entry = lists.flatten()
            g, level, total = (entry.field(c).to_numpy() for c in ("g", "n", "total"))
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((level, g))
            new = np.concatenate([[True], (np.diff(g[order]) != 0) | (np.diff(level[order]) != 0)])
            column = np.empty(len(g), np.int64)
            column[order] = np.cumsum(new) - 1
            at = g[order][new].astype(np.int64)
            p = share(level[order][new], total[order][new] + v)
            zero = share(np.zeros(len(p), np.int64), total[order][new] + v)
            left, right = at // width == x, at // width == y
            for i, j, n in joint_tables(column, row, left, right, tile):
                apart = at[i] != at[j]
                i, j, n = i[apart], j[apart], n[apart]
                for a, b in ((i, j), (j, i))[: 1 + (x != y)]:
                    if len(a):
                        cell = price(p[a], p[b]) - price(p[a], zero[b]) - price(zero[a], p[b]) + price(zero[a], zero[b])
                        added(at[a], at[b], n * cell)
        pairs = list(out)
        arrays = [pa.array([lang] * len(pairs), pa.string()), pa.array([a for a, _ in pairs], pa.int64())]
        arrays += [pa.array([b for _, b in pairs], pa.int64()), pa.array(out.values(), pa.int64())]
        return pa.Table.from_arrays(arrays, ["lang", "g", "h", "value"])

    return run


def count_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, source, term, n, all: its count in the language); sources (lang, source, total, lang_total, v, g).

    g numbers a language's sources from 0; v is how many terms it keeps.
    """
    own = docs.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    )
    counts = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = settle(counts, "audit-counts")
    # At most one row for each source of a term is left, so a frequent term is no hot key here.
    of_term = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").withColumn("all", F.sum("n").over(of_term))
    kept = kept.withColumn("in", F.sum("docs").over(of_term)).where(F.col("in") >= min_docs).drop("in", "docs")
    kept = settle(kept, "audit-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left")
    terms = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    in_lang = Window.partitionBy("lang")
    sources = sources.join(terms, "lang", "left").select(
        "lang",
        "source",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.sum("total").over(in_lang), F.lit(0)).alias("lang_total"),
        F.coalesce("v", F.lit(0)).alias("v"),
        (F.row_number().over(in_lang.orderBy("source")) - 1).cast("int").alias("g"),
    )
    return kept, settle(sources, "audit-sources")


def divergence(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, g, h, value) for each two sources of a language, both ways round; value: summed prices of g against h."""
    numbered = kept.join(sources.select("lang", "source", "total", "v", "g"), ["lang", "source"])
    numbered = settle(numbered.select("lang", "term", "all", "n", "total", "v", "g"), "audit-cells")
    size = F.length(F.bin("all")).alias("size")
    # Rows of the one-hot matrix: a term with its cells, at most one for each source.
    rows = numbered.groupBy("lang", "term").agg(
        F.first("all").alias("all"), F.first("v").alias("v"), F.collect_list(F.struct("g", "n", "total")).alias("cells")
    )
    rows = rows.select("lang", "v", size, F.xxhash64("term").alias("h"), "cells")
    blocks = numbered.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang", size)
    blocks = blocks.agg(F.ceil(F.count(F.lit(1)) / BLOCK_TERMS).alias("blocks"))
    # At most 64 rows for a language: no shuffle of all terms by so few keys.
    rows = near.small_join(rows, settle(blocks, "audit-blocks"), ["lang", "size"]).withColumn("block", F.pmod("h", F.col("blocks")))

    def of(c: Column) -> Column:
        return F.floor(c / BLOCK_SOURCES).cast("int")

    held = F.array_sort(F.array_distinct(F.transform("cells", lambda c: of(c["g"]))))
    pairs = F.flatten(
        F.transform(held, lambda a: F.transform(F.filter(held, lambda b: b >= a), lambda b: F.struct(a.alias("x"), b.alias("y"))))
    )
    rows = rows.select("lang", "v", "size", "block", "cells", F.explode(pairs).alias("p"))
    none = {"g": "int", "level": "long", "n": "long", "total": "long"}
    rows = rows.select(
        "lang", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "size", "block", "v",
        F.filter("cells", lambda c: of(c["g"]).isin(F.col("p.x"), F.col("p.y"))).alias("cells"),
        *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
    )
    # How many terms a source has at each level, for every pair of its block with another.
    levels = numbered.groupBy("lang", "g", F.col("n").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = levels.join(sources.select("lang", "g", "total", "v"), ["lang", "g"])
    alone = sources.select("lang", "g", F.lit(None).cast("long").alias("level"), F.lit(0).cast("long").alias("n"), "total", "v")
    last = sources.groupBy("lang").agg(of(F.max("g")).alias("last"))
    margins = levels.select(*alone.columns).union(alone).join(last, "lang")
    mine = of(F.col("g"))
    margins = margins.withColumn("o", F.explode(F.sequence(F.lit(0), "last")))
    margins = margins.select(
        "lang", F.least(mine, "o").alias("x"), F.greatest(mine, "o").alias("y"), F.lit(0).alias("size"),
        F.lit(0).cast("long").alias("block"), "v", F.lit(None).cast(rows.schema["cells"].dataType).alias("cells"),
        "g", "level", "n", "total",
    )
    key = ("lang", "x", "y", "size", "block")
    parts = rows.unionByName(margins).groupBy(*key).applyInArrow(_priced(BLOCK_SOURCES, TILE_COLUMNS), "lang string, g long, h long, value long")
    total = F.sum(F.col("value").cast("decimal(38,0)")).cast("long")
    return parts.groupBy("lang", "g", "h").agg(total.alias("value"))


def _best(rows: DataFrame, order: list, most: int) -> DataFrame:
    """Rank in (lang, source) up to ``most``: the best of the best of each part, so that no task ranks a whole source."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    for key in (["lang", "source", "salt"], ["lang", "source"]):
        ranked = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        rows = rows.withColumn("rank", ranked).where(F.col("rank") <= most)
    return rows.drop("salt")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: item is another source of the language, value how far the
    source's terms are from it. Part ``term``: item is a term that the source
    uses more than its language does, value what it adds; the ``top`` of these.
    """
    kept, sources = count_terms(docs, min_docs)
    names = sources.select("lang", "source", F.col("g").cast("long").alias("g"))
    pairs = divergence(kept, sources).join(names, ["lang", "g"])
    other = names.select("lang", F.col("source").alias("item"), F.col("g").alias("h"))
    pairs = pairs.join(other, ["lang", "h"]).select("lang", "source", "item", "value")
    order = [F.desc("value"), F.asc("item")]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    def shared(count: str, total: str) -> Column:
        wide = "cast({} as decimal(20,0))"
        n, d = wide.format(f"`{count}` + 1"), wide.format(f"`{total}` + v")
        return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * {n}) div {d}")

    terms = kept.join(sources.drop("g"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), shared("n", "total").alias("p"), shared("all", "lang_total").alias("q")
    )
    value = F.expr("((p - q) * (p - q)) div q")
    terms = _best(terms.where("p > q").select("lang", "source", "item", value.alias("value")), order, top)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of ``documents`` is from the others of its language, and by which terms."""
    return audit(table(spark, sf_dir, "documents"))
