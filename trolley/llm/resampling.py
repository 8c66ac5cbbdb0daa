"""Importance resampling towards a target corpus, over distinct lines.

A document's features are all runs of one to three consecutive words, hashed
into buckets. Line ends part words, so a text is cut into lines there: the
features inside a line are the line's own, and those across line ends need the
two words on each side only. Each distinct line of the whole corpus is counted
once, and its counts are multiplied by its occurrences; its weight is looked up
once and joined back to the documents. Features across line ends are added for
each document.

A bucket's gain is the logarithm of how much likelier the target has it than
the corpus, a document's weight the sum of its features' gains, and its score
the weight with Gumbel noise that its id decides: the highest scores are a
sample without replacement, in proportion to the weights.

Only the counts of the buckets, a bounded parameter, reach the driver.

Defined results: a null or empty text has no features and weight 0; a null
doc_id counts as an empty id in the noise and is behind all others of its
score; rows that share a doc_id are documents of their own; rows of one score
and doc_id are drawn in any order; with an empty target all gains follow the
smoothing alone; an empty table gives an empty result; other columns are not
read, and ``resample`` keeps them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trolley.llm.shared import settle, table

BUCKETS = 10_000
#: Documents with fewer words aren't drawn; so many in a hundred of the others are.
MIN_WORDS, PERCENT = 20, 5
SEED = 42
#: Bytes of lines that are hashed at a time.
CHUNK = 1 << 21

#: A-Z in lower case; other ASCII characters but digits and a-z part words. Line ends stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b == 10 else 32 for b in range(256))


def line_features(lines: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features inside each translated line, one line after another; how many features and words each has."""
    words: list[bytes] = []
    sizes = np.empty(len(lines), np.int64)
    for k, line in enumerate(lines):
        own = line.split()
        sizes[k] = len(own)
        words += own
    # crc32 goes on from a prefix's value, so a run's value follows from the shorter run's.
    spaced = [b" " + w for w in words]
    one = list(map(crc32, words))
    two = list(map(crc32, spaced[1:], one))
    three = list(map(crc32, spaced[2:], two))
    line = np.repeat(np.arange(len(lines)), sizes)
    found = []
    for length, values in ((1, one), (2, two), (3, three)):
        n = len(values)
        inside = line[:n] == line[length - 1 : length - 1 + n]
        found.append((line[:n][inside], np.array(values, np.uint32)[inside] % BUCKETS))
    owner = np.concatenate([a for a, _ in found])
    bucket = np.concatenate([b for _, b in found]).astype(np.uint16)
    counts = np.bincount(owner, minlength=len(lines))
    return bucket[np.argsort(owner, kind="stable")], counts, sizes


def cross_features(lines: Sequence[bytes]) -> list[int]:
    """Buckets of the features that go over the ends of translated lines; lines without words don't part anything."""
    out: list[int] = []
    before: list[bytes] = []
    for line in lines:
        head = line.split(None, 2)
        if not head:
            continue
        if before:
            runs = [[before[-1], head[0]]]
            if len(before) > 1:
                runs.append([*before, head[0]])
            if len(head) > 1:
                runs.append([before[-1], *head[:2]])
            out += [crc32(b" ".join(r)) % BUCKETS for r in runs]
        tail = head if len(head) < 3 else line.rsplit(None, 2)[-2:]
        before = [*before, *tail][-2:]
    return out


def _key(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def _totals(counts: np.ndarray) -> bytes:
    used = np.flatnonzero(counts)
    return np.stack([used, counts[used]], 1).astype("<i8").tobytes()


LINES = "k1 long, k2 long, n_words long, buckets binary, totals binary"


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct line with words; at a task's end the counts of its buckets, times occurrences."""
    schema = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "n_words")] + [(c, pa.binary()) for c in ("buckets", "totals")])
    totals = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        lines, times = (batch.column(c).to_pylist() for c in ("line", "n"))
        first = 0
        while first < len(lines):
            own, size = [], 0
            while first + len(own) < len(lines) and (not own or size < CHUNK):
                own.append(lines[first + len(own)].encode("utf-8", "replace"))
                size += len(own[-1])
            buckets, counts, words = line_features([x.translate(_WORDS) for x in own])
            np.add.at(totals, buckets, np.repeat(np.array(times[first : first + len(own)]), counts))
            ends = np.cumsum(counts)
            with_words = np.flatnonzero(words)
            keys = np.frombuffer(b"".join(_key(own[k]) for k in with_words), "<i8").reshape(-1, 2)
            runs = [buckets[ends[k] - counts[k] : ends[k]].astype("<u2").tobytes() for k in with_words]
            arrays = [keys[:, 0], keys[:, 1], words[with_words]]
            arrays = [pa.array(a, pa.int64()) for a in arrays] + [pa.array(runs, pa.binary()), pa.nulls(len(runs), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            first += len(own)
    last = {"k1": [None], "k2": [None], "n_words": [None], "buckets": [None], "totals": [_totals(totals)]}
    yield pa.RecordBatch.from_pydict(last, schema=schema)


DOCS = "lines array<struct<k1:long,k2:long,n:long>>, cross binary, totals binary"


def _lists(owner_sizes: list[int], keys: list[bytes], times: list[int]) -> pa.Array:
    halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(times, pa.int64())]
    at = pa.array(np.cumsum([0, *owner_sizes]), pa.int32())
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, ["k1", "k2", "n"]))


def _doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its lines with words as keys, its features across line ends; at a task's end their counts."""
    names = ["key", "lines", "cross", "totals"]
    totals = np.zeros(BUCKETS, np.int64)
    last = None
    for batch in batches:
        sizes, keys, times, cross = [], [], [], []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode("utf-8", "replace")
            lines = raw.translate(_WORDS).split(b"\n")
            found = cross_features(lines)
            cross.append(np.array(found, "<u2").tobytes())
            np.add.at(totals, np.array(found, np.int64), 1)
            own = Counter(_key(x) for x, y in zip(raw.split(b"\n"), lines) if y and not y.isspace())
            sizes.append(len(own))
            keys += own.keys()
            times += own.values()
        arrays = [batch.column("key"), _lists(sizes, keys, times), pa.array(cross, pa.binary()), pa.nulls(len(cross), pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names)
        last = [pa.nulls(1, arrays[0].type), pa.nulls(1, arrays[1].type), pa.nulls(1, pa.binary())]
    if last:
        yield pa.RecordBatch.from_arrays([*last, pa.array([_totals(totals)], pa.binary())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for value in batch.column(0).to_pylist():
            pairs = np.frombuffer(value, "<i8").reshape(-1, 2)
            totals[pairs[:, 0]] += pairs[:, 1]
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["bucket", "n"])


def features(docs: DataFrame, key: Column) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Distinct lines (LINES), documents (rid, key, DOCS), and the features in each bucket."""
    own = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    lines = own.select(F.explode(F.split("text", "\n", -1)).alias("line")).where("line != ''")
    lines = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    lines = settle(lines.mapInArrow(_line_rows, LINES), "resample-lines")
    schema = T.StructType([T.StructField("key", own.schema["key"].dataType)])
    for field in T.StructType.fromDDL(DOCS).fields:
        schema = schema.add(field)
    held = own.mapInArrow(_doc_rows, schema).withColumn("rid", F.monotonically_increasing_id())
    held = settle(held, "resample-docs")
    totals = np.zeros(BUCKETS, np.int64)
    for part in (lines, held):
        found = part.where("totals is not null").select("totals").mapInArrow(_summed, "bucket long, n long")
        for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
            totals[r["bucket"]] += r["n"]
    return lines.where("totals is null").drop("totals"), held.where("totals is null").drop("totals"), totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: floor(1000 * the log ratio of its smoothed shares), in doubles."""
    s, t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array(
        [math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def _sums(values: list[bytes | None], gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of buckets: its summed gains, and its length."""
    flat = np.frombuffer(b"".join(v or b"" for v in values), "<u2")
    sizes = np.array([len(v or b"") // 2 for v in values], np.int64)
    total = np.concatenate([[0], np.cumsum(gain[flat])])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes], sizes


def _weighed(column: str, keep: tuple[str, ...], gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, n = _sums(batch.column(column).to_pylist(), gain)
            arrays = [*(batch.column(c) for c in keep), pa.array(weight, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "weight", "n_features"])

    return run


def weigh(docs: DataFrame, target: DataFrame, key: Column) -> DataFrame:
    """(key, n_words, n_features, weight) of every document."""
    lines, held, corpus = features(docs, key)
    *_, wanted = features(target, F.lit(0))
    gain = gains(corpus, wanted)
    by_line = lines.mapInArrow(
        _weighed("buckets", ("k1", "k2", "n_words"), gain), "k1 long, k2 long, n_words long, weight long, n_features long"
    )
    refs = held.select("rid", F.explode("lines").alias("x")).select("rid", "x.*")
    counted = ("n_words", "weight", "n_features")
    # A line that many documents hold is a hot key here; Spark splits it (skew join), rows are a few numbers.
    of_lines = refs.join(by_line, ["k1", "k2"]).select("rid", *[(F.col(c) * F.col("n")).alias(c) for c in counted])
    schema = T.StructType([T.StructField("rid", T.LongType()), held.schema["key"]])
    for c in ("weight", "n_features"):
        schema = schema.add(c, T.LongType())
    own = held.select("rid", "key", "cross").mapInArrow(_weighed("cross", ("rid", "key"), gain), schema)
    sums = of_lines.groupBy("rid").agg(*[F.sum(c).alias(f"line_{c}") for c in counted])
    zero = F.lit(0).cast("long")
    return own.join(sums, "rid", "left").select(
        "key",
        F.coalesce("line_n_words", zero).alias("n_words"),
        (F.col("n_features") + F.coalesce("line_n_features", zero)).alias("n_features"),
        (F.col("weight") + F.coalesce("line_weight", zero)).alias("weight"),
    )


def _noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the first 8 hex digits of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], share: Column) -> DataFrame:
    """Settled ``rows`` with ``rank`` (1, 2, 3 ... in ``order``) for the first ``share`` (of n rows); the others go.

    Range partitions are numbered from their sizes, so no task sorts all rows.
    """
    parts = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = settle(parts, "resample-parts")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(every).alias("n"))
    sizes = sizes.where(F.col("before") < share)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    out = parts.join(sizes, "part").withColumn("rank", (F.col("before") + inside).cast("long"))
    return out.where(F.col("rank") <= share).drop("part", "before", "n")


def score(docs: DataFrame, target: DataFrame, key: Column, doc_id: str | None = None, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; rank is null where it isn't drawn.

    doc_id: where the id is in ``key``, if that is a struct.
    """
    own = F.col(f"key.{doc_id}") if doc_id else F.col("key")
    rows = weigh(docs, target, key).withColumn("score", F.col("weight") + _noise(own, seed))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    eligible = rows.where(F.col("n_words") >= MIN_WORDS).select("row", "score", own.alias("id"))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    drawn = ranked(eligible, order, F.expr(f"n * {percent} div 100")).select("row", "rank")
    return rows.join(drawn, "row", "left").drop("row")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn documents, with all their columns."""
    rows = score(docs, target, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "doc_id", percent, seed)
    return rows.where("rank is not null").select("key.*")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and draw of every document, towards the texts of ``benchmark``."""
    rows = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), F.col("doc_id").cast("long"))
    return rows.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")
