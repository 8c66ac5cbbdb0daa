"""Fuzzy line dedup: one line of each group of equal or similar lines stays in the whole corpus.

Lines are compared in lower case with single spaces, by their distinct
``SHINGLE``-character shingles. MinHash signatures and banding find
candidates, longer signatures of these prune pairs that can't reach the
similarity, exact Jaccard similarity on full sets verifies the rest, distributed
union-find joins them, and of each component the line of the smallest doc_id
and position stays; the others are cut out of their texts.

At the default 30 bands of 7 hashes a pair at similarity 0.85 is missed as a
candidate with probability 1e-5, one at 0.9 with 4e-9; equal lines never are.
One changed character links lines from 66 characters on wherever it stands.

Defined results: blank lines always stay, all others are compared, however
short: equal ones by their key, those of ``SHINGLE`` characters or more by
similarity too; a null text stays null, an empty text empty; a text that
loses all its lines is the empty string and its document stays (unless asked
otherwise); repeated
documents lose all lines but those of one; null doc_ids come after all
others; an empty table gives an empty result; all columns stay, ``text``
rewritten.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.llm import near
from trolley.llm.shared import free_name, relaxed, settle, slices, table

SHINGLE = 5
NUM, DEN = 85, 100
#: Short shingles are often shared by lines that aren't alike, so bands are long, or such lines would be candidates.
BANDS, ROWS = 30, 7
#: Characters that go through the hash functions at a time, and keys that a task has seen.
CHUNK, MAX_SEEN = 1 << 17, 300_000

_FACTOR = 0x9E3779B97F4A7C15


def plain(line: str) -> str:
    return " ".join(line.lower().split())


def rolled(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` numbers, by doubling the length of the runs."""
    runs = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    out, have, length = np.zeros(len(codes) + 1, np.uint64), 0, 1  # hashes of runs of ``have``, then of ``length`` numbers
    while True:
        if size & length:
            n = max(0, len(codes) - have - length + 1)
            out = out[:n] * np.uint64(pow(_FACTOR, length, 1 << 64)) + runs[have : have + n]
            have += length
        if have == size:
            return out ^ (out >> np.uint64(29))
        n = max(0, len(codes) - 2 * length + 1)
        runs = runs[:n] * np.uint64(pow(_FACTOR, length, 1 << 64)) + runs[length : length + n]
        runs = runs ^ (runs >> np.uint64(32))
        length *= 2


def line_set(line: str) -> np.ndarray:
    """Sorted distinct shingles of a plain line; a shorter line is one shingle."""
    codes = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)
    return np.unique(rolled(codes, min(SHINGLE, len(codes))).view(np.int64))


def _chunks(lines: list[str]) -> Iterator[list[str]]:
    """Runs of whole lines of ``CHUNK`` characters, or a longer line alone."""
    first = 0
    while first < len(lines):
        last, total = first, 0
        while last < len(lines) and (last == first or total + len(lines[last]) <= CHUNK):
            total += len(lines[last])
            last += 1
        yield lines[first:last]
        first = last


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of plain lines one after another, and how many a line has."""
    sizes = np.array([len(x) for x in lines], np.int64)
    if (sizes < SHINGLE).any():
        values = [line_set(x).view(np.uint64) for x in lines]
        return np.concatenate(values), np.array([len(v) for v in values], np.int64)
    hashes = rolled(np.frombuffer("\n".join(lines).encode("utf-32-le", "replace"), np.uint32))
    # Those over a line's end and the next line's start go.
    over = (np.cumsum(sizes + 1) - SHINGLE)[:-1, None] + np.arange(SHINGLE)
    inside = np.ones(len(hashes), bool)
    inside[over.ravel()] = False
    return hashes[inside], sizes - SHINGLE + 1


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """``line_set`` of many plain lines."""
    out = []
    for own in _chunks(lines):
        hashes, counts = _hashes(own)
        for values in np.split(hashes.view(np.int64), np.cumsum(counts)[:-1]):
            values.sort()
            out.append(values[np.concatenate([[True], values[1:] != values[:-1]])])
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """MinHash signatures of plain lines, a chunk of whole lines at a time."""
    out = [np.empty((0, BANDS * ROWS), np.uint32)]
    for own in _chunks(lines):
        hashes, counts = _hashes(own)
        out.append(near.minhash((hashes >> np.uint64(32)).astype(np.uint32), np.cumsum(counts) - counts, BANDS * ROWS))
    return np.concatenate(out)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their first line (``rid``): lines are numbered through a task."""
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        lines = batch.column("n_lines").to_numpy()
        ends = at + np.cumsum(lines)
        at = int(ends[-1]) if len(ends) else at
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ends - lines), batch.column("n_lines")], ["row", "rid", "n_lines"])


def _meeting(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``near.meeting`` of the lines of (rid, text): a line's number is the document's and its position."""
    seen: dict[bytes, int] = {}
    for batch in slices(batches):
        rid, texts = (batch.column(c).to_pylist() for c in ("rid", "text"))
        if len(seen) > MAX_SEEN:
            seen.clear()
        lid, keys, first, banded, own = [], [], [], [], []
        for at, text in zip(rid, texts):
            for number, line in enumerate((text or "").split("\n"), at):
                line = plain(line)
                if not line:
                    continue
                key = xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))
                earlier = seen.setdefault(key, number)
                lid.append(number)
                keys.append(key)
                first.append(earlier if earlier != number else -1)
                # A line under a shingle's length is like its copies only, and those are found by the key.
                if earlier == number and len(line) >= SHINGLE:
                    banded.append(number)
                    own.append(line)
        halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        numbers = [np.array(x, np.int64) for x in (lid, first, banded)]
        yield near.meeting(halves, *numbers, near.bands(signatures(own), ROWS), buckets)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plain text of each wanted line."""
    for batch in batches:
        lid, out = [], []
        for rid, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "wanted"))):
            lines = text.split("\n")
            lid += wanted
            out += [plain(lines[w - rid]) for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(lid, pa.int64()), pa.array(out, pa.string())], ["lid", "items"])


def mark(docs: DataFrame) -> DataFrame:
    """(row, n_lines, drops): every document's columns as a struct, its lines, the positions of those that go (null: none)."""
    text = F.col("text").cast("string")
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = (F.coalesce(ends, F.lit(0)) + 1).cast("long").alias("n_lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lines)
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType)])
    for c in ("rid", "n_lines"):
        schema = schema.add(c, T.LongType())
    rows = settle(rows.mapInArrow(relaxed(_numbered), schema), "docs")
    text = F.col("row.text").cast("string").alias("text")
    buckets = near.buckets(BANDS * (rows.agg(F.sum("n_lines")).first()[0] or 0))
    met = near.met(rows.select("rid", text).mapInArrow(relaxed(functools.partial(_meeting, buckets)), near.MEET))
    numbers = F.posexplode(F.sequence("rid", F.col("rid") + F.col("n_lines") - 1)).alias("pos", "lid")

    def lines(*columns: Column) -> DataFrame:
        return rows.select("rid", *columns, numbers)

    def fetch(needed: DataFrame) -> DataFrame:
        at = near.small_join(lines(), needed, ["lid"])
        wanted = settle(at.groupBy("rid").agg(F.collect_list("lid").alias("wanted")), "wanted")
        found = near.small_join(rows.select("rid", text), wanted, ["rid"])
        return found.mapInArrow(relaxed(_texts), "lid long, items string")

    found = settle(near.groups(met, fetch, NUM, DEN, to_sets=line_sets), "found")
    named = settle(near.small_join(lines(F.col("row.doc_id").cast("long").alias("doc_id")), found, ["lid"]), "named")
    best = named.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "pos", "lid")).alias("best"))
    best = settle(best.select("comp", F.col("best.lid").alias("keep")), "best")
    going = near.small_join(named, best, ["comp"]).where("lid != keep")
    drops = settle(going.groupBy("rid").agg(F.collect_list(F.col("pos").cast("int")).alias("drops")), "drops")
    drops = F.broadcast(drops) if drops.count() <= near.BROADCAST_ROWS else drops
    return rows.join(drops, "rid", "left").select("row", "n_lines", "drops")


def _kept(text: Column, drops: Column) -> Column:
    def stay(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    # The lines are made once, and each position is looked up at once.
    cut = F.element_at(F.transform(F.array(F.split(text, "\n", -1)), stay), 1)
    return F.when(drops.isNull(), text).otherwise(cut)


def dedupe(docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """All documents and columns, ``text`` without lines that stay elsewhere.

    keep_emptied: whether documents stay that lose lines and have only blank ones left.
    """
    rows = mark(docs)
    kept = free_name(docs, "kept")
    rows = rows.withColumn(kept, _kept(F.col("row.text").cast("string"), F.col("drops")))
    if not keep_emptied:
        rows = rows.where(F.col("drops").isNull() | F.col(kept).rlike(r"[^\s\p{Z}]"))
    return rows.select(*[F.col(kept).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: its lines, those that go, and the hash of the text that stays."""
    rows = mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.encode(_kept(F.col("row.text"), F.col("drops")), "UTF-8"), 256).alias("text_sha256"),
    )
