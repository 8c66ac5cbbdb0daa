"""Token ids in files of canonical length-limited Huffman codes.

``write_ids`` counts the ids of all documents, makes one optimal code with
lengths of at most ``MAX_BITS`` (package-merge over the counts, at most one
row for each id of the vocabulary), and writes the documents in doc_id order.
``read_ids`` decodes with one lookup table, block by block.

Format, a folder with two Parquet tables (so any store that Spark reaches will
do, and Spark's commit protocol covers lost tasks):

- ``code``: id, n (its count), bits (its code length). Codes are canonical:
  by length, then id, each one more than the last, extended with zeros.
- ``blocks``: file, block (numbers in order), first (ids in the file before
  it), n_tokens, doc_ids, doc_tokens (by document), bits (the codes, most
  significant bit first, filled to whole 4 bytes), checkpoints (bit offset of
  every ``CHECKPOINT``-th id, unsigned 32-bit). A block holds whole documents
  and is decoded alone; from each checkpoint decoding can start anew.

Defined results: a null or empty text is the end id alone; documents of one
doc_id stand in the order of their ids' hashes, null doc_ids before all;
repeated rows are written again; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm.bpe import SLICE, VOCABULARY, load
from trolley.llm.shared import settle, slices, table
from trolley.session import shared_path

MAX_BITS = 16
CHECKPOINT = 128
END_ID = 2
#: Ids of a block at least (whole documents), and of a file on average.
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 22


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for symbols with counts over 0 (others: 0), by package-merge."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols don't fit {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, packages = [], np.array([], np.int64)
    for _ in range(most):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(leaves))
        merged = merged[order]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[used[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol with a length, by length and then symbol."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    at = np.concatenate([[0], np.cumsum(1 << (MAX_BITS - lengths[used]))[:-1]])
    codes[used] = at >> (MAX_BITS - lengths[used])
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` as bytes, and the bit offset of each id."""
    bits = lengths[ids]
    end = np.cumsum(bits)
    at = end - bits
    word, shift = at >> 5, 64 - (at & 31) - bits
    both = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    n = int(end[-1] + 31 >> 5) + 1 if len(ids) else 1
    # Sums of separate bits under 2 ** 32 are exact in float64.
    words = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), n)
    words = words + np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    return words.astype(np.uint64).astype(">u4").tobytes(), at


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``MAX_BITS`` bits: the symbol, and the length of its code."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = 1 << (MAX_BITS - lengths[used])
    symbol, size = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.int64)
    n = int(span.sum())
    symbol[:n], size[:n] = np.repeat(used, span), np.repeat(lengths[used], span)
    return symbol, size


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``n`` ids of one block, decoded from all its checkpoints side by side."""
    raw = np.frombuffer(payload, np.uint8).astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(CHECKPOINT * MAX_BITS // 8 + 4, np.uint32)])
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    symbol, size = tables
    at = checkpoints.astype(np.int64)
    out = np.empty((CHECKPOINT, len(at)), np.uint32)
    for step in range(CHECKPOINT):
        value = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[step] = symbol[value]
        at += size[value]
    return out.T.reshape(-1)[:n]


def write_ids(docs: DataFrame, folder: str | None = None, path: str = VOCABULARY, end_id: int = END_ID) -> str:
    """Write the ids of every whole document, each with ``end_id`` after it; the folder's name."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "llm-ids")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and at a task's end one with the counts of its ids: pairs (id, n)."""
        bpe = load(path)
        if max(len(bpe.tokens), end_id + 1) > 1 << 16:
            raise ValueError("ids of more than 16 bits don't fit the codes")
        counts = np.zeros(1 << 16, np.int64)
        end = np.array([end_id], "<u2").tobytes()
        for batch in slices(batches, SLICE):
            flat, at = bpe.encode_batch(batch.column("text"))
            counts += np.bincount(flat, minlength=1 << 16)
            counts[end_id] += batch.num_rows
            flat = flat.astype("<u2")
            ids = [flat[a:b].tobytes() + end for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        used = np.flatnonzero(counts)
        pairs = np.stack([used, counts[used]], 1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs])], names)

    names = ["doc_id", "ids", "counts"]
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    made = own.mapInArrow(encoded, "doc_id long, ids binary, counts binary")
    made = settle(made.select("doc_id", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"), "ids", "counts"), "ids")
    ids = made.where("ids is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                pairs = np.frombuffer(value, "<i8").reshape(-1, 2)
                counts[pairs[:, 0]] += pairs[:, 1]
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    # At most one row for each id there is: 65,536.
    rows = made.where("counts is not null").select("counts").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    code = spark.createDataFrame([(int(i), int(counts[i]), int(lengths[i])) for i in used], "id int, n long, bits int")
    code.coalesce(1).write.parquet(f"{folder}/code")
    small = lengths.astype(np.int8)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = small.astype(np.int64)
        codes = canonical(length)
        file, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate([x for _, x in held])
            payload, at = pack(flat, length, codes)
            row = {
                "file": [file], "block": [number], "first": [first], "n_tokens": [len(flat)],
                "doc_ids": [[d for d, _ in held]], "doc_tokens": [[len(x) for _, x in held]],
                "bits": [payload], "checkpoints": [at[::CHECKPOINT].astype("<u4").tobytes()],
            }
            return pa.RecordBatch.from_pydict(row, schema=BLOCK_SCHEMA)

        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                held.append((doc, np.frombuffer(value, "<u2")))
                size += len(held[-1][1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    number, first, held, size = number + 1, first + size, [], 0
        if held:
            yield block()

    files = max(1, round(int(counts.sum()) / FILE_TOKENS))
    ordered = ids.repartitionByRange(files, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    made = ordered.select("doc_id", "ids").mapInArrow(blocks, BLOCK_COLUMNS)
    made.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


BLOCK_COLUMNS = (
    "file long, block long, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "bits binary, checkpoints binary"
)
BLOCK_SCHEMA = pa.schema(
    [(x, pa.int64()) for x in ("file", "block", "first", "n_tokens")]
    + [(x, pa.list_(pa.int64())) for x in ("doc_ids", "doc_tokens")]
    + [(x, pa.binary()) for x in ("bits", "checkpoints")]
)


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a folder; ``digest``: ids_crc32 instead of ids.

    start: ids of all documents before; ids: little-endian unsigned 32-bit.
    """
    rows = spark.read.parquet(f"{folder}/code").collect()  # at most 65,536
    lengths = np.zeros(1 << 16, np.int8)
    for r in rows:
        lengths[r["id"]] = r["bits"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lookup(lengths.astype(np.int64))
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: B023, E731
                n = get("n_tokens").as_py()
                at = np.frombuffer(get("checkpoints").as_py(), "<u4")
                flat = unpack(get("bits").as_py(), at, n, tables).astype("<u4")
                sizes = np.array(get("doc_tokens").as_py(), np.int64)
                ends = np.cumsum(sizes)
                own = [flat[b - a : b] for a, b in zip(sizes, ends)]
                start = get("start").as_py() + get("first").as_py() + ends - sizes
                last = pa.array([zlib.crc32(x) for x in own] if digest else [x.tobytes() for x in own])
                yield pa.RecordBatch.from_arrays([get("doc_ids").values, pa.array(start), pa.array(sizes), last], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One row for each file, as in a listing; the planner sees their size and chooses the join.
    files = sorted(blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["file"])
    before = np.cumsum([0, *(r["n"] for r in files)]).tolist()
    starts = spark.createDataFrame([(r["file"], s) for r, s in zip(files, before)], "file long, start long")
    schema = f"doc_id long, start long, n_tokens long, {names[3]} {'long' if digest else 'binary'}"
    return blocks.join(starts, "file").mapInArrow(decoded, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's ids written in doc_id order and read back."""
    return read_ids(spark, write_ids(table(spark, sf_dir, "documents")), digest=True)
