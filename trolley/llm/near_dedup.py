"""Near-duplicate documents by MinHash with sequential Bayesian verification.

A document's set is its distinct word shingles. Signatures give banded
candidates; candidate pairs are compared a batch of hashes at a time and
pruned as soon as the posterior chance of reaching the similarity falls under
the miss probability; survivors are verified on their full sets, in integers.
Linked documents form components; see ``trolley.llm.near`` for how hot groups
are spread.

At the default 40 bands of 7 hashes a pair at similarity 0.85 is missed as a
candidate with probability 2e-7, one at 0.8 with 8e-5; a component also holds
if other links join it.

Defined results: null or empty texts and texts without words have an empty
set and no links; documents with fewer words than a shingle have one shingle,
all their words; equal sets are linked; documents that share a doc_id are
documents of their own; null doc_ids come after all others where the smallest
is chosen, and a component of null doc_ids alone has a null component_id and
is kept; an empty table gives an empty result; ``dedupe`` keeps all columns.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.llm import near
from trolley.llm.shared import relaxed, settle, slices, table

BANDS, ROWS = 40, 7
#: Hashes of words that a task remembers, and keys of sets that it has seen.
MAX_WORDS, MAX_SEEN = 300_000, 300_000
#: Shingles that go through the hash functions at a time.
CHUNK = 1 << 17

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_WORDS: dict[bytes, int] = {}


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return np.array([], np.uint64)
    if len(_WORDS) > MAX_WORDS:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    own = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ own[k : len(own) - size + 1 + k]) * _ODD[k % len(_ODD)]
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _signed(size: int, hashes: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            if len(seen) > MAX_SEEN:
                seen.clear()
            new = []
            for k, key in enumerate(keys):
                if len(sets[k]) and key not in seen:
                    seen.add(key)
                    new.append(k)
            signatures = [np.empty((0, hashes), np.uint32)]
            first = 0
            while first < len(new):  # a chunk of whole documents at a time
                last, total = first, 0
                while last < len(new) and (last == first or total + len(sets[new[last]]) <= CHUNK):
                    total += len(sets[new[last]])
                    last += 1
                own = [(sets[k] >> np.uint64(32)).astype(np.uint32) for k in new[first:last]]
                starts = np.cumsum([0, *map(len, own)])[:-1]
                signatures.append(near.minhash(np.concatenate(own), starts, hashes))
                first = last
            signature = np.concatenate(signatures)
            band: list = [None] * len(sets)
            for k, b in zip(new, near.bands(signature, rows)):
                band[k] = b
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            arrays = [batch.column("row"), pa.array([len(s) for s in sets], pa.int64())]
            arrays += [pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            arrays += [pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n", "k1", "k2", "bands"])
        _WORDS.clear()

    return run


def _meeting(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``near.meeting`` of rows (lid, k1, k2, bands)."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        if len(seen) > MAX_SEEN:
            seen.clear()
        lid = batch.column("lid").to_numpy()
        keys = np.stack([batch.column(c).to_numpy() for c in ("k1", "k2")], 1)
        first = np.array([f if (f := seen.setdefault(k, own)) != own else -1 for k, own in zip(map(tuple, keys.tolist()), lid.tolist())])
        banded = batch.column("bands").is_valid().to_numpy(zero_copy_only=False)
        own = batch.column("bands").flatten().to_numpy().reshape(int(banded.sum()), -1)
        yield near.meeting(keys, lid, first.astype(np.int64), lid[banded], own, buckets)


def _listed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
            sets = pa.array([np.sort(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("lid"), sets], ["lid", "items"])
        _WORDS.clear()

    return run


def linked(docs: DataFrame, size: int, num: int, den: int, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(lid, row, n, ...) for every document, and (lid, comp) for those linked with others.

    Links: den * |intersection| >= num * |union| of the sets of ``size``-word shingles.
    """
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text")
    )
    schema = T.StructType([own.schema["row"]])
    for name, kind in (("n", T.LongType()), ("k1", T.LongType()), ("k2", T.LongType())):
        schema = schema.add(name, kind)
    schema = schema.add("bands", T.ArrayType(T.LongType()))
    signed = own.mapInArrow(_signed(size, bands * rows, rows), schema)
    signed = settle(signed.withColumn("lid", F.monotonically_increasing_id()), "signed")

    def fetch(needed: DataFrame) -> DataFrame:
        found = near.small_join(signed.select("lid", F.col("row.text").cast("string").alias("text")), needed, ["lid"])
        return found.mapInArrow(_listed(size), "lid long, items array<long>")

    items = signed.where("n > 0").select("lid", "k1", "k2", "bands")
    met = near.met(items.mapInArrow(relaxed(functools.partial(_meeting, near.buckets(bands * signed.count()))), near.MEET))
    return signed, near.groups(met, fetch, num, den)


def dedupe(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each component of near-duplicates (the smallest doc_id), with all columns."""
    signed, found = linked(docs, size, num, den)
    found = settle(found, "found")
    ids = near.small_join(signed.select("lid", F.col("row.doc_id").alias("doc_id")), found, ["lid"])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "lid")
    best = ids.groupBy("comp").agg(F.min(order).alias("best"))
    best = best.select("comp", F.col("best.lid").alias("keep"))
    dropped = settle(found.join(best, "comp").where("lid != keep").select("lid"), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= near.BROADCAST_ROWS else dropped
    return signed.select("lid", "row").join(dropped, "lid", "left_anti").select("row.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of whole documents linked at 0.85 on 3-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    signed, found = linked(docs, 3, 85, 100)
    found = settle(found, "found")
    rows = signed.select("lid", F.col("row.doc_id").alias("doc_id"), F.col("n").alias("n_shingles"))
    named = rows.join(found, "lid")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("least"))
    smallest = named.join(least, "comp").select("lid", "least")
    out = rows.join(smallest, "lid", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
