from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import pytest

from trolley.llm import bpe
from trolley.llm import token_files as F


def huffman_cost(counts: list[int]) -> int:
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


@pytest.mark.parametrize("seed", range(6))
def test_lengths_are_optimal_prefix_codes(seed):
    rnd = random.Random(seed)
    counts = [rnd.choice([0, 1, rnd.randint(1, 1000)]) for _ in range(rnd.randint(2, 300))]
    counts[:2] = [5, 9]
    lengths = F.code_lengths(np.array(counts))
    assert all((n > 0) == (c > 0) for n, c in zip(lengths, counts))
    assert sum(2.0**-n for n in lengths if n) == 1
    assert int((lengths * counts).sum()) == huffman_cost(counts)


def test_lengths_are_limited():
    counts = np.array([2**k for k in range(40)])
    lengths = F.code_lengths(counts)
    assert lengths.max() == F.MAX_BITS and sum(2.0**-n for n in lengths) == 1
    assert F.code_lengths(np.array([0, 3])).tolist() == [0, 1]
    assert F.code_lengths(np.zeros(4, int)).tolist() == [0] * 4


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000])
def test_pack_and_unpack(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 3000).astype(np.int64)
    lengths = F.code_lengths(np.bincount(ids, minlength=1 << 16))
    payload, at = F.pack(ids, lengths, F.canonical(lengths))
    assert np.array_equal(F.unpack(payload, at[:: F.CHECKPOINT], n, F.lookup(lengths)), ids)
    # Decoding may start at any checkpoint.
    for k in range(0, n, F.CHECKPOINT):
        part = F.unpack(payload, at[k : k + 1], min(F.CHECKPOINT, n - k), F.lookup(lengths))
        assert np.array_equal(part, ids[k : k + F.CHECKPOINT])


def test_round_trip_over_many_files(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(F, "FILE_TOKENS", 20_000)
    monkeypatch.setattr(F, "BLOCK_TOKENS", 1_500)
    rows = sorted(F.op4_token_files(spark, sf).collect(), key=lambda r: r["doc_id"])
    flat, at = bpe.load(bpe.VOCABULARY).encode_batch([t for _, t, _ in texts])
    start = 0
    for (i, _, _), a, b, r in zip(texts, at[:-1], at[1:], rows, strict=True):
        ids = np.append(flat[a:b], F.END_ID).astype("<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_edge_rows(spark, docs):
    rows = sorted(F.read_ids(spark, F.write_ids(docs)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 7, 8, 9, 9]
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert rows[2]["n_tokens"] == 1 and rows[-1]["ids"] == rows[-2]["ids"]
    assert F.read_ids(spark, F.write_ids(docs.limit(0))).collect() == []
