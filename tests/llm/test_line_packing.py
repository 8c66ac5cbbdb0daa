from __future__ import annotations

import random
import zlib

import numpy as np

from trolley.llm import line_dedup, near


def test_what_meets_is_sent_in_a_few_rows_and_bytes():
    """20,000 lines of 30 bands: a row for each bucket, and less than half of what keys and rows alone take."""
    rng = np.random.default_rng(1)
    n = 20_000
    rows = (3 << 33) + np.arange(n)
    bands = rng.integers(-(1 << 63), (1 << 63) - 1, (n, line_dedup.BANDS))
    bands[:100] = bands[0]
    bands[100:110] = bands[100]
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, (n, 2))
    first = np.full(n, -1)
    first[5000:5100] = rows[:100]
    sent = near.meeting(keys, rows, first, rows, bands)
    assert sent.num_rows <= 2 * near.BUCKETS + 100
    packed = sum(len(zlib.compress(b.as_buffer(), 1)) for c in ("x", "y", "z") for b in sent.column(c))
    assert packed < 10 * n * line_dedup.BANDS
    found = {kind: set() for kind in (near.MEMBER, near.EDGE, near.COPY)}
    for part in near._met(iter(sent.sort_by("bucket").slice(k, 700) for k in range(0, sent.num_rows, 700))):
        kind = part.column("kind")[0].as_py()
        found[kind] |= set(zip(part.column("a").to_pylist(), part.column("b").to_pylist()))
    assert found[near.COPY] == set(zip(rows[5000:5100].tolist(), rows[:100].tolist()))
    assert found[near.EDGE] == {(int(rows[0]), int(r)) for r in rows[1:100]} | {(int(rows[100]), int(r)) for r in rows[101:110]}
    assert found[near.MEMBER] == {(int(b) & ~1, int(r)) for k in (0, 100) for b in bands[k] for r in (rows[:100] if k == 0 else rows[100:110])}


def test_buckets_grow_with_the_rows():
    assert near.buckets(0) == near.buckets(near.BUCKETS * near.BUCKET_ROWS) == near.BUCKETS
    assert near.buckets(5 * near.BUCKETS * near.BUCKET_ROWS) == 8 * near.BUCKETS


def test_sets_of_many_lines_are_those_of_each(monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 300)
    rnd = random.Random(2)
    lines = ["".join(rnd.choice("ab é日😀") for _ in range(rnd.randint(5, 90))) for _ in range(200)] + ["x" * 1000]
    for own in (lines, [*lines, "a", "abcd"], []):
        got = line_dedup.line_sets(own)
        assert len(got) == len(own)
        assert all(np.array_equal(a, line_dedup.line_set(b)) for a, b in zip(got, own))
