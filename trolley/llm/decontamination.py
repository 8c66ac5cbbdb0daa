"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of about ``SHARD_BYTES`` of text and
builds an FM-index over a shard's words: suffix array, Burrows-Wheeler
transform, wavelet matrix for ranks, and sampled suffix positions. All test
windows are searched backwards side by side, occurrences are located by
walking to the next sampled position, and their spans are merged.

The index's alphabet is the words of the test phrases; any other word, and a
document's end, is a border that no phrase crosses. Stretches between borders
that are shorter than the shortest window can't hold one and stay out of the
index, so its size follows what could match.

Documents are only mapped, never shuffled or grouped. The test items are a
stated query set: they pass through the driver in blocks of ``BLOCK_WORDS``
words, each block is one step of the map, and each step adds its spans.

Defined results: a null text or one without words has no windows and no hits;
an item without words matches nothing; items of one item_id count once, a
null item_id counts as the empty string; repeated documents are rows like any
other; an empty table on either side gives no hits; all columns of the
documents stay.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm.shared import slices, table

WINDOW = 10
SHARD_BYTES = 1 << 23
BLOCK_WORDS = 1 << 20
#: Every so many positions of a shard keep their place in the suffix array.
SAMPLE = 8

#: Words are runs of these bytes: digits, a-z, and all of longer characters.
_WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256)
)
_RUN = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Phrases:
    """The distinct windows of a block of test items, as numbers of words from 1."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            for k in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(ids[k : k + window], set()).add(number[name])
        self.shortest = min(map(len, found), default=0)
        by_length = sorted(found, key=len)
        #: Windows of one length: (length, first number, their words).
        self.groups = []
        for length, same in itertools.groupby(by_length, key=len):
            rows = np.array([*same], np.int64)
            self.groups.append((length, sum(len(g[2]) for g in self.groups), rows))
        of = [sorted(found[w]) for w in by_length]
        self.item_at = np.cumsum([0, *map(len, of)])
        self.items = np.array([k for own in of for k in own], np.int64)


class Bits:
    """A bit vector with ranks in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by doubling; each border (0) is a symbol of its own, before all words."""
    n = len(text)
    border = text == 0
    rank = np.where(border, np.cumsum(border) - 1, text + int(border.sum()))
    length = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - length)] = rank[length:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, bool)
        new[:1] = False
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        length *= 2


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int) -> None:
        """``text``: words from 1 to symbols - 1, borders 0; the last is a border."""
        order = suffix_array(text)
        last = text[order - 1]
        self.n = len(text)
        self.levels: list[tuple[int, Bits, int]] = []
        counts = np.bincount(text, minlength=symbols)
        self.before = np.cumsum(counts) - counts
        column = last
        for shift in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = (column >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            column = np.concatenate([column[~bit], column[bit]])
        every = np.arange(symbols)
        self.first = self._down(every, np.zeros(symbols, np.int64))
        # A walk back never has to cross a border: what follows one is sampled.
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.marks, self.places = Bits(sampled), order[sampled]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self._down(symbol, at) - self.first[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``patterns`` that occur, and the suffixes [low, high) that start with them."""
        row = np.arange(len(patterns))
        low, high = np.zeros(len(row), np.int64), np.full(len(row), self.n)
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[row, k]
            low = self.before[symbol] + self.rank(symbol, low)
            high = self.before[symbol] + self.rank(symbol, high)
            left = low < high
            row, low, high = row[left], low[left], high[left]
        return row, low, high

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes, by walking back to sampled ones."""
        out = np.empty(len(suffix), np.int64)
        left, at, steps = np.arange(len(suffix)), suffix, 0
        while len(left):
            known = self.marks.get(at)
            out[left[known]] = self.places[self.marks.rank(at[known])] + steps
            left, at = left[~known], at[~known]
            symbol, place = np.zeros(len(at), np.int64), at
            for shift, bits, zeros in self.levels:
                one, ones = bits.get(place), bits.rank(place)
                symbol |= one.astype(np.int64) << shift
                place = np.where(one, zeros + ones, place - ones)
            at = self.before[symbol] + place - self.first[symbol]
            steps += 1
        return out


def find(docs: list[list[bytes]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """For each document of a shard: merged spans of hit words, and the names of items with occurring windows."""
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    names: list[list[str]] = [[] for _ in docs]
    sizes = np.array([len(d) for d in docs], np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    get, none = phrases.number.get, itertools.repeat(0)
    joined = itertools.chain.from_iterable(itertools.chain(d, (b"",)) for d in docs)
    ids = np.fromiter(map(get, joined, none), np.int64, total)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ids != 0, [False]])))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= max(1, phrases.shortest)
    begin, end = begin[long], end[long]
    if not phrases.groups or not len(begin):
        return spans, names
    size = end - begin + 1  # with the border after it, which is 0 in ids as well
    stop = np.cumsum(size)
    source = np.arange(stop[-1]) + np.repeat(begin - stop + size, size)
    index = FmIndex(ids[source], len(phrases.number) + 1)
    places, windows, lengths = [], [], []
    for length, first, rows in phrases.groups:
        row, low, high = index.search(rows)
        count = high - low
        suffix = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
        places.append(source[index.locate(suffix)])
        windows.append(np.repeat(first + row, count))
        lengths.append(np.full(len(suffix), length))
    place, window, length = map(np.concatenate, (places, windows, lengths))
    if not len(place):
        return spans, names
    hit = np.zeros(total + 1, np.int64)
    np.add.at(hit, place, 1)
    np.add.at(hit, place + length, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(hit) > 0])))
    begin, end = edge[::2], edge[1::2]
    doc = np.searchsorted(start, begin, "right") - 1
    for d, a, b in zip(doc.tolist(), (begin - start[doc]).tolist(), (end - start[doc]).tolist()):
        spans[d].append((a, b))
    doc = np.searchsorted(start, place, "right") - 1
    pair = np.unique(np.stack([doc, window], 1), axis=0)
    for d, w in pair.tolist():
        names[d].extend(phrases.names[k] for k in phrases.items[phrases.item_at[w] : phrases.item_at[w + 1]])
    return spans, names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items in blocks of at least ``most`` words, streamed through the driver."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text"))
    for r in rows.toLocalIterator():
        words = words_of(r["text"])
        block.append((r["name"] or "", words))
        size += len(words)
        if size >= most:
            yield block
            block, size = [], 0
    yield block


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def _searched(phrases, cutting: bool = False):
    """The step of a block of test items, which adds its spans; ``cutting``: the last step, which cuts them all out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = phrases.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            held = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            spans, items, counts = [], [], []
            first = 0
            while first < len(texts):
                last, size, docs = first, 0, []
                while last < len(texts) and size < SHARD_BYTES:
                    docs.append(words_of(texts[last]))
                    size += len(texts[last] or "")
                    last += 1
                new_spans, new_items = find(docs, own)
                for k, (a, b) in enumerate(zip(new_spans, new_items), first):
                    old = [(s["first"], s["stop"]) for s in held[0][k]]
                    spans.append(merged(old + a))
                    items.append(sorted({*held[1][k], *b}))
                    counts.append(len(docs[k - first]))
                first = last
            if cutting:
                texts = [cut(t, s) if s else t for t, s in zip(texts, spans)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])
                continue
            spans = [[{"first": x, "stop": y} for x, y in s] for s in spans]
            arrays = [batch.column("key"), batch.column("text"), pa.array(counts, pa.int64())]
            arrays += [pa.array(spans, SPAN), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "text", "n_words", "spans", "items"])

    return run


def _steps(docs: DataFrame, benchmark: DataFrame, key: Column, window: int) -> tuple[DataFrame, Broadcast]:
    """The documents after the steps of all blocks of test items but one, and that one's phrases."""
    spark = docs.sparkSession
    rows = docs.select(
        key.alias("key"),
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:bigint,stop:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    phrases = None
    for block in _blocks(benchmark, BLOCK_WORDS):
        if phrases:
            rows = rows.mapInArrow(_searched(phrases), rows.schema)
        phrases = spark.sparkContext.broadcast(Phrases(block, window))  # BLOCK_WORDS words and one item at most
    return rows, phrases


def search(docs: DataFrame, benchmark: DataFrame, key: Column, window: int = WINDOW) -> DataFrame:
    """(key, text, n_words, spans, items) of every document.

    spans: merged [first, stop) of words inside any occurrence of a window;
    items: sorted ids of items with occurring windows.
    """
    rows, phrases = _steps(docs, benchmark, key, window)
    return rows.mapInArrow(_searched(phrases), rows.schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them; a line end in their place."""
    raw = text.encode("utf-8", "replace")
    word = [m.span() for m in _RUN.finditer(raw.translate(_FOLD))]
    out, at = [], 0
    for first, stop in spans:
        out.append(raw[at : word[first][0]])
        at = word[stop - 1][1]
    return b"\n".join([*out, raw[at:]]).decode("utf-8", "replace")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns; occurrences of test windows are cut out of ``text``."""
    rows, phrases = _steps(docs, benchmark, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), window)
    # Texts are cut where they are searched: a second step would take a second Python worker for each task.
    done = rows.mapInArrow(_searched(phrases, cutting=True), rows.select("key", "text").schema)
    return done.select(*[F.col("text") if c == "text" else F.col(f"key.`{c}`").alias(c) for c in docs.columns])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ``benchmark`` windows in every whole document."""
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), F.col("doc_id"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
