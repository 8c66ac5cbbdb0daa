"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of labelled documents: ``DRAWN`` of each
class in the order of a hash, without near copies (verified similarity of
their word sets), at most ``EXAMPLES`` of each class. Every word of theirs is
a term; document frequencies are counted over all documents. A term's weight
is its inverse document frequency times a label weight: the squared deviation
of its share of toxic examples from that of all, in standard errors, plus a
constant, so that words which go with a label count for more and all count.

Every document is compared with all examples through an inverted index in
blocks: a block's largest weight of each term bounds its cosines, the blocks of
the highest bounds are computed first, and then all whose bound passes the
k-th best so far, so the neighbours are the exact ones. Distance-weighted
votes of the neighbours, each weighted by its class's share, are calibrated
on the examples themselves, each left out of its own vote; the nearest examples
and the shared words are the evidence.

Only the text makes a score. Defined results: null and empty texts and those
without known words have no neighbours and get the calibrated score of no
evidence; equal cosines (to 9 digits) go to the smaller doc_id; null doc_ids
count as held out; of several texts of a labelled doc_id the smallest is
learned from; labels that disagree count as toxic; repeated documents are
scored alike; without labels of both classes every score is the share of toxic
labels (0 without any); an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm import near
from trolley.llm.bpe import ragged
from trolley.llm.shared import settle, slices, table

#: Labelled documents of each class that are learned from at most, and drawn before near copies go.
EXAMPLES, DRAWN = 2048, 3072
NEIGHBOURS = 15
#: Examples of a block of the index, blocks of a document that are computed first, documents compared at a time.
BLOCK, FIRST, BATCH = 64, 8, 128
#: Share of the examples from which a term is frequent.
DENSE = 0.05
#: What every term weighs besides its label weight.
PLAIN_WEIGHT = 0.02
#: Vote weight of the labels' share besides the neighbours' squared cosines.
PRIOR_WEIGHT = 0.1
#: Similarity of word sets from which examples are near copies (in hundredths); bands and rows of their signatures.
COPY, BANDS, ROWS = 80, 20, 4
FOLDS, HELD_OUT = 5, 0

_MARKS = " .,;:!?'\"()[]{}<>|*#$%&-_+=/\\"


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words in lower case without marks at their ends: (text, term, count) of each that a text has, by text, and the terms."""
    # Without white space at the end, past which Arrow looks for a next letter.
    words = pc.utf8_split_whitespace(pc.utf8_rtrim_whitespace(pc.utf8_lower(texts.fill_null(""))))
    flat = pc.utf8_trim(words.flatten(), characters=_MARKS).dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    size = max(1, len(flat.dictionary))
    key, count = np.unique(owner * size + flat.indices.to_numpy(), return_counts=True)
    owner, term = np.divmod(key, size)
    word = pc.greater(pc.binary_length(flat.dictionary), 0).to_numpy(zero_copy_only=False)
    some = word[term] if len(term) else np.zeros(0, bool)
    return owner[some], term[some], count[some], flat.dictionary


def known_counts(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number in ``terms``, count) of the known words of the texts, by text."""
    owner, term, count, own = term_counts(texts)
    number = pc.fill_null(pc.index_in(own, value_set=terms), -1).to_numpy()
    number = number[term] if len(term) else np.zeros(0, np.int64)
    known = number >= 0
    return owner[known], number[known].astype(np.int64), count[known]


def without_copies(doc_ids: np.ndarray, toxic: np.ndarray, terms: list[np.ndarray]) -> np.ndarray:
    """Rows that stay: of each group of near copies of one label the smallest doc_id. terms: sorted distinct numbers."""
    held = [k for k, t in enumerate(terms) if len(t)]
    if not held:
        return np.arange(len(terms))
    flat = np.concatenate([terms[k] for k in held]).astype(np.uint64)
    mixed = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.cumsum([0, *(len(terms[k]) for k in held)])[:-1]
    keys = near.bands(near.minhash((mixed >> np.uint64(32)).astype(np.uint32), starts, BANDS * ROWS), ROWS)
    root = list(range(len(terms)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for band in keys.T:
        by: dict[tuple[int, int], list[int]] = {}
        for k, key in zip(held, band.tolist()):
            by.setdefault((key, int(toxic[k])), []).append(k)
        for own in by.values():
            for a in own[1:]:
                for b in own:
                    if b == a:
                        break
                    if top(a) == top(b):
                        continue
                    common = len(np.intersect1d(terms[a], terms[b], assume_unique=True))
                    if 100 * common >= COPY * (len(terms[a]) + len(terms[b]) - common):
                        root[top(a)] = top(b)
    best: dict[int, int] = {}
    for k in sorted(range(len(terms)), key=lambda k: doc_ids[k]):
        best.setdefault(top(k), k)
    return np.array(sorted(best.values()), np.int64)


@dataclass
class Model:
    """Terms with weights, examples in blocks, their postings by (term, example), and the calibration."""

    terms: list[str] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    doc_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def unit(self, owner: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Weights of the entries (owner, term, count) of ``n`` unit vectors."""
        value = (1 + np.log(count)) * self.weight[term]
        norm = np.sqrt(np.bincount(owner, value * value, n))
        return value / np.maximum(norm[owner], 1e-300)

    def index(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Postings of the examples' vectors, and for each (term, block) where they start and their largest weight.

        Terms of ``DENSE`` of the examples or more have their weights in a matrix of terms by examples instead.
        """
        held = np.bincount(term, minlength=len(self.terms))
        dense = np.flatnonzero(held >= max(2, DENSE * len(self.doc_ids)))
        self.dense_row = np.full(len(self.terms), -1)
        self.dense_row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), len(self.doc_ids)))
        row = self.dense_row[term]
        self.dense[row[row >= 0], owner[row >= 0]] = value[row >= 0]
        owner, term, value = owner[row < 0], term[row < 0], value[row < 0]
        order = np.lexsort((owner, term))
        owner, term, value = owner[order], term[order], value[order]
        self.post_row, self.post_value = owner.astype(np.int64), value
        key = term.astype(np.int64) * (1 + self.blocks) + owner // BLOCK
        self.at = np.flatnonzero(np.diff(key, prepend=-1))
        self.block = (owner // BLOCK)[self.at]
        self.most = np.maximum.reduceat(value, self.at) if len(value) else value
        self.of_term = np.searchsorted(term[self.at], np.arange(len(self.terms) + 1))
        self.at = np.append(self.at, len(value))

    @property
    def blocks(self) -> int:
        return -(-len(self.doc_ids) // BLOCK)

    def nearest(
        self, owner: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, leave_out: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the exact nearest examples of ``n`` unit vectors, best first; cosine 0: none."""
        size, blocks = len(self.doc_ids), self.blocks
        best, who = np.zeros((n, NEIGHBOURS)), np.full((n, NEIGHBOURS), -1, np.int64)
        if not size or not len(term):
            return best, who
        # What frequent terms add is computed for all examples at once; the largest of it in each block bounds the rest.
        row = self.dense_row[term]
        query = np.zeros((n, len(self.dense)))
        query[owner[row >= 0], row[row >= 0]] = value[row >= 0]
        base = query @ self.dense
        owner, term, value = owner[row < 0], term[row < 0], value[row < 0]
        width = self.of_term[term + 1] - self.of_term[term]
        entry = ragged(self.of_term[term], width)
        owner, value = np.repeat(owner, width), np.repeat(value, width)
        block = self.block[entry]
        bound = np.bincount(owner * blocks + block, value * self.most[entry], n * blocks).reshape(n, blocks)
        bound = (bound + np.maximum.reduceat(base, np.arange(0, size, BLOCK), axis=1)) * (1 + 1e-9)

        def cosines(chosen: np.ndarray) -> np.ndarray:
            some = chosen[owner, block]
            start = self.at[entry[some]]
            length = self.at[entry[some] + 1] - start
            place = ragged(start, length)
            where = np.repeat(owner[some] * size, length) + self.post_row[place]
            return np.bincount(where, np.repeat(value[some], length) * self.post_value[place], n * size).reshape(n, size)

        def left(found: np.ndarray) -> np.ndarray:
            if leave_out is not None:
                found[np.arange(n), leave_out] = 0
            return found

        chosen = np.zeros((n, blocks), bool)
        first = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        np.put_along_axis(chosen, first, True, 1)
        found = left(base + cosines(chosen))
        k = min(NEIGHBOURS, size)
        kth = np.partition(found, size - k, axis=1)[:, size - k]
        # Other blocks hold only what frequent terms add, which is not above their bounds.
        rest = ~chosen & (bound > 0) & (bound >= kth[:, None])
        if rest.any():
            found = left(found + cosines(rest))
        # Equal cosines in the order of doc_ids.
        rank = np.empty(size, np.int64)
        rank[np.argsort(self.doc_ids, kind="stable")] = np.arange(size)
        key = -(np.rint(found * 1e9).astype(np.int64) * size + size - 1 - rank)
        top = np.argpartition(key, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(key, top, 1), axis=1), 1)
        best[:, :k] = np.take_along_axis(found, top, 1)
        who[:, :k] = np.where(best[:, :k] > 0, top, -1)
        return best, who

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Share of toxic neighbours by squared cosine and the share of their class among all labels, drawn towards the labels' share."""
        if not len(self.toxic):
            return np.full(len(best), self.share)
        mark = np.where(who >= 0, self.toxic[who], 0)
        weight = best * best * self.class_weight()[who]
        return ((weight * mark).sum(1) + PRIOR_WEIGHT * self.share) / (weight.sum(1) + PRIOR_WEIGHT)

    def class_weight(self) -> np.ndarray:
        own = self.toxic.mean()
        return np.where(self.toxic > 0, self.share / max(own, 1e-9), (1 - self.share) / max(1 - own, 1e-9))

    def calibrate(self, votes: np.ndarray) -> None:
        """Logistic curve from votes to labels by Newton's method, classes weighted by their share among all labels."""
        weight = self.class_weight()
        x = np.stack([votes, np.ones(len(votes))], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weight * (p - self.toxic)) + 1e-3 * w
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(curve, slope)
            w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        self.slope, self.offset = w

    def score(self, votes: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(votes), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * votes + self.offset, -30, 30)))


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS, F.lit(HELD_OUT))


def _frequencies(terms):
    """(term, n): documents of the task with each term, and all of them as term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array(terms.value, pa.string())
        total, counts = 0, np.zeros(len(own), np.int64)
        for batch in slices(batches):
            total += batch.num_rows
            counts += np.bincount(known_counts(batch.column(0), own)[1], minlength=len(own))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], total))], ["term", "n"])

    return run


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        owner, term, count, words = term_counts(batch.column("text"))
        terms = _lists(owner, batch.num_rows, words.take(pa.array(term)))
        times = _lists(owner, batch.num_rows, pa.array(count, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), terms, times], ["doc_id", "toxic", "terms", "counts"])


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, drawn: int = DRAWN) -> Model:
    """A model from labels (doc_id, toxic) outside the held-out fold and the texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(share=totals.get(1, 0) / max(1, sum(totals.values())))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(drawn) for y in (0, 1)]
    chosen = settle(chosen[0].union(chosen[1]), "examples")  # at most 2 * drawn rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sample.mapInArrow(_counted, "doc_id long, toxic int, terms array<string>, counts array<long>").toArrow().combine_chunks()
    doc_ids, toxic = (found.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "toxic"))
    if not 0 < toxic.sum() < len(toxic):
        return model
    # The driver holds the words of the examples, at most 2 * drawn, and nothing of other documents.
    words = found.column("terms").combine_chunks()
    encoded = words.flatten().dictionary_encode()
    at = words.offsets.to_numpy() - words.offsets[0].as_py()
    term, count = encoded.indices.to_numpy().astype(np.int64), found.column("counts").combine_chunks().flatten().to_numpy()
    stay = without_copies(doc_ids, toxic, [np.sort(term[a:b]) for a, b in zip(at, at[1:])])
    order = {d: k for k, d in enumerate(sorted(doc_ids[stay].tolist(), key=lambda d: xxhash.xxh3_64_intdigest(str(d))))}
    stay = sorted(stay.tolist(), key=lambda k: order[int(doc_ids[k])])
    stay = np.array([k for y in (0, 1) for k in [k for k in stay if toxic[k] == y][:examples]], np.int64)

    size = np.diff(at)[stay]
    place = ragged(at[:-1][stay], size)
    owner = np.repeat(np.arange(len(stay)), size)
    used, term = np.unique(term[place], return_inverse=True)
    count = count[place].astype(float)
    doc_ids, toxic = doc_ids[stay], toxic[stay].astype(float)
    model.terms = encoded.dictionary.take(pa.array(used)).to_pylist()
    held = spark.sparkContext.broadcast(model.terms)
    counts = own.select("text").mapInArrow(_frequencies(held), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    of = np.zeros(len(used) + 1)  # the last: all documents
    of[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    n, bad = np.bincount(term, minlength=len(used)), np.bincount(term, toxic[owner], len(used))
    own_share = toxic.mean()
    deviation = (bad - n * own_share) / np.sqrt(n * own_share * (1 - own_share) + 1)
    model.weight = (np.log((1 + of[-1]) / (1 + of[:-1])) + 1) * (deviation**2 + PLAIN_WEIGHT)

    # Examples of one strongest term stand together, so that blocks have tight bounds.
    value = model.unit(owner, term, count, len(stay))
    strongest = np.full(len(stay), len(used))
    by = np.lexsort((term, -value, owner))
    heads = by[np.flatnonzero(np.diff(owner[by], prepend=-1))]
    strongest[owner[heads]] = term[heads]
    order = np.lexsort((doc_ids, strongest))
    place = np.empty(len(stay), np.int64)
    place[order] = np.arange(len(stay))
    owner = place[owner]
    model.doc_ids, model.toxic = doc_ids[order], toxic[order]
    model.index(owner, term, value)
    by = np.argsort(owner, kind="stable")
    owner, term, value = owner[by], term[by], value[by]
    votes = []
    for first in range(0, len(stay), BATCH):
        a, b = np.searchsorted(owner, (first, first + BATCH))
        n = min(BATCH, len(stay) - first)
        votes.append(model.votes(*model.nearest(owner[a:b] - first, term[a:b], value[a:b], n, np.arange(first, first + n))))
    model.calibrate(np.concatenate(votes))
    return model


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        terms = pa.array(model.terms, pa.string())
        for batch in slices(batches):
            owner, term, count = known_counts(batch.column("text"), terms)
            value = model.unit(owner, term, count.astype(float), batch.num_rows)
            # The weightiest words of each text.
            order = np.lexsort((term, -value, owner))
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            heads = order[rank < 5]
            hits = _lists(owner[heads], batch.num_rows, terms.take(pa.array(term[heads])))
            best, who = np.zeros((batch.num_rows, NEIGHBOURS)), np.full((batch.num_rows, NEIGHBOURS), -1)
            for first in range(0, batch.num_rows, BATCH):
                n = min(BATCH, batch.num_rows - first)
                a, b = np.searchsorted(owner, (first, first + n))
                best[first : first + n], who[first : first + n] = model.nearest(owner[a:b] - first, term[a:b], value[a:b], n)
            row, place = np.nonzero(who[:, :3] >= 0)
            example = who[row, place]
            fields = [model.doc_ids[example], best[row, place], model.toxic[example].astype(np.int64)] if len(row) else [[], [], []]
            fields = [pa.array(x, t) for x, t in zip(fields, (pa.int64(), pa.float64(), pa.int64()))]
            near_ = _lists(row, batch.num_rows, pa.StructArray.from_arrays(fields, ["doc_id", "cosine", "toxic"]))
            score = pa.array(model.score(model.votes(best, who)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), score, near_, hits], NAMES)

    return run


NAMES = ["key", "score", "nearest", "terms"]


def score(docs: DataFrame, model: Model, key: Column) -> DataFrame:
    """(key, score, nearest, terms): with evidence, the three nearest examples and the text's five weightiest words."""
    rows = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * EXAMPLES examples and their words
    kind = rows.schema["key"].dataType.simpleString()
    evidence = "array<struct<doc_id:bigint,cosine:double,toxic:bigint>>"
    return rows.mapInArrow(_scored(held), f"key {kind}, score double, nearest {evidence}, terms array<string>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    found = score(docs, model, F.col("doc_id"))
    return found.select(
        F.col("key").alias("doc_id"),
        (fold(F.col("key")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("nearest.doc_id").alias("nearest"),
        "terms",
    )
