"""Quality rules by distribution divergence.

Each document's histogram of character classes and of its language's common
words is compared with the language's reference by Jensen-Shannon distance.
References come from the whole corpus: the common words are the most frequent
ones by language over all documents, the reference histograms sum over all
distinct texts, so a group of copies counts once. Short documents and
languages with little text are not judged by a distance that their length
can't support (minimum-length guards).

Defined results: a null or empty text has no words and fails the base rule;
a null language is a language of its own; repeated rows are judged alike;
an empty table gives an empty result; other columns of ``documents`` are kept
by ``keep`` and not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trolley.llm.shared import settle, slices, table

#: Common words of a language's histogram (the rest is one bin).
COMMON_WORDS = 100
#: Largest distances kept, and the characters and words from which each counts.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.30, 300
MAX_WORD_DISTANCE, MIN_WORDS = 0.50, 50
#: Words of distinct texts that a language needs for a reference.
MIN_REFERENCE_WORDS = 5_000
#: Distinct words that a task counts before it hands them on.
FLUSH_WORDS = 200_000
#: Parts in which a language's words are ranked first.
SALTS = 32

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: By byte: lower case, upper case, digit, space, line end, sentence mark, symbol, other ASCII, first byte of a longer character; -1: the rest of one.
CLASSES = 9


def _byte_classes() -> np.ndarray:
    classes = np.full(256, 7, np.int8)
    for k, members in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t\x0b\x0c\r", b"\n", b".,;:!?'\"()-", SYMBOLS]):
        classes[list(members)] = k
    classes[0x80:0xC0] = -1
    classes[0xC0:] = 8
    return classes


BYTE_CLASS = _byte_classes()
STRIP = b".,;:!?'\"()-"


def plain(word: bytes) -> str:
    """A word without marks at its ends, in lower case: what a common word is compared by."""
    return word.decode("utf-8", "replace").lower().strip(STRIP.decode())


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of so many words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (own[k : k + n] ^ (own[k : k + n] >> np.uint64(29)))
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) over the task's documents."""
    counts: dict[str, Counter[bytes]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, raw in counts.items():
            merged: Counter[str] = Counter()
            for word, n in raw.items():
                merged[plain(word)] += n
            merged.pop("", None)
            if merged:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(merged)), pa.array(list(merged)), pa.array(list(merged.values()), pa.int64())],
                    ["lang", "word", "n"],
                )
        counts.clear()

    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update((text or "").encode("utf-8", "replace").split())
        if sum(map(len, counts.values())) > FLUSH_WORDS:
            yield from flush()
    yield from flush()


def common_words(docs: DataFrame, count: int = COMMON_WORDS) -> DataFrame:
    """(lang, words): each language's most frequent words, ties by the word; ``docs``: lang, text.

    Languages with too few words for a reference are left out.
    """
    counts = docs.mapInArrow(_counted, "lang string, word string, n long")
    counts = settle(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    enough = counts.groupBy("lang").agg(F.sum("n").alias("all")).where(F.col("all") >= MIN_REFERENCE_WORDS)
    # A list of languages and no join on them, which would deal out the counts by language.
    counts = counts.where(F.col("lang").isin([r["lang"] for r in enough.collect()]))
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
    # Best of the best of each part: no task ranks a whole language.
    for key in (["lang", "salt"], ["lang"]):
        ranked = Window.partitionBy(*key).orderBy(F.desc("n"), "word")
        counts = counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= count)
    return counts.groupBy("lang").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words")
    )


def _measured(common: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: {w: k for k, w in enumerate(words)} for lang, words in common.items()}
        known: dict[str, dict[bytes, int]] = {}
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in MEASURES}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                words = raw.split()
                by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                classes = np.bincount(BYTE_CLASS[BYTE_CLASS >= 0], by_byte[BYTE_CLASS >= 0], CLASSES).astype(np.int64)
                out["n_words"].append(len(words))
                out["word_chars"].append(int(classes.sum() - by_byte[list(SPACES)].sum()))
                out["n_symbols"].append(int(by_byte[list(SYMBOLS)].sum()))
                lines = [x for x in raw.split(b"\n") if x.strip()]
                out["n_dup_lines"].append(len(lines) - len(set(lines)))
                out["n_repeat_words"].append(repeated_words(words))
                out["classes"].append(classes.tolist())
                bins, found = place.get(lang, {}), known.setdefault(lang, {})
                if len(found) > FLUSH_WORDS:
                    found.clear()
                histogram: Counter[int] = Counter()
                for word, n in Counter(words).items():
                    k = found.get(word)
                    if k is None:
                        k = found[word] = bins.get(plain(word), -1)
                    if k >= 0:
                        histogram[k] += n
                out["bins"].append(list(histogram.keys()))
                out["counts"].append(list(histogram.values()))
            arrays = [batch.column("key"), batch.column("lang"), batch.column("h")]
            arrays += [pa.array(out[c], pa.list_(pa.int64()) if c in LISTS else pa.int64()) for c in MEASURES]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "lang", "h", *MEASURES])

    return run


LISTS = ("classes", "bins", "counts")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *LISTS)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of the same bins."""
    p, q = p / max(p.sum(), 1.0), q / max(q.sum(), 1.0)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return float(np.sqrt(max(terms.sum() / 2, 0.0)))


def _compared(references: dict[str, tuple[int, np.ndarray, np.ndarray]], words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(c).to_pylist() for c in ("lang", "n_words", *LISTS)}
            found = []
            for lang, n, classes, bins, counts in zip(*get.values()):
                reference = references.get(lang)
                own = np.zeros(words + 1)
                own[bins] = counts
                own[words] = n - own[:words].sum()
                apart = (None, None)
                if reference:
                    apart = distance(np.array(classes, float), reference[1]), distance(own, reference[2])
                found.append((sum(classes), reference[0] if reference else 0, *apart))
            names = ["key", *[c for c in MEASURES if c not in LISTS]]
            arrays = [batch.column(c) for c in names]
            arrays += [pa.array([f[k] for f in found], pa.int64() if k < 2 else pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *COMPARED])

    return run


COMPARED = ("n_chars", "reference_words", "class_distance", "word_distance")


def measure(docs: DataFrame, key: Column, words: int = COMMON_WORDS) -> DataFrame:
    """One row for each document: its ``key``, counts of the base rule, class_distance, word_distance, reference_words.

    A distance is null where the language has no reference. What is collected
    are two short lists for each language: its common words, its reference.
    """
    own = docs.select(
        key.alias("key"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("h"),
    )
    common = {r["lang"]: r["words"] for r in common_words(own.select("lang", "text"), words).collect()}
    schema = T.StructType([own.schema["key"], own.schema["lang"], own.schema["h"]])
    for c in MEASURES:
        schema = schema.add(c, T.ArrayType(T.LongType()) if c in LISTS else T.LongType())
    measured = settle(own.mapInArrow(_measured(common), schema), "quality")
    distinct = measured.groupBy("lang", "h", "n_words", "word_chars").agg(
        *[F.first(c).alias(c) for c in LISTS]
    )
    # References in long form: (lang, kind, bin, n), at most CLASSES + words + 1 rows for a language.
    by_class = distinct.select("lang", F.lit("classes").alias("kind"), F.posexplode("classes").alias("bin", "n"))
    by_word = distinct.select(
        "lang", F.lit("words").alias("kind"), F.explode(F.arrays_zip("bins", "counts")).alias("x")
    ).select("lang", "kind", F.col("x.bins").cast("int").alias("bin"), F.col("x.counts").alias("n"))
    totals = distinct.groupBy("lang").agg(F.sum("n_words").alias("all_words"))
    found = by_class.unionByName(by_word).groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))
    totals = totals.where(F.col("all_words") >= MIN_REFERENCE_WORDS)
    sizes = {r["lang"]: r["all_words"] for r in totals.collect()}
    references = {lang: (n, np.zeros(CLASSES), np.zeros(words + 1)) for lang, n in sizes.items()}
    for r in found.where(F.col("lang").isin(list(sizes))).collect():
        references[r["lang"]][1 + (r["kind"] == "words")][r["bin"]] = r["n"]
    for n, _, by_word in references.values():
        by_word[words] = n - by_word[:words].sum()
    schema = T.StructType([f for f in measured.schema if f.name in ("key", *MEASURES) and f.name not in LISTS])
    for k, c in enumerate(COMPARED):
        schema = schema.add(c, T.LongType() if k < 2 else T.DoubleType())
    return measured.mapInArrow(_compared(references, words), schema)


def judge(measured: DataFrame) -> DataFrame:
    """``measure``'s rows with base_failed and kept."""
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    odd_classes = (F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    odd_words = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    odd = F.coalesce(odd_classes, F.lit(False)) | F.coalesce(odd_words, F.lit(False))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~odd)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    rows = judge(measure(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    return rows.where("kept").select("key.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole document."""
    rows = judge(measure(table(spark, sf_dir, "documents"), F.col("doc_id")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select(F.col("key").alias("doc_id"), *names, "class_distance", "word_distance")
