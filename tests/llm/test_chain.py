"""The whole pipeline against plain Python, and what its stages hand on."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_decontamination import WORD, words
from tests.llm.test_quality import brute as base_counts
from trolley.llm import quality as Q
from trolley.llm.bpe import VOCABULARY

SPLIT = re.compile(rb"[ \t\n\x0b\x0c\r]+")


def _words(text) -> list[bytes]:
    return [w for w in SPLIT.split((text or "").encode()) if w]


def _plain(word: bytes) -> str:
    return word.decode().lower().strip(".,;:!?'\"()-")


def _classes(text) -> list[int]:
    """Characters by class: lower, upper, digit, blank, line end, sentence mark, symbol, other ASCII, longer."""
    out = [0] * 9
    for c in text or "":
        for k, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:!?'\"()-", "#*$%&|<>")):
            if c in members:
                out[k] += 1
                break
        else:
            out[7 if ord(c) < 128 else 8] += 1
    return out


def _distance(p, q) -> float:
    p, q = ([x / max(1, sum(v)) for x in v] for v in (p, q))
    kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))


def verdicts(rows) -> dict:
    """doc_id -> (class distance, word distance, kept) of rows (doc_id, text, lang), from the definitions."""
    counts: dict = {}
    for _, text, lang in rows:
        counts.setdefault(lang or "", Counter()).update(x for x in map(_plain, _words(text)) if x)
    common = {
        lang: {w: k for k, w in enumerate(sorted(c, key=lambda w: (-c[w], w.encode()))[: Q.COMMON_WORDS])}
        for lang, c in counts.items()
        if sum(c.values()) >= Q.MIN_REFERENCE_WORDS
    }

    def histogram(text, lang):
        out = [0] * (Q.COMMON_WORDS + 1)
        for w in _words(text):
            out[common.get(lang, {}).get(_plain(w), Q.COMMON_WORDS)] += 1
        return out

    references: dict = {}
    for text, lang in {(t or "", g or "") for _, t, g in rows}:
        own = references.setdefault(lang, [0, np.zeros(9), np.zeros(Q.COMMON_WORDS + 1)])
        own[0] += len(_words(text))
        own[1] += _classes(text)
        own[2] += histogram(text, lang)
    out = {}
    for i, text, lang in rows:
        n, _, _, _, repeats = base_counts(text)
        apart = None, None
        if references[lang or ""][0] >= Q.MIN_REFERENCE_WORDS:
            _, classes, common_words = references[lang or ""]
            apart = _distance(_classes(text), classes.tolist()), _distance(histogram(text, lang or ""), common_words.tolist())
        odd = apart[0] is not None and (
            (len(text or "") >= Q.MIN_CHARS and apart[0] > Q.MAX_CLASS_DISTANCE)
            or (n >= Q.MIN_WORDS and apart[1] > Q.MAX_WORD_DISTANCE)
        )
        out[i] = *apart, not (n < 10 or 100 * repeats > 20 * n) and not odd
    return out


def test_quality_verdicts_from_the_definitions(spark, sf, texts):
    wanted = verdicts(texts)
    for r in Q.op6_quality(spark, sf).collect():
        classes, common, kept = wanted[r["doc_id"]]
        assert r["kept"] == kept
        for got, x in ((r["class_distance"], classes), (r["word_distance"], common)):
            assert (got is None) == (x is None) and (x is None or abs(got - x) < 1e-9)


def _without_windows(text: str, items: list[str]) -> str:
    """The text without words in a window of ten that an item has, and what stands between such words."""
    windows = set()
    for item in items:
        w = words(item)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    w, hit = words(text), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    spans = [m.span() for m in WORD.finditer(folded)]
    out, at, k = [], 0, 0
    while k < len(spans):
        if k in hit:
            first = k
            while k + 1 in hit:
                k += 1
            out.append(text[at : spans[first][0]])
            at = spans[k][1]
        k += 1
    return "\n".join([*out, text[at:]])


def _drop_lines(rows) -> dict:
    """doc_id -> text without lines that stay elsewhere, without the documents that lose all."""
    lines = {(i, k): p for i, t in rows for k, x in enumerate(t.split("\n")) if (p := " ".join(x.lower().split()))}
    group = brute.groups({p: frozenset(p[j : j + 5] for j in range(max(1, len(p) - 4))) for p in set(lines.values())}, 85, 100)
    first: dict = {}
    for key in sorted(lines):
        first.setdefault(group[lines[key]], key)
    out = {}
    for i, t in rows:
        stay = [x for k, x in enumerate(t.split("\n")) if (i, k) not in lines or first[group[lines[i, k]]] == (i, k)]
        if "\n".join(stay).strip() or len(stay) == len(t.split("\n")):
            out[i] = "\n".join(stay)
    return out


def test_whole_pipeline_against_plain_python(spark, sf, texts):
    kept = verdicts(texts)
    docs = _drop_lines([(i, t) for i, t, _ in texts if kept[i][2]])
    near = brute.groups({i: brute.word_shingles(t, 5) for i, t in docs.items()}, 80, 100)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {i: _without_windows(t, items) for i, t in docs.items() if near[i] == i}
    library = Tokenizer.from_file(VOCABULARY)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) > 0, r["doc_id"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), r["doc_id"]


def test_near_duplicates_and_emptied_documents_go(spark, sf):
    """Copies whose lines are broken elsewhere pass the lines' stage and go as near-duplicates; emptied ones go before."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(12)
    again = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    words_ = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    cut = F.transform(words_, lambda w, k: F.concat(w, F.when(k % 7 == 3, "\n").otherwise(" ")))
    rewrapped = again.withColumn("text", F.array_join(cut, ""))
    copies = docs.withColumn("doc_id", F.col("doc_id") + 2_000_000)
    rows = docs.unionByName(rewrapped).unionByName(copies)
    out = corpus_pipeline.lines(spark, rows, sf).persist()
    ids = {r["doc_id"] for r in out.collect()}
    assert not any(i >= 2_000_000 for i in ids) and sum(i >= 1_000_000 for i in ids) == 12
    assert out.where("trim(text) = ''").count() == 0
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, out, sf).collect()}
    assert left < ids and not any(i >= 1_000_000 for i in left)
