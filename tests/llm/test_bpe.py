from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trolley.llm import bpe as B
from trolley.llm import shared


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.VOCABULARY)


ODD = [
    "", "  ", None, "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ΟΔΟΣ", "don't we'll 'tis I'VE", "x\x1cy\x1d z\x85q r",
    "½ ² ٣ Ⅷ", "日本語 テスト", "éä", "😀😀 a😀b", "​﻿x", "ｆｕｌｌ", "naïve–dash…", "<|endoftext|", "\x00\x01\x02",
    "ª µº ßÿ ǅ", "ﬁ", "<|endoftext|>", "\xa0　",
]


def test_ids_and_text_equal_the_library(library, texts):
    rnd = random.Random(1)
    letters = "abcdeéßüthein 'ss.,!0123#\n\t\x1f\x85　ΣσİK日🙂́가"
    some = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    own = ODD + some + [t for _, t, _ in texts]
    flat, at = B.load(B.VOCABULARY).encode_batch(own)
    wanted = library.encode_batch([t or "" for t in own], add_special_tokens=False)
    for t, a, b, w in zip(own, at, at[1:], wanted):
        assert flat[a:b].tolist() == w.ids, t
        assert B.load(B.VOCABULARY).decode(flat[a:b]).decode() == library.decode(w.ids, skip_special_tokens=False)


def test_small_cache_gives_the_same(monkeypatch, texts):
    own = [t for _, t, _ in texts[:60]] + ODD
    flat, at = B.load(B.VOCABULARY).encode_batch(own)
    monkeypatch.setattr(B, "MAX_WORDS", 40)
    monkeypatch.setattr(B, "MAX_PAIRS", 10)
    again, at2 = B.Bpe(B.VOCABULARY).encode_batch(own)
    assert np.array_equal(flat, again) and np.array_equal(at, at2)


def test_trie_shares_prefixes():
    bpe = B.Bpe(B.VOCABULARY)
    made = bpe.encode_words({"internationalization", "internationalize", "internationally", "inter"})
    for word in ("internationalization", "inter"):
        ids = np.frombuffer(made[word], np.uint32)
        assert "".join(bpe.tokens[i] for i in ids) == word + B.END


def test_very_long_words(library):
    """Words of a million letters, two of them with a long prefix in common, in linear time."""
    rnd = random.Random(2)
    one = "".join(rnd.choice("abcdeéß") for _ in range(200_000))
    own = [f"{one}x {one}y", "a" * 1_000_000, "é" * 200_000, "日本" * 100_000]
    flat, at = B.load(B.VOCABULARY).encode_batch(own)
    wanted = library.encode_batch(own, add_special_tokens=False)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [w.ids for w in wanted]


def test_edge_rows(spark, docs, library):
    rows = B.encode(docs, digest=True).collect()
    assert len(rows) == 10
    by = {(r["doc_id"], r["n_tokens"]): r for r in rows}
    assert by[2, 0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == by[2, 0]["decoded_sha256"]
    back = {r["doc_id"]: r["text"] for r in B.decode(B.encode(docs)).collect()}
    text = next(r["text"] for r in docs.collect() if r["doc_id"] == 7)
    assert back[7] == library.decode(library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)
    assert B.encode(docs.limit(0)).collect() == []


def test_query(spark, sf, texts, library):
    rows = {r["doc_id"]: r for r in B.op3_bpe(spark, sf).collect()}
    assert len(rows) == len(texts)
    for i, text, _ in texts[::7]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(decoded).hexdigest()


def test_other_work_gives_up_the_vocabulary():
    B.load(B.VOCABULARY)
    shared.relax()  # the end of a task that used it
    assert B.load(B.VOCABULARY) is B.load(B.VOCABULARY)
    shared.relax()
    shared.relax()  # the end of a task that didn't
    assert B._made.cache_info().currsize == 0
    assert B.load(B.VOCABULARY).encode_batch(["again"])[0].tolist()


def test_unknown_letters_are_named():
    with pytest.raises(ValueError, match=r"no token has the letter ' '.*'a b '"):
        B.load(B.VOCABULARY).ids_of(["a b "])


def test_a_mark_at_the_end_of_a_full_buffer(library):
    """Texts whose parted words fill their buffer to the last byte, with bytes after it that are no letter."""
    bpe, pool = B.load(B.VOCABULARY), pa.default_memory_pool()
    for n in [61, 125, 189] * 20:
        own = ["x" * n, "."]
        held = [pa.allocate_buffer(size, memory_pool=pool) for size in [64, 128, 192, 256] * 200]
        for buffer in held:
            np.frombuffer(buffer, np.uint8)[:] = 0xFF
        del held[::2], buffer
        flat, at = bpe.encode_batch(own)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [w.ids for w in library.encode_batch(own, add_special_tokens=False)]
