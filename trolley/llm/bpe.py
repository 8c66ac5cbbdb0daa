"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch are visited in sorted order, which is the
depth-first order of their trie. Each trie node keeps one state, the last
token of its prefix's encoding, so a shared prefix is encoded once; a word's
ids follow by walking the last tokens back to the root. The state of a node
is the one vocabulary token that ends there and may stand after the state of
the node where that token starts: a merge order allows exactly one.

Whole texts are encoded inside map tasks; nothing is shuffled. The memory of a
worker is bounded by ``MAX_WORDS`` remembered words, not by the corpus.

Defined results: a null or empty text has no ids and decodes to the empty
string; strings of special tokens in a text become their ids; repeated rows
are encoded alike; a repeated doc_id gives one row per input row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm.shared import keep, relax, slices, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words that a worker remembers: the newest, and as many before them.
MAX_WORDS = 300_000
#: Texts that are parted into words at a time: most of a worker's memory.
SLICE = 500
#: Remembered outcomes for pairs of tokens.
MAX_PAIRS = 1_000_000

END = "</w>"
#: Letters, numbers and the rest as the tokenizer's pattern splits them, for texts of Latin-1 characters only.
_LATIN_LETTERS, _LATIN_NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
#: All but letters; white space parts these and letters.
_LATIN_REST = rf"'(?:s|t|re|ve|m|ll|d)|[{_LATIN_NUMBERS}]|[^\t-\r \x85\xa0{_LATIN_LETTERS}{_LATIN_NUMBERS}]+"
_LATIN = re.compile(rf"[{_LATIN_LETTERS}]+|{_LATIN_REST}")
_UNICODE = regex.compile(
    r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}"
    r"|[^\x09-\x0d\x20\x85\xa0  -     　\p{L}\p{N}]+"
)
#: Parts of special tokens, and what Arrow takes for white space and the tokenizer's pattern doesn't.
_ODD = r"<\||[\x1c-\x1f]"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def is_latin(text: str) -> bool:
    """Whether all characters are Latin-1."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Node(dict):
    """Automaton node: its steps by letter (ways through the fail links are taken once), and the tokens that end there."""

    __slots__ = ("at_end", "fail", "inside")

    def __init__(self) -> None:
        self.fail: _Node | None = None
        self.inside: tuple[tuple[int, int, dict[int, bool]], ...] = ()
        self.at_end: tuple[tuple[int, int, dict[int, bool]], ...] = ()

    def __missing__(self, letter: str) -> _Node:
        back = self.fail
        while back is not None and letter not in back:
            back = back.fail
        if back is None:
            raise ValueError(f"no token has the letter {letter!r}")
        after = self[letter] = back[letter]
        return after


class Bpe:
    """One vocabulary file: encoder with its word cache, and decoder tables."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs: dict[tuple[int, int], int] = {}
        #: By token: rank of the merge that makes it (-1 for a single symbol), and its two halves.
        self.rank, self.left, self.right = ([-1] * (1 + max(self.vocab.values())) for _ in range(3))
        for rank, (x, y) in enumerate(merges):
            left, right, made = self.vocab[x], self.vocab[y], self.vocab[x + y]
            self.pairs.setdefault((left, right), rank)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, left, right
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.ends = {t.removesuffix(END): i for t, i in self.vocab.items() if t.endswith(END)}
        self.size = [len(t.removesuffix(END)) for t in self.tokens]
        self.root = self.automaton()
        self.letters = {b: x for b, x in enumerate(byte_letters()) if b != 10}
        #: Ids of words as bytes (uint32), and of those before ``MAX_WORDS`` newer ones.
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.remembered: list[dict[int, bool]] = []
        pieces = [(t + " ").encode() for t in self.tokens]
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    # One word -----------------------------------------------------------

    def automaton(self) -> _Node:
        """Aho-Corasick automaton of all tokens: by node, those that end there, longest first; inside words and at ends."""
        inner = {t: i for t, i in self.vocab.items() if not t.endswith(END)}
        nodes = {"": _Node()}
        for p in sorted({t[:k] for t in [*inner, *self.ends] for k in range(1, len(t) + 1)}, key=lambda p: (len(p), p)):
            node = nodes[p] = nodes[p[:-1]][p[-1]] = _Node()
            node.fail = next(nodes[p[k:]] for k in range(1, len(p) + 1) if p[k:] in nodes)
            node.inside = (((inner[p], len(p), {}),) if p in inner else ()) + node.fail.inside
            node.at_end = (((self.ends[p], len(p), {}),) if p in self.ends else ()) + node.fail.at_end
        return nodes[""]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the text of two tokens is encoded as these two.

        Undoes the merges of both, latest first: another outcome needs a merge
        across the border that comes before one of those undone.
        """
        rank, limit = self.rank, len(self.pairs)
        a, b = left, right
        while self.pairs.get((a, b), limit) >= limit:
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[b] >= rank[a]:  # of equal merges the left one comes first
                limit, b = rank[b] + 1, self.left[b]
            else:
                limit, a = rank[a], self.right[a]
        return False

    def fitting(self, left: int, token: int, known: dict[int, bool]) -> bool:
        """``may_follow``, remembered by the right token."""
        self.remembered.append(known)
        if len(self.remembered) > MAX_PAIRS:
            for pairs in self.remembered:
                pairs.clear()
            self.remembered.clear()
        ok = known[left] = self.may_follow(left, token)
        return ok

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct byte-letter words, by depth-first traversal of their trie.

        Of the tokens that end at a node, longest first, the one that fits is
        its state: the whole prefix, or one that may follow the state of the
        node where it starts.
        """
        states, nodes = [-1], [self.root]  # by depth along the path: last token, automaton node
        path, size, fitting, pack, push, push_node = "", self.size, self.fitting, array, states.append, nodes.append
        out: dict[str, bytes] = {}
        for word in sorted(words):
            depth, most = 0, min(len(states), len(word)) - 1
            while depth < most and path[depth] == word[depth]:
                depth += 1
            del states[depth + 1 :], nodes[depth + 1 :]
            node, path = nodes[-1], word
            for letter in word[depth:-1]:
                node = node[letter]
                depth += 1
                for token, length, memo in node.inside:
                    if length == depth:
                        break
                    left = states[depth - length]
                    ok = memo.get(left)
                    if fitting(left, token, memo) if ok is None else ok:
                        break
                push(token)
                push_node(node)
            depth += 1
            for token, length, memo in node[word[-1]].at_end:  # it ends this word only
                if length == depth:
                    break
                left = states[depth - length]
                ok = memo.get(left)
                if fitting(left, token, memo) if ok is None else ok:
                    break
            ids, depth = [token], depth - size[token]
            while depth:
                ids.append(states[depth])
                depth -= size[states[depth]]
            ids.reverse()
            out[word] = pack("I", ids).tobytes()
        return out

    # Texts --------------------------------------------------------------

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as the pattern parts them (`` id``: a special token)."""
        now, older = self.words, self.older
        missing = []
        for w in words:
            if w not in now:
                ids = older.get(w)
                if ids is None:
                    missing.append(w)
                else:
                    now[w] = ids
        for first in range(0, len(missing), MAX_WORDS):
            new = missing[first : first + MAX_WORDS]
            odd = [w for w in new if not (w.isascii() and w.isprintable())]
            letters = "\n".join(odd).encode("utf-8", "replace").decode("latin-1").translate(self.letters).split("\n")
            special = [w for w in new if w[0] == " "]
            now.update((w, array("I", [int(w)]).tobytes()) for w in special)
            plain = {w: w for w in new}
            plain.update(zip(odd, letters))
            for w in special:
                del plain[w]
            try:
                made = self.encode_words(set(plain.values()))
            except ValueError as e:
                odd = [(w, x) for w, x in plain.items() if not self.root.keys() >= set(x)]
                raise ValueError(f"{e}: words as parted and in letters {odd[:20]!r}") from e
            now.update(zip(plain, map(made.__getitem__, plain.values())))
        return [now[w] for w in words]

    def words_of(self, text: str) -> list[str]:
        """Words of a text in order, as the pattern parts them; special tokens as `` id``."""
        if "<|" not in text:
            return self.plain_words_of(text)
        out: list[str] = []
        for k, part in enumerate(self.find_special.split(text)):
            out += [f" {self.special[part]}"] if k % 2 else self.plain_words_of(part)
        return out

    def plain_words_of(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (_LATIN if is_latin(text) else _UNICODE).findall(text)

    def encode_batch(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (uint32), and where each text starts, with the end."""
        if len(self.words) > MAX_WORDS:  # what was not used lately is forgotten
            self.words, self.older = {"": b""}, self.words
        held = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # Copies of one text are encoded once.
        once = held.fill_null("").dictionary_encode()
        own, distinct = once.indices.to_numpy(), once.dictionary
        # Arrow lowers and parts texts of Latin-1 characters alike; the rest goes text by text.
        odd = pc.match_substring_regex(distinct, _ODD).to_numpy(zero_copy_only=False)
        simple = np.array([not x and is_latin(t) for x, t in zip(odd, distinct.to_pylist())], bool)
        parted = pc.replace_substring_regex(pc.utf8_lower(distinct.filter(pa.array(simple))), _LATIN_REST, r" \0 ")
        # Arrow looks past white space for the next letter, at the end of a text into memory that follows it.
        lists = pc.utf8_split_whitespace(pc.utf8_rtrim_whitespace(parted))
        others = pa.array([self.words_of(t) for t in distinct.filter(pa.array(~simple)).to_pylist()], lists.type)
        flat, sizes = [], []
        for part in (lists, others):
            words = part.flatten().dictionary_encode()
            ids = self.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            length = np.array([len(x) >> 2 for x in ids], np.int64)
            pool, at = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(length) - length
            where = words.indices.to_numpy()
            flat.append(pool[ragged(at[where], length[where])])
            total = np.concatenate([[0], np.cumsum(length[where])])
            sizes.append(np.diff(total[part.offsets.to_numpy() - part.offsets[0].as_py()]) if len(part) else np.zeros(0, np.int64))
        size = np.empty(len(distinct), np.int64)
        size[simple], size[~simple] = sizes
        ends = np.concatenate([np.cumsum(sizes[0]), len(flat[0]) + np.cumsum(sizes[1])])
        start = np.empty(len(distinct), np.int64)
        start[np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])] = ends - np.concatenate(sizes)
        starts = np.concatenate([[0], np.cumsum(size[own])])
        if simple.all() and len(own) == len(distinct):
            return flat[0], starts
        return np.concatenate(flat)[ragged(start[own], size[own])], starts

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by spaces, in UTF-8."""
        return self.piece_bytes[ragged(self.piece_at[ids], self.piece_len[ids])].tobytes()[:-1]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for each further start."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - ends + length, length)


@functools.lru_cache(maxsize=2)
def _made(path: str) -> Bpe:
    bpe = Bpe(path)
    relax()  # what the file's text and the building took
    return bpe


def load(path: str) -> Bpe:
    """The vocabulary of a file, which a worker keeps with the words it remembers until it goes on to other work."""
    bpe = _made(path)
    keep(_made.cache_clear)
    return bpe


# Spark ------------------------------------------------------------------


def _encoded(path: str, keep_ids: bool, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, SLICE):
            flat, at = bpe.encode_batch(batch.column("text"))
            own = [flat[a:b] for a, b in zip(at, at[1:])]
            out = [batch.column(0), pa.array(np.diff(at))]
            if keep_ids:
                out.append(pa.array([x.astype("<u4").tobytes() for x in own], pa.binary()))
            if digest:
                out.append(pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in own], pa.string()))
                out.append(pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in own], pa.string()))
            names = ["doc_id", "n_tokens"] + ["ids"] * keep_ids + ["ids_sha256", "decoded_sha256"] * digest
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, *, ids: bool = True, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens[, ids][, ids_sha256, decoded_sha256]) of every document.

    ``ids``: little-endian unsigned 32-bit integers in one binary value.
    ``digest``: hashes of the ids and of the text decoded from them.
    """
    schema = "doc_id long, n_tokens long" + ", ids binary" * ids
    schema += ", ids_sha256 string, decoded_sha256 string" * digest
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_encoded(path, ids, digest), schema)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from ``encode``'s ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4")).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the text decoded from them, as hashes."""
    return encode(table(spark, sf_dir, "documents"), ids=False, digest=True)
