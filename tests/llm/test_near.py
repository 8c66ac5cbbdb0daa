from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import brute
from trolley.llm import line_dedup, near, near_dedup, shared


@pytest.mark.parametrize(("similarity", "size"), [(0.7, 60), (0.85, 250), (0.9, 60)])
def test_signatures_estimate_similarity(similarity, size):
    rng = np.random.default_rng(1)
    n, own = 800, round(size * (1 - similarity) / (1 + similarity))
    pool = [rng.integers(0, 1 << 32, size + own, dtype=np.uint64).astype(np.uint32) for _ in range(n)]
    at = np.arange(n) * size
    a, b = (near.minhash(np.concatenate(x), at, 32) for x in ([p[:size] for p in pool], [p[own:] for p in pool]))
    assert abs((a == b).mean() - (size - own) / (size + own)) < 0.01
    missed = 1 - (near.bands(a, 4) == near.bands(b, 4)).any(1).mean()
    assert abs(missed - (1 - similarity**4) ** 8) < 0.03


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    for compared in (32, 64, 280):
        fewest = near.fewest_matches(compared, 0.85, 1e-6)
        matches = rng.binomial(compared, 0.85, 100_000)
        assert (matches < fewest).mean() <= 2e-4
        assert fewest > 0.4 * compared


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(1, 2), (2, 3), (5, 4), (9, 9)], [(k, k + 1) for k in range(70)], [(0, k) for k in range(1, 90)]])
def test_components(spark, edges):
    rnd = random.Random(4)
    edges = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in edges] * 2
    got = {r["v"]: r["comp"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if r != x}


def _near_rows(seed: int, groups: int = 6, copies: int = 30) -> list[tuple[int, str]]:
    """Groups of texts at many similarities, short texts, equal texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([4, 12, 60, 150]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 8])):
                own[rnd.randrange(len(own))] = word()
            out.append(" ".join(own) if rnd.random() < 0.7 else " ".join(own).upper())
    out += ["", " ", "one", "one", "two words", "Two Words"]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("block", "group", "hot"), [(256, 4096, 32), (7, 4096, 2), (7, 5, 3), (256, 0, 32)])
def test_documents_against_brute_force(spark, monkeypatch, block, group, hot):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "SIGNATURE_BLOCK", block + 3)
    monkeypatch.setattr(near, "GROUP", group)
    monkeypatch.setattr(near, "HOT", hot)
    monkeypatch.setattr(near_dedup, "CHUNK", 500)
    rows = _near_rows(block + group)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed, found = near_dedup.linked(docs, 3, 85, 100)
    ids = {r["lid"]: r["row"]["doc_id"] for r in signed.collect()}
    comps: dict = {}
    for r in found.collect():
        comps.setdefault(r["comp"], []).append(ids[r["lid"]])
    got = {i: i for i, _ in rows} | {i: min(c) for c in comps.values() for i in c}
    assert got == brute.groups({i: brute.word_shingles(t, 3) for i, t in rows}, 85, 100)


def test_document_edge_rows(spark, docs):
    out = near_dedup.dedupe(docs)
    assert out.columns == docs.columns
    kept = sorted(r["doc_id"] or 0 for r in out.collect())
    assert kept == [0, 1, 2, 3, 4, 5, 7, 8]
    assert near_dedup.dedupe(docs.limit(0)).collect() == []


def test_documents_of_one_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u v"), (2, "p q r s t u v"), (None, "x y z x y"), (None, "x y z x y")]
    signed, found = near_dedup.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100)
    assert sorted(found.groupBy("comp").count().toPandas()["count"]) == [2, 2]


def test_document_query(spark, sf, texts):
    rows = {r["doc_id"]: r for r in near_dedup.op2_near_dedup(spark, sf).collect()}
    sets = {i: brute.word_shingles(t, 3) for i, t, _ in texts}
    for i, least in brute.groups(sets, 85, 100).items():
        assert tuple(rows[i]) == (i, len(sets[i]), least, i == least)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 12])
def test_rolled_hashes_tell_substrings_apart(size):
    rnd = random.Random(size)
    text = "".join(rnd.choice("ab") for _ in range(3000))
    hashes = line_dedup.rolled(np.frombuffer(text.encode("utf-32-le"), np.uint32), size)
    found: dict = {}
    for k, h in enumerate(hashes.tolist()):
        assert found.setdefault(text[k : k + size], h) == h
    assert len(hashes) == len(text) - size + 1 and len(set(found.values())) == len(found)


def test_line_query(spark, sf, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.op7_line_dedup(spark, sf).collect()}
    assert got == brute.line_dedup([(i, t) for i, t, _ in texts])


def test_lines(spark):
    long = "the river runs past the old stone mill and under the wooden bridge to the harbour"
    rows = [
        (3, f"{long}\nshort line\n\nshort line\n "),
        (1, f"A first line of its own here.\n  {long.upper()}  "),
        (2, f"{long} now\n{long}"),
        (2, f"{long} now\n{long}"),
        (None, long),
        (5, None),
        (6, ""),
        (7, "日本語のとても長い行です\nab\n\nab"),
        (8, "日本語のとても長い行です"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text as Text2", "*", "1 as pos", "2 as lid", "3 as n_lines")
    out = line_dedup.dedupe(docs)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["Text2"]): r["text"] for r in out.collect()}
    assert got[3, rows[0][1]] == "short line\n\n "
    assert got[1, rows[1][1]] == rows[1][1]
    assert got[2, rows[2][1]] == "" and got[None, long] == ""
    assert got[5, None] is None and got[6, ""] == ""
    assert got[7, rows[7][1]] == "日本語のとても長い行です\nab\n" and got[8, rows[8][1]] == ""
    assert out.count() == 9
    assert line_dedup.dedupe(docs.limit(0)).collect() == []


def test_very_long_texts_and_many_equal_lines(spark):
    """A text of 200,000 equal lines and a line of a million characters."""
    line = "".join(chr(97 + k * k % 23) for k in range(1_000_000))
    rows = [(1, "\n".join(["the very same line each time"] * 200_000)), (2, line), (3, f"x{line}y\nown")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "the very same line each time", 2: line, 3: "own"}


@pytest.mark.parametrize("hot", [2, 4, 32])
def test_rows_that_meet(spark, monkeypatch, hot):
    """Members, neighbours and copies of ``met`` against groups made in Python, over several batches and tasks."""
    monkeypatch.setattr(near, "HOT", hot)
    rng = np.random.default_rng(hot)
    keys = rng.integers(0, 25, 400)
    bands = np.where(rng.random((400, 3)) < 0.5, rng.integers(0, 3, (400, 3)), rng.integers(0, 1 << 40, (400, 3))) * 6 + 2 * np.arange(3)

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            for part in np.array_split(own, 3):
                seen: dict = {}
                first = np.array([seen.setdefault(int(keys[r]), r) for r in part], np.int64)
                first[first == part] = -1
                fresh = part[first < 0]
                yield near.meeting(np.stack([keys[part], keys[part] * 7], 1), part, first, fresh, bands[fresh])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = near.met(spark.range(400).repartition(3).sortWithinPartitions("id").mapInArrow(run, near.MEET)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    root = list(range(400))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for kind, a, b in got:
        if kind == near.COPY:
            assert keys[a] == keys[b] and a != b
            root[top(a)] = top(b)
    assert all((top(a) == top(b)) == (keys[a] == keys[b]) for a in range(400) for b in range(0, 400, 7))
    members: dict = {}
    for kind, a, b in got:
        if kind == near.MEMBER:
            members.setdefault(a, set()).add(b)
            assert a in bands[b] & ~1
    holders: dict = {}
    for kind, a, b in got:
        if kind == near.EDGE:
            assert set(bands[a] & ~1) & set(bands[b] & ~1)
    sent = {b for rows in members.values() for b in rows}
    for r in sent:
        for band in bands[r] & ~1:
            holders.setdefault(int(band), set()).add(r)
    # Whoever shares a band with a row that was sent by its bands stands in that band's list.
    for band, rows in holders.items():
        if len(rows) > 1 and band in members:
            assert rows <= members[band] | (rows - sent)


def test_a_family_below_the_threshold_costs_no_pairs_of_sets(spark, monkeypatch):
    """Texts of one template, similar at 0.6: signatures alone part them, in blocks that copy a row a few times."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(6))
    template = [word() for _ in range(120)]
    rows = [(k, " ".join(template[:90] + [word() for _ in range(30)])) for k in range(1500)]
    rows += [(2000 + k, rows[k][1]) for k in range(3)] + [(3000, rows[7][1] + " more")]
    monkeypatch.setattr(near, "GROUP", 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    signed, found = near_dedup.linked(docs, 1, 85, 100)
    ids = {r["lid"]: r["row"]["doc_id"] for r in signed.collect()}
    comps: dict = {}
    for r in found.collect():
        comps.setdefault(r["comp"], set()).add(ids[r["lid"]])
    assert sorted(map(sorted, comps.values())) == [[0, 2000], [1, 2001], [2, 2002], [7, 3000]]


def test_a_wide_group_is_taken_apart_by_its_mixed_bands_only(spark, monkeypatch):
    """One large part of near copies and a few rows apart: bands of the part alone are not looked up."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(6))
    template = [word() for _ in range(120)]
    rows = [(k, " ".join(template[:90] + [word() for _ in range(30)])) for k in range(150)]
    rows += [(1000 + k, f"{rows[0][1]} {word()}") for k in range(150)]
    written: dict[str, int] = {}
    settle = near.settle

    def counted(df, name, *more):
        done = settle(df, name, *more)
        written[name] = done.count()
        if name == "met":
            written["bands"] = done.where("kind = 0").select("a").distinct().count()
        return done

    monkeypatch.setattr(near, "GROUP", 100)
    monkeypatch.setattr(near, "settle", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed, found = near_dedup.linked(docs, 1, 85, 100)
    ids = {r["lid"]: r["row"]["doc_id"] for r in signed.collect()}
    comps: dict = {}
    for r in found.collect():
        comps.setdefault(r["comp"], set()).add(ids[r["lid"]])
    assert sorted(map(sorted, comps.values())) == [[0, *range(1000, 1150)]]
    assert 0 < written["mixed"] < written["bands"] and written["wide"] >= 300


def test_a_task_gives_memory_back_when_its_values_are_gone(monkeypatch):
    said = []
    monkeypatch.setattr(shared, "relax", lambda: said.append("relaxed"))

    def run(batches):
        yield from batches
        said.append("over")

    assert list(shared.relaxed(run)(iter([1, 2]))) == [1, 2] and said == ["over", "relaxed"]
