from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from trolley.llm import chat


def _canonical(spark, lines, **more):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "id long, line string")
    return chat.canonical(rows.select("id", F.parse_json("line").alias("record")), **more)


def test_field_paths(spark):
    lines = [
        {"messages": [{"role": "u", "content": None}, {"role": "u", "x y": [1, {"b": 2}]}], "meta": {"a": {"b": 1.5}}},
        {"dialog": {"turns": [{"speaker": "a", "t`k": 1}]}, "n": 1},
        {"messages": []},
        [[{"a": 1}]],
        5,
        None,
    ]
    rows = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(lines)], "id long, line string")
    got = {r["id"]: sorted(r["p"]) for r in rows.select("id", chat.field_paths(F.parse_json("line")).alias("p")).collect()}
    assert got[0] == sorted(["messages", "messages[].content", "messages[].role", "messages[].x y", "meta", "meta.a", "meta.a.b"])
    assert got[1] == sorted(["dialog", "dialog.turns", "dialog.turns[].speaker", "dialog.turns[].t``k", "n"])
    assert got[2] == ["messages"] and got[3] == ["[][].a"] and got[4] == [] and got[5] == []


def test_layouts_become_canonical_turns(spark):
    lines = [
        {"prompt": "p", "completion": "c", "id": 7, "meta": {"x": [1]}},
        {"system": "s", "prompt": None, "completion": "c"},
        {"system_prompt": "s", "question": "q", "response": "r"},
        {"instruction": "i", "input": "more", "output": "o"},
        {"instruction": "i", "output": "o"},
        {"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": None, "name": "n"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "system", "value": "c"}]},
        {"dialog": {"turns": [{"speaker": "bot", "text": "a"}]}},
        {"messages": []},
        {"prompt": "p"},
        {"messages": [{"role": "user", "content": {"parts": ["a"]}}]},
        {"prompt": "p", "completion": "c", "messages": []},
        {},
        ["a"],
    ]
    got = _canonical(spark, [json.dumps(x) for x in lines]).orderBy("id").collect()
    turns = [r["turns"] and [tuple(t) for t in r["turns"]] for r in got]
    assert [r["layout"] for r in got[:9]] == [
        "prompt", "prompt", "question", "instruction", "instruction", "messages", "exchange", "dialog", "messages",
    ]
    assert turns[:9] == [
        [("user", "p"), ("assistant", "c")],
        [("system", "s"), ("user", ""), ("assistant", "c")],
        [("system", "s"), ("user", "q"), ("assistant", "r")],
        [("user", "i"), ("user", "more"), ("assistant", "o")],
        [("user", "i"), ("assistant", "o")],
        [("user", "a"), ("tool", "")],
        [("user", "a"), ("assistant", "b"), ("system", "c")],
        [("assistant", "a")],
        [],
    ]
    # Fields no layout has: the rows stay, without a layout.
    assert [r["layout"] for r in got[9:]] == [None] * 5 and turns[9:] == [None] * 5


def test_own_layouts_and_clashing_ones(spark):
    own = {"pair": chat.Layout(("q", "a"), (), (chat.Field("user", "q"), chat.Field("assistant", "a")))}
    got = _canonical(spark, ['{"q": 1, "a": true, "z": 2}'], layouts=own).first()
    assert got["layout"] == "pair" and [tuple(t) for t in got["turns"]] == [("user", "1"), ("assistant", "true")]
    with pytest.raises(ValueError, match="same fields"):
        chat.fingerprints(own | {"again": chat.Layout(("a",), ("q",), ())})


def _turns(seed: int) -> list[tuple[str, str]]:
    rnd = random.Random(seed)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "<\\/s>", "[\\\\/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", "é", "😀", "\n", " ", "$1"]
    text = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
    return [(rnd.choice(["user", "assistant", "system", "", text()]), text()) for _ in range(rnd.randint(0, 9))]


def test_round_trip_and_mask(spark):
    cases = {k: _turns(k) for k in range(120)} | {500: [("assistant", "long " * 20_000), ("user", "")], 501: [("assistant", "")] * 3000}
    kind = "id long, turns array<struct<role: string, text: string>>, Spans int, key int"
    rows = spark.createDataFrame([(k, [*v], 1, 2) for k, v in cases.items()], kind).repartition(3)
    out = chat.render(rows, "id")
    got = out.withColumn("read", chat.parse(F.col("formatted"), F.col("spans"))).collect()
    assert len(got) == len(cases)
    for r in got:
        turns = cases[r["id"]]
        assert [tuple(t) for t in r["read"]["turns"]] == turns
        assert r["read"]["masked"] == [t for role, t in turns if role == "assistant"]
        assert r["formatted"].count(chat.END) == len(turns)
        assert [s["turn"] for s in r["spans"]] == [k for k, (role, _) in enumerate(turns) if role == "assistant"]
        at = 0
        starts = []
        for piece in r["formatted"].split(chat.END)[:-1]:
            starts.append(at)
            at += len(piece) + len(chat.END)
        for s in r["spans"]:
            assert s["start"] == starts[s["turn"]] + s["at"]
            masked = r["formatted"][s["start"] : s["start"] + s["length"]]
            assert r["formatted"][s["start"] + s["length"] :].startswith(chat.END)
            assert masked.count("\\") >= turns[s["turn"]][1].count("\\")


def _plain(rows) -> dict:
    """By conversation: turns, their hash, masked characters, their hash."""
    held: dict = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), digest(said)
    return out


PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.op11_chat_format(spark, sf).collect()}
    assert got == _plain(rows + PLANTED)


def test_query_on_edge_rows(spark, tmp_path):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (1, None, "system", "first"),
        (2, 0, None, "no role"), (2, 1, "assistant", "[INST]" * 50_000), (None, 0, "user", "no id"), (None, 1, "assistant", "x"),
        (3, 0, "human", "a"), (3, 1, "gpt", "b"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "</s>"),
        (5, 0, "assistant", "alone"), (6, 5, "user", "b"), (6, 5, "user", "a"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.selectExpr("*", "1 as record", "'x' as Layout", "2 as TURNS").write.parquet(str(tmp_path / "conversations.parquet"))
    out = chat.op11_chat_format(spark, str(tmp_path))
    assert {r["conv_id"]: tuple(r)[1:5] for r in out.collect()} == _plain(rows + PLANTED)
    empty = tmp_path / "none"
    frame.limit(0).write.parquet(str(empty / "conversations.parquet"))
    assert [r["conv_id"] for r in chat.op11_chat_format(spark, str(empty)).collect()] == [-7]


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, '{"prompt": "a", "completion": "b"}')], "id long, line string")
    rows = rows.select("id", F.parse_json("line").alias("Record"), F.lit(1).alias("r"), F.lit(2).alias("paths"), F.lit(3).alias("row"))
    got = chat.canonical(rows, "Record")
    assert got.columns == ["id", "r", "paths", "row", "layout", "turns"]
    assert tuple(got.first())[:5] == (1, 1, 2, 3, "prompt")


def test_plan_is_native(spark, sf):
    plan = chat.op11_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExternalRDD", "MapElements"))
