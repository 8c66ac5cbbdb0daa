"""Chat records of many layouts as canonical turns, and turns as training text with a loss mask.

A record is a VARIANT (``parse_json`` of a line, or ``to_variant_object`` of
columns). Its schema is listed as nested field paths, and the hash of the paths
under fields that some layout names, its fingerprint, selects the declarative
mapping (``Layout``) that turns it into (role, text) turns. Fields that no
layout names are taken for notes and ignored; a field more or less inside a
named one gives another fingerprint. A record whose fingerprint no layout has
keeps its row, with a null layout and null turns.

``render`` writes a turn as

    [INST]role[/INST]text</s>

Control strings inside roles and texts (also ``<s>``) get one backslash more
after their first character, so none stands there bare, and reading takes one
off: the way there and back is exact for every text. The loss mask lists the
assistant texts as spans in code points, from the start of the turn and of the
whole. ``parse`` reads turns and masked texts back from text and spans.

Everything is DataFrame and SQL functions. A formatted conversation is one
value, so the turns of one conversation meet in one task (as one sum over a
window and one list); work and memory are linear in its length.

Defined results: a null text is empty, a null role the empty string; turns of
one number are ordered by role, then text, null numbers first; repeated rows
are turns of their own; a null conversation id is a conversation; without turns
the text is empty; an empty table gives an empty result; other columns stay in
``canonical`` and are not read elsewhere.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trolley.llm.shared import free_name, table

START, MIDDLE, END = "[INST]", "[/INST]", "</s>"
#: A control string in a text: its first character, backslashes, the rest.
_BARE = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"


class Field(NamedTuple):
    """A turn that is one field of the record, if the record has it."""

    role: str
    path: str


class Messages(NamedTuple):
    """Turns that are the elements of an array, with the names that stand for canonical roles."""

    path: str
    role: str
    text: str
    names: dict[str, str] = {}


class Layout(NamedTuple):
    """Paths that a record must and may have, and where its turns are."""

    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[Field, ...] | Messages


LAYOUTS: dict[str, Layout] = {
    "prompt": Layout(
        ("prompt", "completion"), ("system",), (Field("system", "system"), Field("user", "prompt"), Field("assistant", "completion"))
    ),
    "question": Layout(
        ("question", "response"), ("system_prompt",),
        (Field("system", "system_prompt"), Field("user", "question"), Field("assistant", "response")),
    ),
    "instruction": Layout(
        ("instruction", "output"), ("system", "input"),
        (Field("system", "system"), Field("user", "instruction"), Field("user", "input"), Field("assistant", "output")),
    ),
    "messages": Layout(
        ("messages",), ("messages[].role", "messages[].content", "messages[].name"), Messages("messages", "role", "content")
    ),
    "exchange": Layout(
        ("conversations",), ("conversations[].from", "conversations[].value"),
        Messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
    "dialog": Layout(
        ("dialog", "dialog.turns"), ("dialog.turns[].speaker", "dialog.turns[].text"),
        Messages("dialog.turns", "speaker", "text", {"human": "user", "bot": "assistant"}),
    ),
}


def fingerprints(layouts: dict[str, Layout]) -> dict[str, str]:
    """Name of the layout for the hash of each set of paths that one allows."""
    out: dict[str, str] = {}
    for name, layout in layouts.items():
        for n in range(len(layout.may) + 1):
            for more in combinations(layout.may, n):
                key = hashlib.sha256("\n".join(sorted([*layout.needs, *more])).encode()).hexdigest()
                if out.setdefault(key, name) != name:
                    raise ValueError(f"layouts {out[key]} and {name} allow the same fields: {[*layout.needs, *more]}")
    return out


def field_paths(record: Column) -> Column:
    """The nested field paths of a VARIANT, such as ``messages[].role``, each once.

    Folds the record's schema text: a name goes on the path of the object it
    stands in, ``[]`` stands for an array's elements.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>"), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("open"), F.lit("").alias("at"), none.alias("paths"))

    def step(state: Column, token: Column) -> Column:
        opened, at, paths = state["open"], state["at"], state["paths"]
        name = F.concat(F.element_at(opened, -1), F.regexp_replace(token, "^`|`?: $", ""))
        inner = F.when(at == "", "").otherwise(F.concat(at, F.lit(".")))

        def to(opened: Column, at: Column, paths: Column) -> Column:
            return F.struct(opened.alias("open"), at.alias("at"), paths.alias("paths"))

        return (
            F.when(token == "OBJECT<", to(F.concat(opened, F.array(inner)), at, paths))
            .when(token == "ARRAY<", to(F.concat(opened, F.array(F.lit(""))), F.concat(at, F.lit("[]")), paths))
            .when(token == ">", to(F.slice(opened, 1, F.size(opened) - 1), at, paths))
            .otherwise(to(opened, name, F.concat(paths, F.array(name))))
        )

    return F.array_distinct(F.aggregate(tokens, start, step)["paths"])


def _turns(record: Column, paths: Column, layout: Layout) -> Column:
    """array<struct<role, text>> of a record of this layout."""
    if isinstance(layout.turns, Messages):
        path, role, text, names = layout.turns
        found = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`: string, `{text}`: string>>")

        def named(x: Column) -> Column:
            out = x[role]
            for name, canonical in names.items():
                out = F.when(x[role] == name, canonical).otherwise(out)
            return F.coalesce(out, F.lit(""))

        return F.transform(
            F.coalesce(found, F.array().cast(f"array<struct<`{role}`: string, `{text}`: string>>")),
            lambda x: F.struct(named(x).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")),
        )
    fields = [
        F.struct(
            F.lit(f.role).alias("role"),
            F.coalesce(F.try_variant_get(record, f"$.{f.path}", "string"), F.lit("")).alias("text"),
            F.array_contains(paths, f.path).alias("there"),
        )
        for f in layout.turns
    ]
    there = F.filter(F.array(*fields), lambda x: x["there"])
    return F.transform(there, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))


def canonical(records: DataFrame, record: str = "record", layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout`` and ``turns`` (array<struct<role, text>>) instead of the VARIANT column ``record``."""
    tops = {p.replace("[]", "").split(".")[0] for layout in layouts.values() for p in layout.needs}
    tops |= {p.replace("[]", "").split(".")[0] for layout in layouts.values() for p in layout.may}
    top = F.array(*[F.lit(t) for t in sorted(tops)])
    others = [c for c in records.columns if c.lower() not in (record.lower(), "layout", "turns")]
    r, paths, name = (free_name(records, x) for x in ("record", "paths", "layout"))
    rows = records.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{record}`").alias(r))
    named = F.filter(field_paths(F.col(r)), lambda p: F.array_contains(top, F.regexp_replace(p, r"(\[\])?(\..*)?$", "")))
    rows = rows.withColumn(paths, named)
    known = F.create_map(*[F.lit(x) for pair in fingerprints(layouts).items() for x in pair])
    fingerprint = F.sha2(F.array_join(F.sort_array(paths), "\n").cast("binary"), 256)
    rows = rows.withColumn(name, F.try_element_at(known, fingerprint))
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for own, layout in layouts.items():
        turns = F.when(F.col(name) == own, _turns(F.col(r), F.col(paths), layout)).otherwise(turns)
    return rows.select(*[F.col(f"`{c}`") for c in others], F.col(name).alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BARE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def render(canon: DataFrame, key: str) -> DataFrame:
    """(key, formatted, spans) of ``canonical``'s rows, one for each value of ``key``.

    spans: (turn, at, start, length) of each assistant text: from 0, the turn,
    the code points before it in the turn and in the whole, and its code points.
    """
    rows = canon.select(F.col(f"`{key}`").alias("key"), F.posexplode_outer("turns").alias("turn", "t"))
    rows = rows.select(
        "key",
        "turn",
        (F.col("t.role") == "assistant").alias("masked"),
        F.concat(F.lit(START), escape(F.col("t.role")), F.lit(MIDDLE)).alias("head"),
        escape(F.col("t.text")).alias("text"),
    )
    size = F.length("head") + F.length("text") + len(END)
    before = Window.partitionBy("key").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)))
    at = F.length("head")
    span = F.struct("turn", at.alias("at"), (F.col("before") + at).alias("start"), F.length("text").alias("length"))
    piece = F.struct("turn", F.concat("head", "text", F.lit(END)).alias("piece"))
    out = rows.groupBy("key").agg(
        F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), piece))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("masked"), span))).alias("spans"),
    )
    return out.select(
        F.col("key").alias(key), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "spans"
    )


def parse(formatted: Column, spans: Column) -> Column:
    """struct<turns: array<struct<role, text>>, masked: array<string>>, read from the text and its mask alone."""
    ended = F.split(formatted, END, -1)
    pieces = F.slice(ended, 1, F.size(ended) - 1)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, MIDDLE)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"),
            unescape(F.substring(piece, cut + len(MIDDLE), F.length(piece))).alias("text"),
        )

    masked = F.transform(spans, lambda s: unescape(F.substring(F.get(pieces, s["turn"]), s["at"] + 1, s["length"])))
    return F.struct(F.transform(pieces, turn).alias("turns"), masked.alias("masked"))


def records_of_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, record): a table of turns (conv_id, turn, role, text) as one record for each conversation.

    Records get the layouts that corpora of such conversations come in: prompt
    and completion for one exchange, an instruction where a system turn comes
    first, exchanges of human and gpt for longer ones, messages for the rest.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    held = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    roles = F.transform("m", lambda x: x["role"])

    def are(*names: str) -> Column:
        return roles == F.array(*[F.lit(n) for n in names])

    def text_of(k: int) -> Column:
        return F.get(F.col("m"), F.lit(k))["text"]

    def record(**fields: Column) -> Column:
        return F.to_variant_object(F.struct(*[c.alias(name) for name, c in fields.items()]))

    def other(x: Column) -> Column:
        return F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])

    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    exchange = F.transform("m", lambda x: F.struct(other(x).alias("from"), x["text"].alias("value")))
    made = (
        F.when(are("user", "assistant"), record(prompt=text_of(0), completion=text_of(1)))
        .when(are("system", "user", "assistant"), record(system=text_of(0), instruction=text_of(1), output=text_of(2)))
        .when(F.forall(roles, lambda r: r.isin("user", "assistant")), record(conversations=exchange))
        .otherwise(record(messages=messages))
    )
    return held.select("conv_id", made.alias("record"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, and what is read back."""
    said = F.lit("</s>[INST] ok [/INST]")
    turns = F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])
    planted = spark.range(1).select(F.explode(turns).alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), "t.*", said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = render(canonical(records_of_turns(rows)), "conv_id")
    out = out.withColumn("read", parse(F.col("formatted"), F.col("spans")))
    turn_text = F.transform("read.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("read.masked", "")
    return out.select(
        "conv_id",
        F.size("read.turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn_text, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
