from __future__ import annotations

import random

from tests.llm import brute
from trolley.llm import line_dedup


def _edited(seed: int) -> list[tuple[str, str, int]]:
    """Lines of 40 to 160 characters, the same with one character or word changed, and how many characters changed."""
    rnd, out = random.Random(seed), []
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(6))
    for n in range(6, 24):
        words = [word() for _ in range(n)]
        line, at = " ".join(words), n // 2
        for new in (words[at][:2] + "7" + words[at][3:], "zyxzyx"):
            copy = " ".join([*words[:at], new, *words[at + 1 :]])
            out.append((line, copy, 1 if "7" in copy else 6))
    return out


def test_edited_lines_are_linked(spark):
    pairs = _edited(3)
    rows = list(enumerate(sorted({x for p in pairs for x in p[:2]})))
    out = line_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    stay = {r["doc_id"] for r in out.where("text <> ''").collect()}
    sets = {k: frozenset(x[i : i + 5] for i in range(len(x) - 4)) for k, x in rows}
    group = brute.groups(sets, 85, 100)
    assert stay == set(group.values())
    ids = {x: k for k, x in rows}
    assert {40 < len(a) < 165 for a, _, _ in pairs} == {True}
    for line, copy, changed in pairs:
        if len(line) >= (66 if changed == 1 else 128):
            assert group[ids[line]] == group[ids[copy]]
