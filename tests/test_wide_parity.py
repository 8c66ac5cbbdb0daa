"""Wide-CSV parity with pandas: the same file read by pandas, folded and
cleaned in plain Python, against the Spark reader, fold and clean."""

from __future__ import annotations

import random

import pandas as pd

from trolley.fixed import NA_WORDS
from trolley.operators.baskets import clean, fold_wide
from trolley.sources.wide_csv import read_wide_csv

WORDS = ["Milk", "milk", " milk", "Bread ", "EGGS", "eggs", "tea\t", "Tea", " ", "none", "ham"]


def python_fold_clean(path: str, width: int):
    df = pd.read_csv(path)
    out = []
    for _, row in df.iterrows():
        n = int(row["Item(s)"])
        picked = [row[f"Item {i}"] for i in range(1, n + 1)]
        picked = [x for x in picked if pd.notna(x)]
        if not picked:
            continue
        cleaned = set(x.strip(" ").lower() for x in picked)
        if len(cleaned) > 1:
            out.append(tuple(sorted(cleaned)))
    return sorted(out)


def test_random_wide_rows_match_pandas(spark, tmp_path):
    rnd = random.Random(17)
    width = 6
    lines = ["Item(s)," + ",".join(f"Item {i}" for i in range(1, width + 1))]
    for _ in range(400):
        n = rnd.randint(-1, width)
        count = rnd.choice([str(n), f"{n}.0"]) if n >= 0 else str(n)
        cells = []
        for _ in range(width):
            r = rnd.random()
            if r < 0.2:
                cells.append("")
            elif r < 0.3:
                cells.append(rnd.choice([w for w in NA_WORDS if w and "," not in w]))
            else:
                cells.append(rnd.choice(WORDS))
        lines.append(count + "," + ",".join(cells))
    path = tmp_path / "wide.csv"
    path.write_text("\n".join(lines) + "\n")

    expected = python_fold_clean(str(path), width)
    folded = fold_wide(read_wide_csv(spark, str(path)))
    got = sorted(tuple(r["items"]) for r in clean(folded).collect())
    assert got == expected
    assert len(expected) > 50
