"""Plain versions of the operators that link similar texts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def groups(sets: dict, num: int, den: int) -> dict:
    """Smallest key reached from each key over sets with den * |intersection| >= num * |union|."""
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    by, holders = defaultdict(list), defaultdict(list)
    for k, s in sets.items():
        if s:
            by[s].append(k)
    for s, keys in by.items():
        for k in keys[1:]:
            root[top(k)] = top(keys[0])
        common = Counter(o for x in s for o in holders[x])
        for other, n in common.items():
            if den * n >= num * (len(s) + len(sets[other]) - n):
                root[top(other)] = top(keys[0])
        for x in s:
            holders[x].append(keys[0])
    members = defaultdict(list)
    for k in sets:
        members[top(k)].append(k)
    return {k: min(members[top(k)]) for k in sets}


def word_shingles(text, size: int) -> frozenset:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def line_dedup(rows, size: int = 5) -> dict:
    """(lines, lines that go, sha256 of what stays) by doc_id."""
    lines = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            p = " ".join(line.lower().split())
            if p:
                lines[d, k] = p
    sets = {p: frozenset(p[i : i + size] for i in range(max(1, len(p) - size + 1))) for p in set(lines.values())}
    group = groups(sets, 85, 100)
    first: dict = {}
    for key in sorted(lines):
        first.setdefault(group[lines[key]], key)
    out = {}
    for d, t in rows:
        own = (t or "").split("\n")
        stay = [x for k, x in enumerate(own) if (d, k) not in lines or first[group[lines[d, k]]] == (d, k)]
        text = None if t is None else "\n".join(stay)
        out[d] = len(own), len(own) - len(stay), None if t is None else hashlib.sha256(text.encode()).hexdigest()
    return out
