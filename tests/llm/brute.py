"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(rows: list[tuple[int, str | None]]) -> set[tuple]:
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(rows)
    links = [[] for _ in rows]
    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        c = Counter(j for g in s for j in holders[g] if j > i)
        for j, both in c.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links[i].append(j)
                links[j].append(i)
    label = list(range(n))
    out = set()
    for i in range(n):
        if label[i] == i:
            seen, todo = {i}, [i]
            while todo:
                for y in links[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            least = min(rows[x][0] for x in seen)
            for x in seen:
                label[x] = i
                out.add((x, rows[x][0], len(sets[x]), len(links[x]), least))
    return {x[1:] for x in out}


def substring(rows: list[tuple[int, str | None]], k: int = 13) -> list[tuple]:
    import hashlib

    first: dict[tuple, int] = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < i:
                gone.update(range(s, s + k))
        kept = " ".join(x for s, x in enumerate(w) if s not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def rules(t: str | None) -> tuple:
    t = t or ""
    w = WORD.findall(t)
    seen, same = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            same += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {x for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for x in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), same, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)
