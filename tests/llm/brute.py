"""Brute force for similar lines: the edit similarity of their words, without fingerprints or keys."""

from __future__ import annotations

from collections import Counter, defaultdict


def edits(a: list[str], b: list[str]) -> int:
    """Word insertions, deletions and replacements from one line to another."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def similar_pairs(lines: list[list[str]], similarity: float = 0.8) -> list[tuple[int, int]]:
    """All pairs of lines with this edit similarity; only those that share too few words are not compared."""
    holders = defaultdict(list)
    counts = [Counter(words) for words in lines]
    for i, c in enumerate(counts):
        for w, n in c.items():
            holders[w].append((i, n))
    out = []
    for i, c in enumerate(counts):
        shared = Counter()
        for w, n in c.items():
            for j, m in holders[w]:
                if j < i:
                    shared[j] += min(n, m)
        for j, n in shared.items():
            longer = max(len(lines[i]), len(lines[j]))
            if n >= longer * similarity - 1e-9 and edits(lines[i], lines[j]) <= longer * (1 - similarity) + 1e-9:
                out.append((j, i))
    return out


def groups(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """The smallest member of each one's connected group."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
