"""Spelling variants against a brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import spelling

DOC = "doc_id long, text string, word string, n long, form string"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(rows):
    n = brute_counts(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def corpus(seed):
    rng = random.Random(seed)
    base = ["running", "spelling", "aaaaaaaa", "naïveté", "variant", "grouping", "Ünterwegs", "x" * 70, "ab" * 200]
    rows = []
    for i in range(60):
        words = []
        for _ in range(80):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abxÿ") + w[k:], w[:k] + rng.choice("abÀ") + w[k + 1:]])
            words.append(w if rng.random() < 0.9 else w.upper())
        rows.append((rng.choice([i, i, 7, None]), rng.choice([" ", "\n", "-1 "]).join(words)))
    chain = ["chainword"] * 2000 + ["chainwor"] * 200 + ["chainwo"] * 20 + ["haichwo"] * 2
    rows += [(1000 + i, " ".join(chain[i::9])) for i in range(9)]
    rows += [(None, None), (3, ""), (4, "short one"), (5, rows[0][1]), (5, rows[0][1]), (6, "日本 " + "ß" * 9 + " " + "ß" * 9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "w", 1, None) for i, t in rows], DOC).repartition(5)
    got = result(spelling.variants(df))
    assert got == brute(rows)
    assert max(len(r[0]) for r in got) >= 400 and any(r[3] for r in got) and any(r[3] and r[3] != r[5] for r in got)


def test_variants_of_no_rows(spark):
    assert result(spelling.variants(spark.createDataFrame([], DOC))) == []
    assert result(spelling.variants(spark.createDataFrame([(1, None, None, None, None)], DOC))) == []


def test_large_group_and_small_batches(monkeypatch):
    """Words of one window make block pairs; batches that cut groups lose nothing."""
    monkeypatch.setattr(spelling, "BATCH", 50)
    monkeypatch.setattr(spelling, "TILE", 16)
    letters = "abcdefghijklmnop"
    words = [f"com{x}{y}mon" for x in letters for y in letters] + [f"com{x}mon" for x in letters]
    n = {w: 2 + i % 50 for i, w in enumerate(words)}
    rows = pa.RecordBatch.from_arrays([pa.array(words), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
    keyed = pa.Table.from_batches(spelling.keyed([rows])).sort_by("key")
    total, best = Counter(), {}
    for part in spelling.compare(keyed.to_batches(max_chunksize=37)):
        for w, k, c, f in zip(*(x.to_pylist() for x in part.columns), strict=True):
            total[w] += k
            best[w] = min(best.get(w, (0, "")), (-c, f))
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        assert total[w] == len(near)
        assert best[w] == min((-n[x], x) for x in near)


def test_keys_are_linear_in_the_word():
    for size in (7, 63, 64, 65, 500, 20_000):
        rows = pa.RecordBatch.from_arrays([pa.array(["q" * size]), pa.array([2], pa.int64())], names=["word", "n"])
        assert sum(b.num_rows for b in spelling.keyed([rows])) <= max(size + 2, 66)
    assert np.all([spelling.window(m) == 2 for m in range(7, 65)])
