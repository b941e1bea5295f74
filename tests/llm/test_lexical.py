"""Ranked lexical search against scores of every document, computed one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import lexical
from postlens.llm.kernels import ALNUM, Words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, score string, item long, n long"
ITEM = "item_id long, text string, rank long"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    split = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in split:
            m = 75 + 25 * n * n_docs // length if length else 75
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "THE", "naïve", "É", "日本", "x9", "of", "of", "of"]
    weights = [1 / (i + 1) for i in range(len(words))]
    prose = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(words, weights, k=n))
    docs = [(i, prose(rng.choice([1, 3, 20, 80]))) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(40)] + [(3, docs[3][1]), (3, "other of"), (None, docs[9][1]), (None, None)]
    docs += [(900, ""), (901, None), (902, "-- !"), (903, "of " * 5000), (-5, docs[7][1])]
    rng.shuffle(docs)
    items = [(i, prose(rng.choice([1, 4, 30]))) for i in range(20)]
    items += [(0, items[0][1]), (None, "w1 w1 w2"), (50, None), (51, ""), (52, "unknownterm"), (53, "w1 unknownterm W1 of")]
    return docs, items


@pytest.mark.parametrize(("seed", "k", "block", "batch"), [(1, 20, 200_000, 10_000), (2, 3, 40, 25)])
def test_search(spark, monkeypatch, seed, k, block, batch):
    """Also with items in many blocks and documents in many batches."""
    monkeypatch.setattr(lexical, "TERMS", block)
    docs, items = corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = lexical.search(spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOC).repartition(3),
                               spark.createDataFrame([(*i, 1) for i in items], ITEM), k)
        got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(docs, items, k)


def test_search_of_no_rows(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b", 2)], ITEM)
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None, "", 1, 1)], DOC), items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a", "", 1, 1)], DOC), spark.createDataFrame([], ITEM)).collect() == []


def test_accumulators_are_limited():
    """A term in every document creates no accumulator once two rare terms have k of them."""
    size, k = 1000, 5
    first = np.array([0, 8, 16, 16 + size])
    doc = np.concatenate((np.arange(8), np.arange(4, 12), np.arange(size)))
    part = np.concatenate((np.full(8, 900), np.full(8, 800), np.arange(size) % 50 + 1))
    bound = np.array([900, 800, 50])
    acc = lexical.accumulate([(0, 10), (1, 20), (2, 1)], first, doc, part, bound, size, k, 0)
    assert np.count_nonzero(acc) == 12
    exact = np.zeros(size, np.int64)
    for t, w in ((0, 10), (1, 20), (2, 1)):
        exact[doc[first[t]:first[t + 1]]] += w * part[first[t]:first[t + 1]]
    assert (acc[:12] == exact[:12]).all()
    assert np.count_nonzero(lexical.accumulate([(0, 10), (1, 20), (2, 1)], first, doc, part, bound, size, 13, 0)) == size


def test_terms_of_equal_hash_are_told_apart():
    names = ["alpha", "beta", "gamma", "日本"]
    known = lexical.Dictionary(names)
    known.hash[:] = known.hash[0]
    known.repeats = len(names)
    words = Words(pa.array(["Beta gamma delta beta", "日本 alphas"]), ALNUM, lower=True)
    words.hash[:] = known.hash[0]
    word, term = known.find(words)
    assert sorted(zip(word.tolist(), [names[t] for t in term], strict=True)) == [(0, "beta"), (1, "gamma"), (3, "beta"), (4, "日本")]
