"""Search by relevance against scores of every post, computed one by one."""

import math
import random
import re
from collections import Counter

import pytest

from postlens.operators.relevance import RelevanceIndex, build_index

POST = "id string, forum string, title string, selftext string, term string, block long, score long"
QUERIES = ["w1", "W3 w3 w40", "w0 w1 w2 w7", "naïve ÉCOLE", "unknown", "", "w59 unknown"]


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(posts, queries, k, forum):
    split = [(p[0], p[1], Counter(words(p[2]) + words(p[3]))) for p in posts]
    n, total = sum(bool(c) for *_, c in split), sum(sum(c.values()) for *_, c in split)
    df = Counter(t for *_, c in split for t in c)
    weight = {t: math.floor(1000 * math.log(1 + (n - f + 0.5) / (f + 0.5))) for t, f in df.items()}
    out = []
    for q in queries:
        found = []
        for i, f, c in split:
            dl = sum(c.values())
            score = sum(weight[t] * (2_200_000_000 * c[t] // (1000 * c[t] + 300 + 900 * n * dl // total)) for t in words(q) if t in c)
            if score > 0 and (forum is None or f == forum):
                found.append((-score, i is None, i or "", i))
        out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["naïve", "ÉCOLE", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=n))
    posts = [(f"p{i}", f"f{i % 3}", text(rng.randint(0, 5)), text(rng.choice([1, 5, 30, 200]))) for i in range(400)]
    posts += [(f"c{i}", "f1", posts[5][2], posts[5][3]) for i in range(60)]
    posts += [posts[0], posts[0], (None, "f1", "w1", "w2"), ("n1", None, None, "w1"), ("n2", "f0", None, None),
              ("n3", "f0", "", "..."), ("long", "f2", "w3", "w3 " * 4000)]
    rng.shuffle(posts)
    return posts


@pytest.fixture(scope="module")
def posts():
    return corpus()


@pytest.mark.parametrize(("per_block", "segment", "buckets"), [(32, 1 << 20, 1), (3, 500, 4), (1, 1, 2)])
def test_search(spark, tmp_path, posts, per_block, segment, buckets):
    df = spark.createDataFrame([(*p, "x", 1, 2) for p in posts], POST).repartition(3)
    index = build_index(df, str(tmp_path / "index"), buckets, per_block, segment)
    for k, forum in ((5, None), (5, "f1"), (500, None), (3, "none")):
        got = sorted(((r.keyword, r["rank"], r.id, r.relevance) for r in index.search(QUERIES, k, forum).collect()), key=str)
        assert got == brute(posts, QUERIES, k, forum)


def test_index_is_read_again_and_blocks_are_skipped(spark, tmp_path, posts):
    df = spark.createDataFrame([(*p, "x", 1, 2) for p in posts], POST)
    build_index(df, str(tmp_path / "index"), 4, per_block=2)
    index = RelevanceIndex.read(spark, str(tmp_path / "index"))
    got = sorted(((r.keyword, r["rank"], r.id, r.relevance) for r in index.search(["w1", "w9"], 3).collect()), key=str)
    assert got == brute(posts, ["w1", "w9"], 3, None)
    for r in index.blocks_read(["w1", "w9"], 3).collect():
        assert 0 < r.blocks_read <= r.blocks / 2


def test_a_search_reads_its_buckets_and_terms(spark, tmp_path, posts):
    df = spark.createDataFrame([(*p, "x", 1, 2) for p in posts], POST)
    index = build_index(df, str(tmp_path / "index"), 8)
    plan = index._of_terms(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(term,w1)" in plan


def test_no_posts(spark, tmp_path):
    index = build_index(spark.createDataFrame([], POST), str(tmp_path / "index"))
    assert index.search(["w1"]).collect() == [] and index.blocks_read(["w1"]).collect() == []
    one = build_index(spark.createDataFrame([("a", "f", None, None, "", 1, 1)], POST), str(tmp_path / "one"))
    assert one.search(["w1"]).collect() == []
