"""Keyword tables: the matcher against plain substring tests, and against the list form."""

import random

import pyarrow as pa
import pytest

from postlens.operators import keywords
from postlens.operators.keywords import KeywordMatcher, posts_with_keyword_table, tag_keyword_table
from postlens.operators.search import tag_keywords

POST = "id string, title string, selftext string, keyword string, _hits int"


def brute(needles, columns):
    return [[k for k, n in enumerate(needles) if n and any(n in (c[i] or "") for c in columns)] for i in range(len(columns[0]))]


@pytest.mark.parametrize("piece", [1 << 18, 17])
def test_matcher(monkeypatch, piece):
    """Few letters, so that keywords overlap, nest and share their ends; texts cut into small pieces too."""
    monkeypatch.setattr(keywords, "PIECE", piece)
    rng = random.Random(piece)
    word = lambda n: "".join(rng.choices("abÄ日 ", k=n))
    texts = [word(rng.choice([0, 1, 5, 40, 200])) for _ in range(60)] + [None, "", "a", "abab" * 300]
    needles = [word(n) for n in range(1, 9) for _ in range(30)] + ["a" * n for n in (1, 2, 3, 15, 16, 17, 40, 200)]
    needles += [t for t in texts if t] + [t + "b" for t in texts if t] + ["", "ab", "ab", "commonprefix1", "commonprefix2"]
    titles = [rng.choice(texts) for _ in texts]
    found = KeywordMatcher(needles).hits([pa.array(titles, pa.string()), pa.array(texts, pa.string())])
    assert found.to_pylist() == brute(needles, [titles, texts])
    assert KeywordMatcher([]).hits([pa.array(texts, pa.string())]).to_pylist() == [[]] * len(texts)
    assert KeywordMatcher(["a"]).hits([pa.array([], pa.string())]).to_pylist() == []


def test_matcher_of_sliced_arrays():
    texts = pa.array(["xx", "has key", None, "key", "no"])
    assert KeywordMatcher(["key", "xx"]).hits([texts.slice(1, 3)]).to_pylist() == [[0], [], [0]]


def test_keywords_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(keywords, "_pair", lambda first, last, length: (first * 0 + length.astype(first.dtype)))
    found = KeywordMatcher(["abc", "xbc", "abx", "a"]).hits([pa.array(["-abx abc", "xbc", "bca"])])
    assert found.to_pylist() == brute(["abc", "xbc", "abx", "a"], [["-abx abc", "xbc", "bca"]])


def rows(spark):
    rng = random.Random(5)
    vocabulary = ["The", "iDiot", "naïve", "ÉCOLE", "İstanbul", "straße", "a-b", "100%", "日本", "ſharp", "Kelvin"]
    text = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))
    data = [(str(i), rng.choice([text(), None, ""]), rng.choice([text(), None]), "old", 7) for i in range(80)]
    data += [data[0], (None, None, "the idiot", None, None)]
    return spark.createDataFrame(data, POST).repartition(3), vocabulary


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_table_equals_list(spark, monkeypatch, block):
    """The same rows as one test per keyword; also when the table takes many passes."""
    monkeypatch.setattr(keywords, "BLOCK_BYTES", block)
    posts, vocabulary = rows(spark)
    given = vocabulary + ["the", " The ", "\tidiot\n", "", "  ", "i̇stanbul", "STRASSE", "École ", "nothing", "e", "the", "k"]
    table = spark.createDataFrame([(g, "x") for g in [*given, None]], "keyword string, id string")
    got = tag_keyword_table(posts, table)
    want = tag_keywords(posts, given).select(*got.columns)
    assert got.columns == ["id", "title", "selftext", "_hits", "keyword"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("keyword = 'the'").count() > 0


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_arrays_hold_the_same_keywords(spark, monkeypatch, block):
    monkeypatch.setattr(keywords, "BLOCK_BYTES", block)
    posts, vocabulary = rows(spark)
    table = spark.createDataFrame([(g,) for g in [*vocabulary, "the", "the", " ", None]], "keyword string")
    got = posts_with_keyword_table(posts, table, column="_found")
    want = tag_keywords(posts, [*vocabulary, "the", "the"])
    count = lambda df: sorted(map(str, df.groupBy("id", "title", "selftext", "k").count().collect()))
    assert count(got.selectExpr("id", "title", "selftext", "explode(_found) AS k")) == count(
        want.selectExpr("id", "title", "selftext", "keyword AS k"))
    assert got.count() == posts.count() - posts_without(posts, want)
    assert posts_with_keyword_table(posts, table.where("false")).collect() == []


def posts_without(posts, tagged):
    """Rows of posts that no keyword tags."""
    text = ["id", "title", "selftext"]
    found = {tuple(r) for r in tagged.select(*text).collect()}
    return sum(tuple(r) not in found for r in posts.select(*text).collect())


def test_empty_tables(spark):
    posts, _ = rows(spark)
    empty = spark.createDataFrame([], "word string")
    assert tag_keyword_table(posts, empty, "word").collect() == []
    assert tag_keyword_table(posts, spark.createDataFrame([(" ",), (None,)], "word string"), "word").collect() == []
    one = spark.createDataFrame([("the",)], "word string")
    assert tag_keyword_table(posts.where("false"), one, "word", "kw").columns == [*posts.columns, "kw"]


def test_stream(spark, tmp_path):
    """Row-local, so the same on a stream."""
    posts, vocabulary = rows(spark)
    posts.write.parquet(str(tmp_path / "posts"))
    table = spark.createDataFrame([(v,) for v in vocabulary], "keyword string")
    stream = tag_keyword_table(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "posts")), table)
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, tag_keyword_table(posts, table).collect()))
