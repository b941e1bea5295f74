"""S1 and L1 by relevance: an inverted index of posts, kept as a table, and BM25 search with block-max pruning.

The index (``build_index``) is a Parquet folder with one row per (term,
segment), a segment being some thousand posts of one task. Its posts are in
order of length, and each run of ``BLOCK_POSTS`` is a block: lengths within a
block hardly differ. A row lists the posts that hold the term and its counts there (``posts``), and apart from them, per
block, the two numbers that bound their scores, the largest count and the smallest length (``bounds``). Rows lie in term buckets, sorted
by term: a search reads the buckets of its terms alone, and first only the bounds.
Rows with the empty term name the posts of each block, with their lengths.

A search (``RelevanceIndex.search``) adds up the bounds of its terms per
block, scores the most promising blocks of each query exactly, and with the
k-th score found there it scores just those other blocks whose bound reaches it:
the result is that of scoring every post. Ids break ties, so a block whose
bound equals the k-th score is read too.

Scores are 64-bit integers (BM25 with k1 = 1.2 and b = 0.75, a term's weight in
thousandths, its frequency part in millionths), so they do not depend on the order of additions.

A null or empty post has no terms and is never found; repeated rows are posts
of their own; a null id ranks after all others of its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.functions.literals import sql_string
from postlens.functions.text import TOKEN_DELIMITER, tokens
from postlens.operators.search import DEFAULT_LIMIT, top_k
from postlens.session import checkpoint_root, estimated_bytes, max_partition_bytes

BLOCK_POSTS = 32
SEGMENT_BYTES = 4 << 20  # text that a task sorts at once
FORUM_SEEDS = 4  # times k blocks are tried first when posts of other forums in them do not count
MAX_BUCKETS = 1024

INDEX = ("term string, segment long, block int, n int, bounds array<int>, posts array<int>, "
         "ids array<string>, forums array<string>, lengths array<int>")
_POSTS = ""  # the term of the rows that name a block's posts


def _segment(ids: pa.Array, forums: pa.Array, words: pa.Array, segment: int, per_block: int) -> pa.RecordBatch:
    """Index rows of one batch of posts."""
    rows = len(ids)
    size = np.diff(words.offsets.to_numpy()).astype(np.int64)
    order = np.argsort(size, kind="stable")
    place = np.empty(rows, np.int64)
    place[order] = np.arange(rows)  # posts in order of length
    length = size[order]
    encoded = words.flatten().dictionary_encode()
    cell, tf = np.unique(encoded.indices.to_numpy().astype(np.int64) * rows + place[np.repeat(np.arange(rows), size)],
                         return_counts=True)
    code, post = cell // max(1, rows), cell % max(1, rows)
    dl, block = length[post], post // per_block
    term = np.flatnonzero(np.diff(code, prepend=-1))  # first cell of each term, and of each of its blocks
    part = np.flatnonzero(np.diff(code * rows + block, prepend=-1))
    by_block = [block[part], np.maximum.reduceat(tf, part), np.minimum.reduceat(dl, part)] if len(part) else [part] * 3

    def lists(first: np.ndarray, fields: list[np.ndarray], total: int) -> pa.ListArray:
        flat = np.stack(fields, 1).astype(np.int32).ravel()
        return pa.ListArray.from_arrays(pa.array((np.append(first, total) * len(fields)).astype(np.int32)), pa.array(flat))

    none = lambda n, kind: pa.nulls(n, kind)
    texts, ints = pa.list_(pa.string()), pa.list_(pa.int32())
    m = len(term)
    of_terms = [encoded.dictionary.take(pa.array(code[term])).cast(pa.string()), pa.array(np.full(m, segment, np.int64)),
                none(m, pa.int32()), pa.array(np.diff(np.append(term, len(cell))).astype(np.int32)),
                lists(np.searchsorted(part, term), by_block, len(part)), lists(term, [post, tf], len(cell)),
                none(m, texts), none(m, texts), none(m, ints)]
    heads = np.arange(0, rows, per_block)
    b, taken, ends = len(heads), pa.array(order), pa.array(np.append(heads, rows).astype(np.int32))
    of_blocks = [pa.array([_POSTS] * b, pa.string()), pa.array(np.full(b, segment, np.int64)),
                 pa.array(np.arange(b, dtype=np.int32)), pa.array(np.diff(np.append(heads, rows)).astype(np.int32)),
                 none(b, ints), none(b, ints), pa.ListArray.from_arrays(ends, ids.take(taken)),
                 pa.ListArray.from_arrays(ends, forums.take(taken)), pa.ListArray.from_arrays(ends, pa.array(length.astype(np.int32)))]
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(of_terms, of_blocks, strict=True)], names=names)


def _segments(per_block: int, segment_bytes: int):
    """Task function: index rows of a task's posts, a segment of about ``segment_bytes`` of text at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + segment_bytes, "right")))
                ids, forums, text = (pa.concat_arrays([c]) for c in batch.slice(lo, hi - lo).columns)
                words = pc.split_pattern(pc.if_else(pc.equal(text, ""), None, text), " ")
                yield _segment(ids, forums, words, segment, per_block)
                segment += 1
                lo = hi
    return run


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(posts: DataFrame, path: str, buckets: int | None = None, per_block: int = BLOCK_POSTS,
                segment_bytes: int = SEGMENT_BYTES) -> RelevanceIndex:
    """Index the title and the body of every post below ``path``.

    One pass: texts are brought to tokens in the JVM, each task groups its own posts, and
    only the grouped rows are shuffled, by term bucket. The rebalancing shuffle lets Spark cut a
    bucket with very frequent terms into several files and merge small ones.
    """
    spark = posts.sparkSession
    if buckets is None:
        size = estimated_bytes(posts)
        buckets = MAX_BUCKETS if size is None else min(MAX_BUCKETS, max(1, -(-size // max_partition_bytes(spark))))
    # the tokens of functions.text, one space between them: less to send than an array
    words = F.btrim(F.regexp_replace(F.lower(F.concat_ws(" ", "title", "selftext")), TOKEN_DELIMITER, " "))
    rows = posts.select("id", "forum", words.alias("words")).mapInArrow(_segments(per_block, segment_bytes), INDEX)
    bucket = F.when(F.col("term") == _POSTS, F.lit(-1)).otherwise(bucket_of(F.col("term"), buckets))
    (rows.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "segment")
     .write.partitionBy("bucket").parquet(f"{path}/rows"))
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(per_block).alias("per_block")).write.parquet(f"{path}/shape")
    return RelevanceIndex.read(spark, path)


def weight(n_posts: int, df: int) -> int:
    """A term's weight, in thousandths."""
    return math.floor(1000 * math.log(1 + (n_posts - df + 0.5) / (df + 0.5)))


def part(tf: Column, dl: Column, n_posts: int, length: int) -> Column:
    """The frequency part of a term in a post of ``dl`` tokens, in millionths: grows with ``tf``, falls with ``dl``."""
    mean = F.lit(300).cast("long") + F.call_function("div", F.lit(900 * n_posts).cast("long") * dl, F.lit(max(1, length)).cast("long"))
    return F.call_function("div", F.lit(2_200_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + mean)


_BLOCK = ["query", "segment", "block"]


def _records(flat: str, *fields: str) -> Column:
    """The numbers of an array, as many at a time as there are fields."""
    width = len(fields)
    every = F.sequence(F.lit(0), (F.size(flat) / width).cast("int") - 1)
    return F.transform(every, lambda i: F.struct(*[F.get(flat, width * i + k).alias(f) for k, f in enumerate(fields)]))


def _cut(df: DataFrame) -> DataFrame:
    """A small frame that several steps of a search read, written to the shared checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


@dataclass
class RelevanceIndex:
    """A stored index; any number of searches may use it, in any session that reads its folder."""

    spark: SparkSession
    path: str
    buckets: int
    per_block: int
    n_posts: int
    length: int

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> RelevanceIndex:
        """Open an index: its size is read from the rows that list the posts."""
        shape = spark.read.parquet(f"{path}/shape").first()
        lengths = F.transform("lengths", lambda x: x.cast("long"))
        total = cls._rows(spark, path).where(F.col("bucket") == -1).agg(
            F.sum(F.size(F.filter(lengths, lambda x: x > 0))), F.sum(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x))).first()
        return cls(spark, path, shape.buckets, shape.per_block, int(total[0] or 0), int(total[1] or 0))

    @staticmethod
    def _rows(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(f"{INDEX}, bucket int").parquet(f"{path}/rows")

    def terms_of(self, queries: list[str]) -> list[tuple[int, str, int]]:
        """(query, term, times) of a list of queries, by the tokens of the posts."""
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query int, text string")
        rows = (asked.select("query", F.explode(tokens("text")).alias("term"))
                .groupBy("query", "term").agg(F.count(F.lit(1)).alias("times")).collect())
        return sorted((r.query, r.term, r.times) for r in rows)

    def _of_terms(self, terms: list[str]) -> DataFrame:
        """The index rows of some terms: partition filter on the buckets, pushed filter on the terms."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = [r[0] for r in asked.select(bucket_of(F.col("term"), self.buckets)).distinct().collect()]
        names = ", ".join(sql_string(t) for t in terms) or "NULL"
        return self._rows(self.spark, self.path).where(F.col("bucket").isin(buckets)).where(f"term IN ({names})")

    def _plan(self, queries: list[str], k: int, forum: str | None) -> tuple[DataFrame, DataFrame]:
        """(candidates (query, segment, block, id, score), blocks (query, segment, block, bound, read))."""
        wanted = self.terms_of(queries)
        rows = self._of_terms(sorted({t for _, t, _ in wanted}))
        counts = {r.term: r.df for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        factors = [(q, t, times * weight(self.n_posts, counts[t])) for q, t, times in wanted if t in counts]
        asked = F.broadcast(self.spark.createDataFrame(factors, "query int, term string, factor long"))  # the given queries
        bound = F.col("factor") * part(F.col("b.tf"), F.col("b.dl"), self.n_posts, self.length)
        blocks = _cut(rows.select("term", "segment", F.explode(_records("bounds", "at", "tf", "dl")).alias("b")).join(asked, "term")
                      .groupBy("query", "segment", F.col("b.at").alias("block")).agg(F.sum(bound).alias("bound")))
        # the best k blocks hold k posts at least, and the best of each is near its block's bound
        seeds = _cut(top_k(blocks, k if forum is None else FORUM_SEEDS * k, [F.col("bound").desc(), F.col("segment").asc(), F.col("block").asc()],
                           by=["query"]).select(*_BLOCK))
        first = _cut(self._score(rows, asked, seeds, forum))
        reached = (top_k(first, k, self._order(), by=["query"]).groupBy("query")
                   .agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reached")))
        reached = F.broadcast(reached)  # one row per query
        marked = (blocks.join(seeds.select(*_BLOCK, F.lit(True).alias("seed")), _BLOCK, "left")
                  .join(reached, "query", "left")
                  .withColumn("read", F.col("seed").isNotNull() | (F.col("bound") >= F.coalesce("reached", F.lit(0)))))
        rest = marked.where(F.col("read") & F.col("seed").isNull())
        found = first.unionByName(self._score(rows, asked, rest, forum))
        return found, marked.select(*_BLOCK, "bound", "read")

    @staticmethod
    def _order() -> list[Column]:
        return [F.col("score").desc(), F.col("id").asc_nulls_last()]

    def _score(self, rows: DataFrame, asked: DataFrame, blocks: DataFrame, forum: str | None) -> DataFrame:
        """(query, segment, block, id, score): exact scores of the posts in some blocks."""
        needed = blocks.groupBy("query", "segment").agg(F.collect_list("block").alias("needed"))  # blocks of one segment
        held = rows.select("term", "segment", "posts").join(asked, "term").join(needed, ["query", "segment"])
        block = lambda at: (at / self.per_block).cast("int")
        chosen = F.filter(_records("posts", "at", "tf"), lambda p: F.array_contains("needed", block(p["at"])))
        hits = held.select("query", "segment", "factor", F.explode(chosen).alias("p")).select(
            "query", "segment", "factor", block(F.col("p.at")).alias("block"), (F.col("p.at") % self.per_block).alias("at"), "p.tf")
        names = self._rows(self.spark, self.path).where(F.col("bucket") == -1).select(
            "segment", "block", "ids", "forums", "lengths")
        named = hits.join(names, ["segment", "block"])
        if forum is not None:
            named = named.where(F.get("forums", F.col("at")) == F.lit(forum))
        add = F.col("factor") * part(F.col("tf"), F.get("lengths", F.col("at")), self.n_posts, self.length)
        return (named.groupBy(*_BLOCK, "at").agg(F.first(F.get("ids", F.col("at"))).alias("id"), F.sum(add).alias("score"))
                .drop("at").where("score > 0"))

    def search(self, queries: list[str], k: int = DEFAULT_LIMIT, forum: str | None = None,
               column: str = "keyword") -> DataFrame:
        """The ``k`` most relevant posts (of a forum) for each query: (keyword, rank, id, relevance)."""
        found, _ = self._plan(queries, k, forum)
        best = top_k(found, k, self._order(), by=["query"])
        rank = F.row_number().over(Window.partitionBy("query").orderBy(*self._order()))
        names = F.broadcast(self.spark.createDataFrame(list(enumerate(queries)), "query int, text string"))
        return best.withColumn("rank", rank).join(names, "query").select(
            F.col("text").alias(column), "rank", "id", F.col("score").alias("relevance"))

    def blocks_read(self, queries: list[str], k: int = DEFAULT_LIMIT, forum: str | None = None) -> DataFrame:
        """(keyword, blocks, blocks_read): blocks that hold a term of the query, and those that a search scores."""
        _, marked = self._plan(queries, k, forum)
        names = F.broadcast(self.spark.createDataFrame(list(enumerate(queries)), "query int, text string"))
        return (marked.groupBy("query").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("read").alias("blocks_read"))
                .join(names, "query").select(F.col("text").alias("keyword"), "blocks", "blocks_read"))
