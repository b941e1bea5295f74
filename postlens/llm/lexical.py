"""Ranked lexical search: accumulator-limited, term at a time.

The documents are read once: each becomes its number of terms and its counts
of the terms that items ask for (``postings``), stored in the shared folder.
Document frequencies and lengths are counted over all of them. Then each task
ranks its own documents for every item (``rank``): terms come rarest first and
add to one accumulator per document; once the bounds of the terms left cannot
reach the score of the k-th document, no accumulator is created any more and
only those that exist are updated, so kept scores are exact. A task sends k
rows per item, and those are ranked once more.

The items are a stated query set: a block of them with about ``TERMS`` terms
is sent to the tasks at once, and further blocks take further passes, so what
is sent is bounded and no item or term is dropped. Scores are 64-bit integers
(``weight`` alone is computed in doubles).

Defined results: a null or empty text has no terms (as an item: no rows);
every row of either table counts, so a repeated item is ranked again and a
repeated document holds two ranks; equal scores by ascending id, a null id
last; no document scores: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import id_text, slices, stored
from postlens.llm.kernels import ALNUM, Words
from postlens.operators.search import top_k

TOP = 20
TERMS = 200_000  # rows (item, term) of one block of items, about
SCALE, TF, LENGTH = 1_000_000_000, 1000, 12
BASE, SLOPE = 75, 25  # a document's m: BASE + SLOPE for one of mean length


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): the distinct terms of each item row."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), upper, lower),
                                 F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rows = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"),
                               words.alias("words")), "items")
    return (rows.select("item", "item_id", F.explode("words").alias("term"))
            .groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times")))


class Dictionary:
    """The terms of a block of items, found again among the words of texts by hash and then by their bytes."""

    def __init__(self, terms: list[str]):
        words = Words(pa.array(terms, pa.string()), ALNUM, lower=False)  # each term is one word
        order = np.argsort(words.hash, kind="stable")
        self.hash, self.of = words.hash[order], order
        self.data, self.start, self.size = words.data, words.start, words.end - words.start
        self.repeats = int(np.unique(self.hash, return_counts=True)[1].max(initial=0))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of every word that is a term."""
        at = np.searchsorted(self.hash, words.hash)
        found = []
        for more in range(self.repeats):  # more than one only where terms share a hash
            to = np.minimum(at + more, len(self.hash) - 1)
            word = np.flatnonzero((at + more < len(self.hash)) & (self.hash[to] == words.hash))
            term = self.of[to[word]]
            size = self.size[term]
            same = words.end[word] - words.start[word] == size
            word, term, size = word[same], term[same], size[same]
            for length in np.unique(size):
                rows = np.flatnonzero(size == length)
                step = max(1, (1 << 22) // int(length))
                for lo in range(0, len(rows), step):
                    r = rows[lo: lo + step]
                    col = np.arange(length)
                    equal = (words.data[words.start[word[r]][:, None] + col]
                             == self.data[self.start[term[r]][:, None] + col]).all(axis=1)
                    found.append((word[r[equal]], term[r[equal]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([w for w, _ in found]), np.concatenate([t for _, t in found])


def count_terms(terms: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: (doc_id, n, terms, counts) of each document, ``terms`` ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(terms)
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), ALNUM, lower=True)
            word, term = known.find(words)
            cell, times = np.unique(words.doc[word] * len(terms) + term, return_counts=True)
            doc = cell // max(1, len(terms))
            off = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(words.first).astype(np.int64)),
                 pa.ListArray.from_arrays(off, pa.array((cell % max(1, len(terms))).astype(np.int32))),
                 pa.ListArray.from_arrays(off, pa.array(times.astype(np.int64)))],
                names=["doc_id", "n", "terms", "counts"])
    return run


def weight(n_docs: int, df: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def accumulate(query: list[tuple[int, int]], first: np.ndarray, doc: np.ndarray, part: np.ndarray, bound: np.ndarray,
               size: int, k: int, floor: int) -> np.ndarray:
    """Scores of ``size`` documents for one item; exact for all that can be among its first k.

    ``query``: (term, factor), rarest first; postings of a term:
    ``first[t]:first[t + 1]`` of ``doc`` and ``part``; ``bound``: each term's largest part; ``floor``: the
    score that a document must at least equal.
    """
    acc = np.zeros(size, np.int64)
    left = sum(factor * int(bound[t]) for t, factor in query)
    creating = True
    for t, factor in query:
        here = slice(first[t], first[t + 1])
        rows = doc[here]
        if creating and left < max(floor, _kth(acc, k)):
            creating = False
        left -= factor * int(bound[t])
        if not len(rows) or not factor:
            continue
        add = factor * part[here]
        if not creating:
            live = acc[rows] > 0
            rows, add = rows[live], add[live]
        acc[rows] += add  # a term's documents are distinct
    return acc


def _kth(acc: np.ndarray, k: int) -> int:
    """The k-th largest partial score, 0 while there are fewer."""
    live = acc[acc > 0]
    return int(np.partition(live, len(live) - k)[len(live) - k]) if len(live) >= k else 0


def rank(queries: list[tuple[int, list[tuple[int, int]]]], n_terms: int, n_docs: int, length: int, k: int) -> Callable:
    """Task function: the k best documents of the task for each item, as (item, doc_id, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for batch in batches:
            n = batch.column(1).to_numpy()
            if not n.any():
                continue
            m = BASE + SLOPE * n * n_docs // length
            terms, counts = batch.column(2), batch.column(3)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
            term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], tf[order]
            first = np.searchsorted(term, np.arange(n_terms + 1))
            part = SCALE * tf // (TF * tf + LENGTH * m[doc])
            bound = np.zeros(n_terms, np.int64)
            held = np.flatnonzero(np.diff(first))
            if len(held):
                bound[held] = np.maximum.reduceat(part, first[held])
            for item, query in queries:
                old = best.get(item)
                floor = old["score"][-1].as_py() if old is not None and old.num_rows == k else 0
                acc = accumulate(query, first, doc, part, bound, batch.num_rows, k, floor)
                rows = np.flatnonzero(acc >= max(1, floor, _kth(acc, k)))
                if not len(rows):
                    continue
                new = pa.table({"doc_id": batch.column(0).take(pa.array(rows)), "score": pa.array(acc[rows])})
                both = new if old is None else pa.concat_tables([old, new])
                to = pc.sort_indices(both, [("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")
                best[item] = both.take(to[:k]).combine_chunks()
        for item, rows in best.items():
            for part_ in rows.to_batches():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part_.num_rows, item, np.int64)), part_.column(0), part_.column(1)],
                    names=["item", "doc_id", "score"])
    return run


def _block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): per task the k best documents of each item of a block."""
    rows = terms.select("item", "term", "times").collect()  # about TERMS rows
    names = sorted({r.term for r in rows})
    number = {t: i for i, t in enumerate(names)}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = stored(docs.mapInArrow(count_terms(names), f"doc_id {id_type}, n long, terms array<int>, counts array<long>"),
                   "postings")
    total = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
    n_docs, length = total.docs, int(total.length or 0)
    df = {r.term: r.n for r in found.select(F.explode("terms").alias("term")).groupBy("term")
          .agg(F.count(F.lit(1)).alias("n")).collect()}
    queries: dict[int, list] = {}
    for r in rows:
        t = number[r.term]
        if t in df:
            queries.setdefault(r.item, []).append((df[t], t, r.times * weight(n_docs, df[t])))
    queries = [(item, [(t, factor) for _, t, factor in sorted(q)]) for item, q in sorted(queries.items())]
    return found.mapInArrow(rank(queries, len(names), n_docs, max(1, length), k),
                            f"item long, doc_id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of ``items``."""
    terms = stored(item_terms(items, item_col, item_text_col), "item_terms")
    blocks = max(1, -(-terms.count() // TERMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    mine = id_text(docs, id_col, text_col)
    found = reduce(DataFrame.unionByName, [_block(mine, terms.where(block == b), k) for b in range(blocks)])
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    best = top_k(stored(found, "ranked"), k, order, by=["item"])
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    ids = terms.select("item", "item_id").distinct()
    return ranked.join(ids, "item").select("item", "item_id", "rank", "doc_id", "score")
