"""Spelling variant grouping: words that are one edit apart, found by dense prefix-suffix tiling.

Two different words, the longer of M code points, are one inserted, deleted or
replaced code point apart exactly if their common prefix and common suffix
reach M - 1 together. So they agree outside a window of a few positions:
``keyed`` gives each word one key per window (what lies before and after it),
once for M its own length and once for M one longer, and only words of equal
key are compared. ``near_in_groups`` does so in padded code-point matrices,
block against block, all groups of a batch at once.

Sizes. A window has two positions for words of up to 64 code points (of 90
letters, so a group holds at most 90 * 90 + 90 words), and a 32nd of the word
beyond, so a word sends at most about its length, or 66, keys. A common word
or letter pair therefore never makes a large group; counts are pre-aggregated
in the task before they are shuffled, and every task reads its groups as a
sorted stream.

Defined results: a null text has no words; repeated rows count each time; a
null id reads as an empty id in the hash; of words of equal count the smaller
in code-point order is the form. No cap on words, lengths or partners.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import cut, id_text, stored
from postlens.llm.kernels import STEP, U64, mix, powers

SHORTEST = 7  # code points of a word
LEAST = 2  # occurrences of a word
RATIO = 10  # a form occurs so many times as often
DROP_IN = 31  # one run in so many loses a code point
HELD = 200_000  # distinct words that a counting task holds before it sends them on
BATCH = 1 << 18  # key rows compared at once
CELLS = 1 << 24  # cells of one block pair
TILE = 256  # rows of a block of a large group
SMALL = 16  # groups of up to so many rows are compared together
WINDOW, WINDOWS = 2, 32

RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)


def changed(run: str, prefix_crc: int) -> str:
    """The run, less one code point where the hash of ``<doc_id>:<run>`` says so."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % DROP_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each task, in parts of about ``HELD`` words."""
    held: Counter = Counter()

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                         names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(*(batch.column(i) for i in range(2)), strict=True):
            raw = text.as_buffer()
            if raw is None:
                continue
            key = doc_id.as_py()
            start = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in Counter(RUN.findall(bytes(raw).lower().decode())).items():
                word = changed(run, start)
                if len(word) >= SHORTEST:
                    held[word] += n
            if len(held) >= HELD:
                yield send()
    if held:
        yield send()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts that occur ``LEAST`` times or more."""
    part = id_text(docs, id_col, text_col).mapInArrow(count_words, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def letters(words: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words (each below 256) in one row, and the word lengths."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw], np.int64)


def window(m: int) -> int:
    """Positions of one window for words of up to ``m`` code points."""
    return max(WINDOW, -(-m // WINDOWS))


def sides(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last j code points, j from 0, of words of one length."""
    code = mix(code.astype(U64) + U64(1))
    n, length = code.shape
    place = powers(length)
    out = np.zeros((2, n, length + 1), U64)
    np.cumsum(code * place, axis=1, out=out[0, :, 1:])
    np.cumsum(code[:, ::-1] * place, axis=1, out=out[1, :, 1:])
    return out[0], out[1]


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, m, k, word, n): a word under the hash of all that lies around window ``k`` of M = ``m`` positions."""
    for batch in batches:
        words, counts = batch.column(0), batch.column(1)
        data, size = letters(words)
        first = np.cumsum(size) - size
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            step = max(1, CELLS // (8 * length))
            for lo in range(0, len(rows), step):
                mine = rows[lo: lo + step]
                ahead, behind = sides(data[first[mine][:, None] + np.arange(length)])
                word, n = words.take(pa.array(mine)), counts.take(pa.array(mine))
                for m in (length, length + 1):
                    w = window(m)
                    for k, start in enumerate(range(0, m, w)):
                        after = max(0, m - start - w)
                        key = mix(mix(ahead[:, start] + np.array([m], U64) * STEP) ^ (behind[:, after] + U64(k)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), pa.array(np.full(len(mine), m, np.int64)),
                             pa.array(np.full(len(mine), k, np.int64)), word, n], names=["key", "m", "k", "word", "n"])


def padded(data: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code-point matrices of the words, padded with zeros: from the left, and reversed from the right."""
    col = np.arange(width)
    inside = col < size[:, None]
    left = np.where(inside, data[np.where(inside, first[:, None] + col, 0)], 0)
    right = np.where(inside, data[np.where(inside, (first + size - 1)[:, None] - col, 0)], 0)
    return left, right


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common start of rows that meet, ``most`` at the most."""
    differs = a != b
    at = differs.argmax(axis=-1)
    return np.minimum(np.where(np.take_along_axis(differs, at[..., None], -1)[..., 0], at, a.shape[-1]), most)


class Tiles:
    """The rows of whole groups of one M, compared block against block."""

    def __init__(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, m: int, k: np.ndarray):
        self.left, self.right = padded(data, first, size, m)
        self.size, self.m, self.k, self.w = size, m, k, window(m)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which rows ``i`` and ``j`` (broadcast) are one edit apart, the edit in their window.

        The window is the one that holds the end of the common prefix, so of
        all groups that both words are in exactly one reports them.
        """
        short = np.minimum(self.size[i], self.size[j])
        ahead = common(self.left[i], self.left[j], short)
        behind = common(self.right[i], self.right[j], short)
        longer = np.maximum(self.size[i], self.size[j])  # both one shorter than M: the work of another M
        return (longer == self.m) & (ahead + behind >= self.m - 1) & (ahead // self.w == self.k[i])

    def pairs(self, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The near pairs of the groups ``edge[g]:edge[g + 1]``.

        Small groups together, their rows against the rows one, two, ... further on; each
        large group in blocks of ``TILE`` rows.
        """
        g = np.diff(edge)
        end = np.repeat(np.where(g <= SMALL, edge[1:], 0), g)
        at, step = np.arange(len(end)), max(1, CELLS // self.m)
        for gap in range(1, SMALL):
            at = at[at + gap < end[at]]
            for lo in range(0, len(at), step):
                i = at[lo: lo + step]
                i = i[self.near(i, i + gap)]
                yield i, i + gap
        t = max(1, min(TILE, int((CELLS // self.m) ** 0.5)))
        for one in np.flatnonzero(g > SMALL):
            for a in range(edge[one], edge[one + 1], t):
                i = np.arange(a, min(a + t, edge[one + 1]))
                for b in range(a, edge[one + 1], t):
                    j = np.arange(b, min(b + t, edge[one + 1]))
                    x, y = np.nonzero(self.near(i[:, None], j[None, :]) & (i[:, None] < j[None, :]))
                    yield i[x], j[y]


def near_in_groups(rows: pa.Table) -> pa.RecordBatch | None:
    """(word, n_near, form_n, form) over whole groups, sorted by key: near words per word, and the commonest."""
    key = rows["key"].to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    g = np.diff(edge)
    rows = rows.filter(pa.array(np.repeat(g > 1, g)))
    if not rows.num_rows:
        return None
    rows = rows.take(pa.array(np.argsort(rows["m"].to_numpy(), kind="stable"))).combine_chunks()  # groups stay whole
    key, m, k, n = (rows[c].to_numpy() for c in ("key", "m", "k", "n"))
    data, size = letters(rows["word"])
    first = np.cumsum(size) - size
    edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (m[1:] != m[:-1]), [True])))
    found = []
    for one in np.unique(m).tolist():
        mine = edge[np.searchsorted(m[edge[:-1]], one): np.searchsorted(m[edge[:-1]], one, "right") + 1]
        lo = 0
        while lo < len(mine) - 1:  # whole groups, about CELLS cells at once
            hi = max(lo + 1, int(np.searchsorted(mine, mine[lo] + CELLS // one, "right")) - 1)
            span = slice(mine[lo], mine[hi])
            tiles = Tiles(data, first[span], size[span], one, k[span])
            found += [(i + mine[lo], j + mine[lo]) for i, j in tiles.pairs(mine[lo: hi + 1] - mine[lo])]
            lo = hi
    a = np.concatenate([i for i, _ in found] + [j for _, j in found])
    b = np.concatenate([j for _, j in found] + [i for i, _ in found])
    if not len(a):
        return None
    texts = np.array(rows["word"].to_pylist(), object)
    words, inv = np.unique(texts, return_inverse=True)  # in code-point order
    count = np.zeros(len(words), np.int64)
    count[inv] = n
    best = np.lexsort((np.arange(len(words)), -count))
    place = np.empty(len(words), np.int64)
    place[best] = np.arange(len(words))
    low = np.full(len(words), len(words), np.int64)
    np.minimum.at(low, inv[a], place[inv[b]])
    total = np.bincount(inv[a], minlength=len(words))
    got = np.flatnonzero(total)
    form = best[low[got]]
    return pa.RecordBatch.from_arrays(
        [pa.array(words[got].tolist(), pa.string()), pa.array(total[got].astype(np.int64)), pa.array(count[form]),
         pa.array(words[form].tolist(), pa.string())], names=["word", "n_near", "form_n", "form"])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of a task's rows, which come sorted by key; a group that a batch cuts waits for the next."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < BATCH:
            continue
        rows = pa.Table.from_batches(held)
        key = rows["key"].to_numpy()
        whole = int(np.searchsorted(key, key[-1]))
        out = near_in_groups(rows.slice(0, whole)) if whole else None
        if out is not None:
            yield out
        held = rows.slice(whole).to_batches()
        size = rows.num_rows - whole
    out = near_in_groups(pa.Table.from_batches(held)) if held else None
    if out is not None:
        yield out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): near words of each word that has any, and the commonest of them."""
    rows = words.select("word", "n").mapInArrow(keyed, "key long, m long, k long, word string, n long")
    parts = rows.repartition("key").sortWithinPartitions("key").mapInArrow(
        compare, "word string, n_near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return (parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best"))
            .select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word on each chain of forms.

    Counts grow ``RATIO``-fold along a chain, so it has at most 18 links; each
    round doubles the links passed.
    """
    cur = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = cut(cur.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                      F.col("further").isNotNull().alias("moved")))
        if not nxt.where("moved").limit(1).count():
            break
        cur = nxt.drop("moved")
    return cur


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all texts with their spelling groups: (word, n, n_near, form, form_n, root)."""
    words = stored(word_counts(docs, id_col, text_col), "words")
    near = stored(words.join(near_words(words), "word", "left")
                  .withColumn("is_variant", F.coalesce(F.col("form_n") >= RATIO * F.col("n"), F.lit(False))), "near")
    ends = roots(near.where("is_variant").select("word", "form"))
    kept = lambda c: F.when(F.col("is_variant"), F.col(c)).alias(c)
    return near.join(ends, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), kept("form"), kept("form_n"),
        F.coalesce("root", "word").alias("root"))
