"""F2 and J3 for long keyword lists and keyword tables: all keywords in one pass over the text.

``tag_keywords`` tests every keyword against every post, which is right for a
handful of them. Here the cost of a post does not depend on their number:
keywords are told apart by rolling hashes of their first and last bytes, a
fixed-size filter lets through the few positions of a text where one may
start, and what is found is compared byte by byte. The match is that of
``search.keyword_condition``: case-insensitive, literal, on title or
selftext, the keyword without surrounding white space, a blank one matching
nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.search import needle

FILTER_BITS = 20
PIECE = 1 << 18  # bytes of text hashed at once
BLOCK_BYTES = 8 << 20  # keywords of one pass over the posts

_U = np.uint64
_MULTIPLIER = np.array([0x9E3779B97F4A7C15], _U)  # an odd number; any will do
_SPREAD = np.array([0xD6E8FEB86659FD93], _U)


def _widen(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``2 * length`` bytes from those of ``length``."""
    if len(h) <= length:
        return h[:0]
    factor = _MULTIPLIER.copy()
    for _ in range(length.bit_length() - 1):
        factor = factor * factor
    return h[:-length] * factor + h[length:]


def _first_level(data: np.ndarray) -> np.ndarray:
    return data.astype(_U) + _U(1)


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _SPREAD) >> _U(64 - bits)).astype(np.int64)


def _pair(first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (first * _SPREAD) ^ (last * _MULTIPLIER) ^ length.astype(_U)


class _Width:
    """The keywords whose longest power of two of bytes is ``width``: told by their first and last ``width`` bytes."""

    def __init__(self, width: int, keys: list[tuple[int, np.ndarray]]):
        self.width = width
        number = np.array([k for k, _ in keys], np.int64)
        size = np.array([len(b) for _, b in keys], np.int64)
        first, last = np.zeros(len(keys), _U), np.zeros(len(keys), _U)
        for i, (_, b) in enumerate(keys):
            first[i], last[i] = self.hash_of(b[:width]), self.hash_of(b[len(b) - width:])
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[_slot(first, FILTER_BITS)] = True
        self.lengths = np.unique(size)
        whole = _pair(first, last, size)
        order = np.argsort(whole, kind="stable")
        self.whole, self.number = whole[order], number[order]
        self.most = int(np.unique(whole, return_counts=True)[1].max())
        starts = np.unique(first)
        self.first = starts

    def hash_of(self, run: np.ndarray) -> np.uint64:
        h, length = _first_level(run), 1
        while length < self.width:
            h = _widen(h, length)
            length *= 2
        return h[0]

    def find(self, h: np.ndarray, room: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, keyword) that may match from the first ``starts`` positions on.

        ``h``: hashes of all runs of ``width`` bytes; ``room``: bytes left in the text.
        """
        at = np.flatnonzero(self.bits[_slot(h[:starts], FILTER_BITS)])
        if len(at):
            near = np.minimum(np.searchsorted(self.first, h[at]), len(self.first) - 1)
            at = at[self.first[near] == h[at]]
        found = []
        for length in self.lengths.tolist():
            here = at[room[at] >= length]
            whole = _pair(h[here], h[here + length - self.width], np.array([length]))
            spot = np.searchsorted(self.whole, whole)
            for more in range(self.most):
                to = np.minimum(spot + more, len(self.whole) - 1)
                hit = (spot + more < len(self.whole)) & (self.whole[to] == whole)
                found.append((here[hit], self.number[to[hit]]))
        return np.concatenate([p for p, _ in found]), np.concatenate([k for _, k in found])


class KeywordMatcher:
    """A set of literal byte strings, found in texts in one pass whatever their number."""

    def __init__(self, needles: list[str]):
        keys = [np.frombuffer(n.encode(), np.uint8) for n in needles]
        self.size = np.array([len(k) for k in keys], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.concatenate(keys) if keys else np.zeros(0, np.uint8)
        by_width: dict[int, list] = {}
        for i, k in enumerate(keys):
            if len(k):
                by_width.setdefault(1 << (len(k).bit_length() - 1), []).append((i, k))
        self.widths = [_Width(w, ks) for w, ks in sorted(by_width.items())]
        self.longest = int(self.size.max(initial=0))

    def _equal(self, data: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether the bytes of the text are those of the keyword."""
        out = np.zeros(len(at), bool)
        size = self.size[key]
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            step = max(1, (1 << 22) // length)
            for lo in range(0, len(rows), step):
                r = rows[lo: lo + step]
                col = np.arange(length)
                out[r] = (data[at[r][:, None] + col] == self.data[self.start[key[r]][:, None] + col]).all(axis=1)
        return out

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, keyword) of the texts ``data[off[i]:off[i + 1]]``, sorted."""
        cells = []
        lo = 0
        while lo < len(data) and self.widths:
            hi = min(len(data), lo + PIECE)
            piece = data[lo: min(len(data), hi + self.longest)]
            text = np.searchsorted(off, np.arange(lo, lo + len(piece)), "right") - 1
            room = off[text + 1] - np.arange(lo, lo + len(piece))
            h, width = _first_level(piece), 1
            for group in self.widths:
                while width < group.width:
                    h = _widen(h, width)
                    width *= 2
                at, key = group.find(h, room, hi - lo)  # the rest starts in the next piece
                same = self._equal(piece, at, key)
                cells.append(np.unique(text[at[same]] * len(self.size) + key[same]))
            lo = hi
        cell = np.unique(np.concatenate(cells)) if cells else np.zeros(0, np.int64)
        return cell // max(1, len(self.size)), cell % max(1, len(self.size))

    def hits(self, columns: list[pa.Array]) -> pa.ListArray:
        """Per row the keywords (ascending) that any of the text columns holds."""
        rows = len(columns[0])
        cells = []
        for arr in columns:
            arr = arr.cast(pa.large_string()).fill_null("")
            _, offs, raw = arr.buffers()
            off = np.frombuffer(offs, np.int64, rows + 1, arr.offset * 8) if rows else np.zeros(1, np.int64)
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            text, key = self.find(data[off[0]: off[-1]], off - off[0])
            cells.append(text * max(1, len(self.size)) + key)
        cell = np.unique(np.concatenate(cells))
        text, key = cell // max(1, len(self.size)), cell % max(1, len(self.size))
        ends = np.searchsorted(text, np.arange(rows + 1))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(key.astype(np.int32)))


def _hits(needles: list[str]):
    """The positions in ``needles`` that a row's lower-cased title or selftext holds, as a column function."""
    built: list[KeywordMatcher] = []

    def run(title: pa.Array, selftext: pa.Array) -> pa.Array:
        if not built:
            built.append(KeywordMatcher(needles))  # once per Python worker
        return built[0].hits([title, selftext])

    return F.arrow_udf(run, "array<int>")


def _blocks(keywords: DataFrame, keyword_col: str) -> list[tuple[list[str], list[str]]]:
    """The keywords (as given) and what they look for, in blocks of about ``BLOCK_BYTES``."""
    rows = keywords.select(F.col(keyword_col).alias("tag"), needle(F.col(keyword_col)).alias("needle")).where("needle IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("tag") + F.octet_length("needle"))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    of = F.pmod(F.xxhash64("tag"), F.lit(blocks))
    out = []
    for b in range(blocks):
        got = rows.where(of == b).collect() if size else []  # one block
        out.append(([r.tag for r in got], [r.needle for r in got]))
    return out


def tag_keyword_table(posts: DataFrame, keywords: DataFrame, keyword_col: str = "keyword",
                      column: str = "keyword") -> DataFrame:
    """J3 for a keyword table: one row per (post, matching keyword row), ``column`` the keyword as given.

    The table goes to the tasks in blocks of ``BLOCK_BYTES``, one pass over
    the posts per block: a list of 50 or of 100,000 keywords costs one pass, and a table of
    any length is matched whole. Equal entries count each on its own, as in
    ``tag_keywords``. Row-local: no shuffle; only title and selftext reach Python.
    """
    parts = []
    for tags, needles in _blocks(keywords, keyword_col):
        if not tags:
            continue
        parts.append(_explode_tags(posts, _hits(needles)(F.lower(F.col("title")), F.lower(F.col("selftext"))), tags, column))
    if not parts:
        return posts.withColumn(column, F.lit(None).cast("string")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def posts_with_keyword_table(posts: DataFrame, keywords: DataFrame, keyword_col: str = "keyword",
                             column: str = "keywords") -> DataFrame:
    """Posts matching at least one keyword row, once each, with their keywords as an array (sorted within a block).

    For work that is per post, as ``search.posts_with_keywords`` is for lists: a post with a hundred
    keywords is cleaned and scored once.
    """
    found = _free("_found", [*posts.columns, column])
    title, selftext = F.lower(F.col("title")), F.lower(F.col("selftext"))
    arrays = [_tags(tags, needles)(title, selftext) for tags, needles in _blocks(keywords, keyword_col) if tags]
    every = F.concat(*arrays) if arrays else F.array().cast("array<string>")
    marked = posts.select("*", every.alias(column))
    # the first hit through explode_outer: a size filter would be pushed down and match twice
    return (marked.select("*", F.explode_outer(F.slice(F.col(column), 1, 1)).alias(found))
            .where(F.col(found).isNotNull()).drop(found))


def _tags(tags: list[str], needles: list[str]):
    """Like ``_hits``, with the keywords as given in place of their positions."""
    built: list = []

    def run(title: pa.Array, selftext: pa.Array) -> pa.Array:
        if not built:
            built.extend([KeywordMatcher(needles), pa.array(tags, pa.string())])
        hits = built[0].hits([title, selftext])
        return pa.ListArray.from_arrays(hits.offsets, built[1].take(hits.values))

    return F.arrow_udf(run, "array<string>")


def _free(name: str, taken: list[str]) -> str:
    """A column name that the posts do not have."""
    while name in taken:
        name += "_"
    return name


def _explode_tags(posts: DataFrame, hits: Column, tags: list[str], column: str) -> DataFrame:
    """One row per hit; the tags of a block travel once, as a small table."""
    every, one, tag = (_free(n, [*posts.columns, column]) for n in ("_hits", "_hit", "_tag"))
    names = posts.sparkSession.createDataFrame(list(enumerate(tags)), f"{one} int, {tag} string")
    # explode_outer + null filter: a plain explode makes Catalyst infer a size filter and match twice
    found = posts.select("*", hits.alias(every)).select("*", F.explode_outer(every).alias(one)).where(
        F.col(one).isNotNull()).drop(every)
    tagged = found.join(F.broadcast(names), one)  # a block of keywords: at most about BLOCK_BYTES
    return tagged.select(*[c for c in posts.columns if c != column], F.col(tag).alias(column))
