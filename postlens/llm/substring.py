"""Substring dedup with suffix automata of reference shards.

The shared plan (``repeats``) brings every span that may repeat to the shard of
its canonical text. There the texts stream past the shard's suffix automaton
in the order of their ids: the matching statistics give, at each word, the
longest suffix that occurs in a text with a smaller id; where it reaches the
threshold the span is removed. What a text adds that the automaton lacks is
then appended, so the automaton holds each repeated passage once.

Sending every shard's automaton to all documents would cost shards x corpus
work; the shards are built where they are used, and documents come only to
the shards that share an anchor with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm.kernels import SPACES, Words, flagged_runs
from postlens.llm.repeats import BATCH_BYTES, HOT, WordSeq, find_repeats, removed_mask

THRESHOLD = WordSeq.W


class SuffixAutomaton:
    """Generalised suffix automaton over words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        """Append one string."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            else:
                size = 0
            out.append(size)
        return out


def judge(rows: list[tuple]) -> Iterator[tuple]:
    """Removed word ranges of one shard's spans, given in the order of their ids."""
    first = rows[0]
    if all(r[4] == first[4] for r in rows):
        for doc_id, batch, doc, lo, span in rows:
            if doc_id != first[0]:
                yield batch, doc, lo, lo + len(span.split())
        return
    automaton = SuffixAutomaton()
    for _, same in groupby(rows, key=lambda r: r[0]):
        fresh = []
        for _, batch, doc, lo, span in same:
            words = span.split()
            match = np.array(automaton.statistics(words)[THRESHOLD - 1:]) >= THRESHOLD
            for a, b in zip(*flagged_runs(match), strict=True):
                yield batch, doc, lo + int(a), lo + int(b) + THRESHOLD - 1
            fresh += [words[int(a): int(b) + THRESHOLD - 1] for a, b in zip(*flagged_runs(~match), strict=True)]
        for words in fresh:
            automaton.add(words)


def finish(run: pa.RecordBatch, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Counts and the kept text (words joined by one blank) of a run of texts."""
    w = Words(run.column(2), SPACES, False)
    gone = removed_mask(w.first, doc, lo, hi)
    n = np.diff(w.first)
    total = np.concatenate(([0], np.cumsum(gone)))
    raw, kept = w.data.tobytes(), []
    for x, y in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        keep = np.flatnonzero(~gone[x:y]) + x
        kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)]))
    return pa.RecordBatch.from_arrays(
        [run.column(0), run.column(1), pa.array(n.astype(np.int64)),
         pa.array((total[w.first[1:]] - total[w.first[:-1]]).astype(np.int64)), pa.array(kept, pa.binary())],
        names=["doc_id", "th", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     batch_bytes: int = BATCH_BYTES, hot: int = HOT) -> DataFrame:
    """``doc_id, th, n_words, n_removed, kept`` per document; ``kept`` is UTF-8.

    Each word covered by a window of 13 words that also starts in a text
    with a smaller id is removed; windows are judged on the input. Words are
    runs of other than blank and tab to carriage return, unchanged. Null
    and empty texts have no words. A null id is smaller than any other;
    texts of equal ids never count against each other, so exactly repeated
    rows get one verdict each. An empty table gives no rows; other columns are
    ignored.
    """
    return find_repeats(docs, WordSeq, judge, finish,
                        "doc_id {id}, th long, n_words long, n_removed long, kept binary",
                        id_col, text_col, True, batch_bytes, hot)
