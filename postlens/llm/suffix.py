"""Suffix-array dedup with a logarithmic index family.

The shared plan (``repeats``) brings every span that may repeat to the shard of
its canonical text. There the spans arrive in batches. A batch gets a suffix
array, is merge-scanned against each level of the index for matches of the
threshold length, and becomes a new level; levels of equal size merge, so there
are logarithmically many. Suffixes are ordered by a 64-bit fingerprint of
their first 200 bytes: the scan asks only whether 200 bytes are equal, and
for that any order of 200-byte prefixes does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm.kernels import buffers, flagged_runs
from postlens.llm.repeats import BATCH_BYTES, HOT, ByteSeq, find_repeats, gram_hashes, overlapped, removed_mask

THRESHOLD = ByteSeq.W
BATCH_WINDOWS = 1 << 16


class IndexFamily:
    """Levels of suffix arrays, each about twice the size of the next."""

    def __init__(self, windows: int):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # fingerprints in order, window numbers
        self.repeated = np.zeros(windows, bool)

    def insert(self, prints: np.ndarray, numbers: np.ndarray) -> None:
        """Scan a new batch against itself and all levels, then add it."""
        order = np.argsort(prints, kind="stable")
        prints, numbers = prints[order], numbers[order]
        new = np.append(True, prints[1:] != prints[:-1])
        twice = ~new
        twice[:-1] |= twice[1:]
        self.repeated[numbers[twice]] = True
        for level, held in self.levels:
            at = np.minimum(np.searchsorted(level, prints), len(level) - 1)
            hit = level[at] == prints
            self.repeated[numbers[hit]] = True
            self.repeated[held[at[hit]]] = True
        self.levels.append((prints[new], numbers[new]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (p, a), (q, b) = self.levels.pop(), self.levels.pop()
            p, a = np.concatenate((q, p)), np.concatenate((b, a))
            order = np.argsort(p, kind="stable")
            p, a = p[order], a[order]
            new = np.append(True, p[1:] != p[:-1])  # one of equal suffixes will do
            self.levels.append((p[new], a[new]))


def judge(rows: list[tuple]) -> Iterator[tuple]:
    """Removed byte ranges of one shard's spans."""
    first = rows[0][4]
    if all(r[4] == first for r in rows):
        if len(rows) > 1:
            for _, batch, doc, lo, span in rows:
                yield batch, doc, lo, lo + len(span)
            return
    spans = [r[4] for r in rows]
    counts = np.array([len(s) - THRESHOLD + 1 for s in spans])
    ends = np.cumsum(counts)
    family, at = IndexFamily(int(ends[-1])), 0
    while at < len(spans):
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + BATCH_WINDOWS, "right")))
        lengths = np.array([len(s) for s in spans[at:stop]])
        data = np.frombuffer(b"".join(spans[at:stop]), np.uint8)
        prints = overlapped(gram_hashes(data)[128], 128, THRESHOLD)
        heads = np.cumsum(lengths) - lengths
        own = np.repeat(heads - (ends[at:stop] - counts[at:stop] - base), counts[at:stop]) + np.arange(int(ends[stop - 1]) - base)
        family.insert(prints[own], np.arange(base, int(ends[stop - 1])))
        at = stop
    for (_, batch, doc, lo, _), end, count in zip(rows, ends.tolist(), counts.tolist(), strict=True):
        for a, b in zip(*flagged_runs(family.repeated[end - count: end]), strict=True):
            yield batch, doc, lo + int(a), lo + int(b) + THRESHOLD - 1


def finish(run: pa.RecordBatch, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Counts and the kept bytes of a run of texts."""
    data, first = buffers(run.column(2))
    gone = removed_mask(first, doc, lo, hi)
    total = np.concatenate(([0], np.cumsum(gone)))
    head = gone.copy()
    if len(gone):
        head[1:] &= ~gone[:-1]
        inner = first[(first > 0) & (first < len(gone))]
        head[inner] = gone[inner]
    runs = np.concatenate(([0], np.cumsum(head)))
    left = data[~gone]
    offs = (first - total[first]).astype(np.int32)
    per = lambda x: pa.array((x[first[1:]] - x[first[:-1]]).astype(np.int64))
    kept = pa.Array.from_buffers(pa.binary(), run.num_rows, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(left.tobytes())])
    return pa.RecordBatch.from_arrays(
        [run.column(0), run.column(1), pa.array(np.diff(first).astype(np.int64)), per(total), per(runs), kept],
        names=["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                batch_bytes: int = BATCH_BYTES, hot: int = HOT) -> DataFrame:
    """``doc_id, th, n_bytes, n_removed, n_spans, kept`` per document; ``kept`` is what is left.

    Each byte covered by a 200-byte string that also starts anywhere else, in
    the same text too, is removed; strings are judged on the input. Null
    texts are empty; exactly repeated rows count against each other like
    any other texts; null ids need no order; an empty table gives no rows; other
    columns are ignored.
    """
    return find_repeats(docs, ByteSeq, judge, finish,
                        "doc_id {id}, th long, n_bytes long, n_removed long, n_spans long, kept binary",
                        id_col, text_col, False, batch_bytes, hot)
