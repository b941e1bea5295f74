"""Vectorised text kernels over Arrow string buffers (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.RandomState(20240817)
BYTE_CODE = (_rng.randint(0, 1 << 32, 256).astype(U64) << U64(32)) | _rng.randint(0, 1 << 32, 256).astype(U64)
STEP = U64(0x9E3779B97F4A7C15)  # odd multiplier of the positional hashes

SPACES = np.ones(256, bool)  # word bytes of [^\x20\x09-\x0D]+
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)  # word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its n + 1 offsets into them (null: empty)."""
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, arr.offset * 8) if offs is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def powers(n: int) -> np.ndarray:
    """STEP ** 0..n-1 modulo 2 ** 64."""
    out = np.full(max(n, 1), STEP, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class Words:
    """The words of a run of texts: byte spans, 64-bit hashes and owning text.

    ``start``/``end`` are byte positions in ``data``; ``doc`` the text of
    each word; ``first[i]:first[i + 1]`` the words of text i.
    """

    def __init__(self, arr: pa.Array, word_bytes: np.ndarray, lower: bool):
        data, off = buffers(arr)
        if lower:
            data = LOWER[data]
        self.data, self.off = data, off
        w = word_bytes[data]
        n = len(data)
        inner = off[(off > 0) & (off < n)]
        begin, stop = w.copy(), w.copy()
        if n:
            begin[1:] &= ~w[:-1]
            begin[inner] = w[inner]
            stop[:-1] &= ~w[1:]
            stop[inner - 1] = w[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        m = len(self.start)
        if m:
            length = self.end - self.start
            word = np.cumsum(begin) - 1
            pos = np.flatnonzero(w)
            word = word[pos]
            value = BYTE_CODE[data[pos]] * powers(int(length.max()))[pos - self.start[word]]
            heads = np.zeros(m, np.int64)
            np.cumsum(length[:-1], out=heads[1:])
            self.hash = mix(np.add.reduceat(value, heads) ^ (length.astype(U64) * STEP))
        else:
            self.hash = np.zeros(0, U64)
        self.first = np.searchsorted(self.start, off, "left")
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (the last k - 1 words have none)."""
        return combine(self.hash, k)


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values (length n - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= STEP
        out += h[j: j + n]
    return mix(out)


def run_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (length n - w + 1)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size: w - size + n]) if size < w else x[:n]


POS_BITS = 28
POS_MASK = U64((1 << POS_BITS) - 1)


def anchors(h: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive hashes, the position of the smallest (the last of equals).

    Equal runs of w hashes pick the same relative position, wherever they are.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    pos = POS_MASK - (np.arange(len(h), dtype=U64) & POS_MASK)
    low = run_min((h & ~POS_MASK) | pos, w)
    at = (POS_MASK - (low & POS_MASK)).astype(np.int64)
    if len(h) > 1 << POS_BITS:  # positions wrap in very long runs
        at += (np.arange(len(low)) - at + (1 << POS_BITS) - 1) >> POS_BITS << POS_BITS
    return at


def flagged_runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([False], flag, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:n]) > 0
