"""Where texts repeat: the shared Spark plan of the two substring operators.

A window is W consecutive symbols (words or bytes) of one text. Its anchor is
the k-gram with the smallest hash in it, so equal windows have equal anchors
at equal places, and anchors number a small part of the symbols.

1. Texts are dealt into batches of bounded size by a hash of their key.
2. Each batch sends its distinct anchor hashes, packed, to hash buckets.
3. A bucket finds the anchors that occur twice or more, names for each one
   canonical text (its first), and answers the batches.
4. A batch cuts out the spans whose windows have a repeated anchor and sends
   each span to the shard of the anchor's canonical text. All occurrences of a
   window have the same anchor, so they meet in one shard. Neighbouring windows
   mostly share a shard, so spans stay long and are sent about once.
   Windows of an anchor with more than HOT occurrences go to finer shards, named by
   the content that all windows of a short run of places share; equal spans
   of a batch are sent once. No shard therefore grows with the number of
   copies of a passage, only with the number of batches that hold one.
5. A shard judges its spans (each operator by its own method) and answers
   with removed ranges; each batch applies them to its texts.

The text is shuffled once; the three steps that read it share that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import slices, text_bytes
from postlens.llm.kernels import BYTE_CODE, SPACES, STEP, U64, Words, anchors, buffers, covered, mix

BATCH_BYTES = 8 << 20
HOT = 256


class WordSeq:
    """Windows of words, over a run of texts."""

    W, K, RUN = 13, 5, 3

    def __init__(self, arr: pa.Array):
        w = self.words = Words(arr, SPACES, False)
        self.first, self.symbols = w.first, w.hash
        self.gram = w.grams(self.K)
        self.at = anchors(self.gram, self.W - self.K + 1)
        self.doc = w.doc[: len(self.at)]
        self.valid = self.doc == w.doc[self.W - 1:] if len(self.at) else np.zeros(0, bool)
        self._core = None

    def core(self, pos: np.ndarray) -> np.ndarray:
        """Hash of the W - RUN + 1 symbols from each position on."""
        if self._core is None:
            self._core = self.words.grams(self.W - self.RUN + 1)
        return self._core[pos]

    def span(self, lo: int, hi: int) -> bytes:
        """The text of symbols lo..hi-1."""
        return self.words.data[self.words.start[lo]: self.words.end[hi - 1]].tobytes()


def gram_hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 32 and 128 bytes from each byte on, by doubling."""
    out, h, size = {}, BYTE_CODE[data], 1
    while size < 128:
        n = len(h) - size
        if n <= 0:
            h = np.zeros(0, U64)
        else:
            x = h[:n] * STEP
            x ^= x >> U64(29)
            x *= U64(0xBF58476D1CE4E5B9)
            x += h[size:]
            h = x
        size *= 2
        if size in (32, 128):
            out[size] = h
    return out


def overlapped(h: np.ndarray, size: int, length: int) -> np.ndarray:
    """Hash of ``length`` bytes from the hashes of ``size`` bytes (size <= length <= 2 size)."""
    n = len(h) - (length - size)
    return mix(h[:n] * STEP + mix(h[length - size:])) if n > 0 else np.zeros(0, U64)


class ByteSeq:
    """Windows of bytes, over a run of texts."""

    W, K, RUN = 200, 32, 32

    def __init__(self, arr: pa.Array):
        self.data, self.first = buffers(arr)
        self.hashes = gram_hashes(self.data)
        self.gram = mix(self.hashes[32])
        self.at = anchors(self.gram, self.W - self.K + 1)
        n = len(self.at)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[:n]
        self.valid = np.arange(n) + self.W <= self.first[1:][self.doc] if n else np.zeros(0, bool)
        self._core = None

    def core(self, pos: np.ndarray) -> np.ndarray:
        if self._core is None:
            self._core = overlapped(self.hashes[128], 128, self.W - self.RUN + 1)
        return self._core[pos]

    def span(self, lo: int, hi: int) -> bytes:
        return self.data[lo:hi].tobytes()


def _sorted(table: pa.Table) -> pa.RecordBatch:
    """The texts of a batch in the order of id (null first), then hash."""
    known = pc.is_valid(table["doc_id"])
    table = table.append_column("_k", known).sort_by([("_k", "ascending"), ("doc_id", "ascending"), ("th", "ascending")])
    table = table.select(["doc_id", "th", "text"])
    cols = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]
    return pa.RecordBatch.from_arrays(cols, names=table.column_names)


def _pieces(table: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The sorted batch in runs of about a megabyte: (number of the first text, run)."""
    at = 0
    for run in slices(iter([_sorted(table)]), "text"):
        yield at, run
        at += run.num_rows


def _distinct_positions(seq) -> np.ndarray:
    a = seq.at[seq.valid]
    return a[np.append(True, a[1:] != a[:-1])] if len(a) else a


def _packed(key: np.ndarray) -> tuple[np.ndarray, Callable]:
    """Where each run of equal keys starts, and what packs a column into one binary value per run."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(key))[: len(at)]
    return at, lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())


def batches(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> tuple[DataFrame, int]:
    """``batch, doc_id, th, text`` and the number of batches, from the size of all texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = max(1, -(-text_bytes(rows) // batch_bytes))
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    return rows.select(F.pmod(F.xxhash64("doc_id", th), F.lit(n)).cast("long").alias("batch"), "doc_id",
                       th.alias("th"), "text"), n


def find_repeats(docs: DataFrame, kind: type, judge: Callable, finish: Callable, finish_schema: str,
                 id_col: str = "doc_id", text_col: str = "text", ordered: bool = True,
                 batch_bytes: int = BATCH_BYTES, hot: int = HOT) -> DataFrame:
    """Run the plan above.

    ``judge(rows)`` gets one shard's spans as ``(order, batch, doc, pos, span)``
    and yields ``(batch, doc, lo, hi)`` removed symbol ranges. ``finish(run,
    first_doc, ranges)`` makes the result of a run of texts. ``ordered``: a
    span counts only against texts with a smaller id, else against any other.
    """
    texts, n = batches(docs, id_col, text_col, batch_bytes)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    bits = max(1, (n - 1).bit_length())
    run_len, width = kind.RUN, kind.W

    def send_anchors(key, table):
        hs, ds = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for first, run in _pieces(table):
            seq = kind(run.column(2))
            a = _distinct_positions(seq)
            docs_of = np.searchsorted(seq.first, a, "right") - 1
            hs.append(seq.gram[a])
            ds.append(docs_of + first)
        h, d = np.concatenate(hs), np.concatenate(ds)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        count = np.minimum(np.diff(np.append(new, len(h))), 65535).astype(np.uint16)
        h, d = h[new], d[new].astype(np.uint32)
        bucket = (h >> U64(64 - bits)).astype(np.int64)
        at, cut = _packed(bucket)
        return pa.table({"bucket": bucket[at], "batch": np.full(len(at), key[0].as_py(), np.int64),
                         "h": cut(h), "d": cut(d), "n": cut(count)})

    def find_repeated(table):
        col = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table[name]]
        hs = col("h", U64)
        sizes = [len(x) for x in hs]
        h, d = np.concatenate(hs), np.concatenate(col("d", np.uint32)).astype(np.int64)
        count = np.concatenate(col("n", np.uint16)).astype(np.int64)
        batch = np.repeat(np.asarray(table["batch"]), sizes)
        order = np.lexsort((d, batch, h))
        h, d, batch, count = h[order], d[order], batch[order], count[order]
        new = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, count)[group]
        at = np.flatnonzero(new)
        label = mix(batch[at].astype(U64) * STEP + mix(d[at].astype(U64) + U64(1)))[group]
        keep = total >= 2
        h, batch, label, many = h[keep], batch[keep], label[keep], (total[keep] > hot).astype(np.uint8)
        order = np.lexsort((h, batch))
        h, batch, label, many = h[order], batch[order], label[order], many[order]
        at, cut = _packed(batch)
        return pa.table({"batch": batch[at], "h": cut(h), "label": cut(label), "hot": cut(many)})

    def send_spans(key, table, reply):
        batch = key[0].as_py()
        col = lambda name, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_py(), kind) for x in reply[name]]])
        h, label, many = col("h", U64), col("label", U64), col("hot", np.uint8)
        order = np.argsort(h)
        h, label, many = h[order], label[order], many[order].astype(bool)
        seen: dict = {}
        out: list[tuple] = []  # key, doc, doc_id, th, pos, windows, span
        local: list[tuple] = []  # doc, lo, hi
        for first, run in _pieces(table) if len(table) and len(h) else ():
            seq = kind(run.column(2))
            if not len(seq.at):
                continue
            a = _distinct_positions(seq)
            if not len(a):
                continue
            i = np.minimum(np.searchsorted(h, seq.gram[a]), len(h) - 1)
            found = h[i] == seq.gram[a]
            at = np.searchsorted(a, seq.at)  # valid windows: the number of their anchor
            at[~seq.valid] = 0
            w = np.flatnonzero(seq.valid & found[at])
            if not len(w):
                continue
            of = i[at[w]]
            keys = label[of].copy()
            fine = many[of]
            if fine.any():
                p = seq.at[w[fine]]
                j = (p - w[fine]) // run_len
                keys[fine] = mix(seq.core(p - j * run_len) + (j + 1).astype(U64) * STEP)
            doc = seq.doc[w]
            new = np.append(True, (w[1:] != w[:-1] + 1) | (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(w)))
            ids, ths = run.column(0).to_pylist(), run.column(1).to_pylist()
            for b, m in zip(begin.tolist(), count.tolist(), strict=True):
                lo, x = int(w[b]), int(doc[b])
                span, k = seq.span(lo, lo + m + width - 1), int(keys[b])
                pos, me = lo - int(seq.first[x]), ids[x]
                earlier = seen.get((k, span))
                if earlier is not None and (not ordered or earlier[0] != me):
                    local.append((first + x, pos, pos + m + width - 1))
                    if not ordered and not earlier[1][0]:
                        earlier[1][0] = True
                        local.append(earlier[2])
                    continue
                if earlier is None:
                    seen[(k, span)] = (me, [False], (first + x, pos, pos + m + width - 1))
                out.append((k, first + x, me, ths[x], pos, m, span))
        n_out, n_local = len(out), len(local)
        # ranges settled here only pass through: any shard will do
        passing = mix(np.arange(n_local, dtype=U64) + U64(batch % (1 << 40)) * U64(1 << 24))
        keys = np.concatenate((np.array([r[0] for r in out], U64), passing)).view(np.int64)
        nulls = [None] * n_local
        return pa.table({
            "key": keys, "sent": pa.array([True] * n_out + [False] * n_local, pa.bool_()), "batch": np.full(n_out + n_local, batch, np.int64),
            "doc": pa.array([r[1] for r in out] + [r[0] for r in local], pa.int64()),
            "doc_id": pa.array([r[2] for r in out] + nulls, table.schema.field("doc_id").type),
            "th": pa.array([r[3] for r in out] + nulls, pa.int64()),
            "lo": pa.array([r[4] for r in out] + [r[1] for r in local], pa.int64()),
            "hi": pa.array([r[4] + r[5] + width - 1 for r in out] + [r[2] for r in local], pa.int64()),
            "span": pa.array([r[6] for r in out] + nulls, pa.binary())})

    def judge_shards(arrow):
        def result(rows):
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["batch", "doc", "lo", "hi"])

        current, group, done = None, [], []
        for b in arrow:
            t = b.to_pydict()
            for key, sent, batch, doc, doc_id, lo, hi, span in zip(
                    t["key"], t["sent"], t["batch"], t["doc"], t["doc_id"], t["lo"], t["hi"], t["span"], strict=True):
                if not sent:
                    done.append((batch, doc, lo, hi))
                    continue
                if key != current:
                    if len(group) > 1 or group and not ordered:
                        done.extend(judge(group))
                    current, group = key, []
                group.append((doc_id, batch, doc, lo, span))
            if len(done) > 50_000:
                yield result(done)
                done = []
        if len(group) > 1 or group and not ordered:
            done.extend(judge(group))
        yield result(done)

    def apply_ranges(table, ranges):
        doc, lo, hi = (np.asarray(ranges[c]) for c in ("doc", "lo", "hi"))
        order = np.argsort(doc, kind="stable")
        doc, lo, hi = doc[order], lo[order], hi[order]
        parts = []
        for first, run in _pieces(table) if len(table) else ():
            x, y = np.searchsorted(doc, [first, first + run.num_rows])
            parts.append(finish(run, doc[x:y] - first, lo[x:y], hi[x:y]))
        return pa.Table.from_batches(parts) if parts else finish_empty(table)

    def finish_empty(table: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        return pa.Table.from_batches([finish(_sorted(table), none, none, none)])

    buckets = texts.groupBy("batch").applyInArrow(
        send_anchors, "bucket long, batch long, h binary, d binary, n binary")
    replies = buckets.groupBy("bucket").applyInArrow(find_repeated, "batch long, h binary, label binary, hot binary")
    spans = texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        send_spans, f"key long, sent boolean, batch long, doc long, doc_id {id_type}, th long, lo long, hi long, span binary")
    shards = spans.repartition("key").sortWithinPartitions("key", "doc_id", "th", "batch", "doc", "lo")
    ranges = shards.mapInArrow(judge_shards, "batch long, doc long, lo long, hi long")
    return texts.groupBy("batch").cogroup(ranges.groupBy("batch")).applyInArrow(
        apply_ranges, finish_schema.format(id=id_type))


def removed_mask(first: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which symbols of a run of texts lie in a removed range."""
    return covered(int(first[-1]), first[doc] + lo, first[doc] + hi)
