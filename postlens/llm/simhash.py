"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingle hashes have
it. Equal fingerprints collapse first, so a large group of copies is one
entry. Each fingerprint is cut into segments; if two differ in at most r bits,
some segment differs in at most r // m of them. Every fingerprint enumerates
the Hamming ball of that radius around each of its segments, fetches the table
entries at those keys with an equi-join, and the whole distance is verified
in the join condition. Linked fingerprints form components, found by
iterated aggregation on the cluster.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import components, cut, row_key, slices

SHINGLE, DISTANCE, SEGMENTS, SEED = 3, 2, 2, 42
_WORDS = regex.compile(rb"[^\x20\x09-\x0D]+")
_A_Z = bytes(range(65, 91))
_LOWER = bytes.maketrans(_A_Z, _A_Z.lower())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text; 0 without words."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    k = min(shingle, len(words))
    h64 = xxhash.xxh64_intdigest
    votes, total = np.zeros(64, np.int64), len(words) - k + 1
    for lo in range(0, total, 1 << 16):  # bounded memory for very long texts
        n = min(1 << 16, total - lo)
        hashes = np.fromiter([h64(joined[a:b - 1], SEED) for a, b in
                              zip(starts[lo: lo + n], ends[lo + k - 1: lo + k - 1 + n], strict=True)], np.uint64, n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, keys: bool = False) -> DataFrame:
    """``doc_id`` and ``fp`` (signed 64-bit), one row per row; with ``keys`` also the text hashes."""
    extra = row_key(F.col("doc_id"), F.col("text")) if keys else []
    names = ["_h1", "_h2"] if keys else []

    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            texts = b.column(b.schema.get_field_index("text"))
            fp = np.fromiter([fingerprint(t.as_py(), shingle) for t in texts], np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fp.view(np.int64)), *[b.column(b.schema.get_field_index(n)) for n in names]],
                names=["doc_id", "fp", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", *extra)
    return rows.mapInArrow(run, "doc_id {}, fp long{}".format(
        rows.schema["doc_id"].dataType.simpleString(), "".join(f", {n} long" for n in names)))


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _ball(segment: int, at: Column, masks: list[int]) -> Column:
    """The keys around a segment value: it, and it with each mask's bits flipped."""
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]),
                       lambda m: F.struct(F.lit(segment).alias("s"), at.bitwiseXOR(m).alias("key")))


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct fingerprints in ``prints.fp`` at most ``distance`` bits apart.

    With r = m * q + rest, either one of the first rest + 1 segments differs
    in at most q bits, or one of the others in at most q - 1 (pigeonhole).
    """
    distinct = prints.select("fp").distinct()
    q, rest = divmod(distance, segments)
    table, probes = [], []
    for i, (shift, width) in enumerate(_segments(segments)):
        radius = q if i <= rest else q - 1
        if radius < 0:
            continue
        masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
        at = _segment(F.col("fp"), shift, width)
        table.append(F.struct(F.lit(i).alias("s"), at.alias("key")))
        probes.append(_ball(i, at, masks))
    t = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*table)).alias("k")).select("b", "k.s", "k.key")
    p = distinct.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("k")).select("a", "k.s", "k.key")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    found = p.alias("p").join(t.alias("t"), (F.col("p.s") == F.col("t.s")) & (F.col("p.key") == F.col("t.key")) & near)
    return found.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, segments: int = SEGMENTS, keys: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    With ``keys`` also the component's ``root`` (one of its fingerprints) and the row key.

    ``component_id`` is the smallest id reachable over links of at most
    ``distance`` bits. Null, empty and blank texts have fingerprint 0 and link
    like any other. A null id is never a component's name unless all its
    members have none. Repeated rows appear as often as they occur; an empty
    table gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle, keys))
    edges = cut(links(prints, distance, segments))
    nodes = components(edges, "a", "b")
    roots = (prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
             .join(nodes, F.col("fp") == F.col("node"), "left")
             .select("fp", F.coalesce("root", "fp").alias("root"), "low"))
    names = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    of = roots.join(names, "root").select("fp", "root", "component_id")
    out = prints.join(of, "fp")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select("doc_id", hexed, "component_id", *(["root", "_h1", "_h2"] if keys else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """The columns of ``docs``, one row of each component: the smallest id, known before null.

    Of rows that share that id the one with the smallest text hash stays; of
    exact repeats one.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, distance, segments, keys=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_h1", "_h2")).alias("m")
    keep = found.groupBy("root").agg(first).select("m._h1", "m._h2")
    row = F.struct("*").alias("row")
    rows = docs.select(row, *row_key(F.col(id_col), F.col(text_col).cast("string")))
    return rows.join(keep, ["_h1", "_h2"]).dropDuplicates(["_h1", "_h2"]).select("row.*")
